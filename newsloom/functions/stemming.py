"""Italian suffix stripping by the rules of the public Snowball description, over a column of distinct words.

A word's regions are places: `rv`, `r1` and `r2` are the first characters of the regions of these names, one after the last
where a region is empty. An ending is in a region if it begins there or later. Each step is a stage of its own, so that
every expression is computed once a word. Null stays null, words without endings stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Vowels, and the endings of the description, by what becomes of them.
V = "aeiouàèìòù"
PRONOUNS = "(?:(?:gli|[mtcv])e(?:l[aeio]|ne)|sene|gli|[cmtvs]i|l[aeio]|ne)$"
PLAIN = "anz[ae]|ic[oiae]|ich[ei]|ism[oi]|[ai]bil[ei]|ist[aeiàèì]|os[oiae]|mente|atric[ei]|ant[ei]"
AZIONE, LOGIA, UZIONE, ENZA, MENTO, AMENTE, ITA, IVO = "azion[ei]|ator[ei]", "logi[ae]", "u[zs]ion[ei]", "enz[ae]", "[ai]ment[oi]", "amente", "ità", "iv[oiae]"
VERBS = (
    "ammo|ando|ano|are|arono|asse|assero|assi|assimo|at[aeio]|av[aio]|avamo|avano|avate|emmo|end[aeio]|erà|erai|eranno|ere|erebbe|erebbero|erei|eremmo|eremo|ereste|"
    "eresti|erete|erò|erono|essero|ete|ev[aio]|evamo|evano|evate|[Yi]amo|immo|irà|irai|iranno|ire|irebbe|irebbero|irei|iremmo|iremo|ireste|iresti|irete|irò|irono|"
    "isc[aeio]|iscano|iscono|issero|it[aeio]|iv[aio]|ivamo|ivano|ivate|ono|ut[aeio]|ar|ir"
)


#: What of a word comes before each region.
BEFORE = {
    "rv": f"^(?:.[^{V}]+[{V}]|[{V}][{V}]+[^{V}]|[^{V}][{V}].)",
    "r1": f"^[^{V}]*[{V}]+[^{V}]",
    "r2": f"^[^{V}]*[{V}]+[^{V}][^{V}]*[{V}]+[^{V}]",
}


def _ending(c: Column, pattern: str) -> Column:
    """The longest ending of the pattern, '' without one."""
    return F.regexp_extract(c, f"(?:{pattern})$", 0)


def _without(c: Column, end: Column) -> Column:
    return c.substr(F.lit(1), F.length(c) - F.length(end))


def _inside(c: Column, end: Column, region: str) -> Column:
    """Whether c has the ending and that begins in the region."""
    return (end != "") & (F.length(c) - F.length(end) + 1 >= F.col(f"__{region}"))


def italian_stems(words: DataFrame, word: str = "word", out: str = "stem") -> DataFrame:
    """words with the stem of a column of lower-case words. Columns named __… are used between."""
    kept, w = words.columns, F.col("__w")
    df = words.withColumn("__w", F.regexp_replace(F.translate(F.col(word), "áéíóú", "àèìòù"), "qu", "qU"))
    # u and i between vowels count as consonants; a vowel that ends one such place begins no other
    df = df.withColumn("__w", F.regexp_replace("__w", f"([{V}])([ui])([{V}])", "$1<$2$3"))
    df = df.withColumn("__w", F.replace(F.replace(w, F.lit("<i"), F.lit("I")), F.lit("<u"), F.lit("U")))
    df = df.withColumns({f"__{r}": F.when(w.rlike(p), F.length(F.regexp_extract(w, p, 0))).otherwise(F.length(w)) + 1 for r, p in BEFORE.items()})

    def cut(df: DataFrame, pattern: str, region: str, where: Column | None = None) -> DataFrame:
        """Take an ending out where it is in the region; __cut tells where that was done."""
        df = df.withColumn("__end", _ending(w, pattern))
        hit = F.coalesce(_inside(w, F.col("__end"), region), F.lit(False))
        df = df.withColumn("__cut", hit if where is None else hit & where)
        return df.withColumn("__w", F.when(F.col("__cut"), _without(w, F.col("__end"))).otherwise(w))

    # attached pronouns after a gerund or an infinitive
    df = df.withColumn("__base", _without(w, _ending(w, PRONOUNS)))
    has, base = F.length("__base") < F.length("__w"), F.col("__base")
    df = df.withColumn("__w", F.when(has & _inside(base, _ending(base, "[ae]ndo"), "rv"), base)
                       .when(has & _inside(base, _ending(base, "[aei]r"), "rv"), F.concat(base, F.lit("e"))).otherwise(w))
    # standard endings: the longest one alone counts
    classes = {"plain": PLAIN, "azione": AZIONE, "logia": LOGIA, "uzione": UZIONE, "enza": ENZA, "mento": MENTO, "amente": AMENTE, "ita": ITA, "ivo": IVO}
    df = df.withColumn("__first", w).withColumn("__long", _ending(w, "|".join(classes.values())))
    kind = F.lit(None).cast("string")
    for name, pattern in classes.items():
        kind = F.when(F.col("__long").rlike(f"^(?:{pattern})$"), name).otherwise(kind)
    df = df.withColumn("__kind", kind)
    region = F.when(F.col("__kind") == "mento", F.col("__rv")).when(F.col("__kind") == "amente", F.col("__r1")).otherwise(F.col("__r2"))
    df = df.withColumn("__done", F.coalesce(F.col("__kind").isNotNull() & (F.length(w) - F.length("__long") + 1 >= region), F.lit(False)))
    put = F.when(F.col("__kind") == "logia", "log").when(F.col("__kind") == "uzione", "u").when(F.col("__kind") == "enza", "ente").otherwise("")
    df = df.withColumn("__w", F.when(F.col("__done"), F.concat(_without(w, F.col("__long")), put)).otherwise(w))
    done = lambda name: F.col("__done") & (F.col("__kind") == name)
    df = cut(df, "ic", "r2", done("azione"))
    df = cut(df, "abil|ic|iv", "r2", done("ita"))
    df = cut(df, "iv", "r2", done("amente")).withColumn("__iv", F.col("__cut"))
    df = cut(df, "at", "r2", F.col("__iv"))
    df = cut(df, "os|ic|abil", "r2", done("amente") & ~F.col("__iv"))
    df = cut(df, "at", "r2", done("ivo"))
    df = cut(df, "ic", "r2", F.col("__cut"))
    # endings of verbs, where no standard one went
    df = df.withColumn("__end", _ending(w.substr(F.col("__rv"), F.length(w)), VERBS))
    df = df.withColumn("__w", F.when(F.col("__done"), w).otherwise(_without(w, F.col("__end"))))
    # a last vowel, an i before it, the h of ch and gh
    df = cut(df, "[aeioàèìò]", "rv")
    df = cut(df, "i", "rv", F.col("__cut"))
    df = df.withColumn("__w", F.when(_inside(w, _ending(w, "[cg]h"), "rv"), _without(w, F.lit("h"))).otherwise(w))
    return df.select(*kept, F.translate(w, "IU", "iu").alias(out))
