"""Dictionary classification of texts: scan, score, caps, composites, subsumption; pattern extractors and entity mining.

Null texts hold no terms and no names, ties go to the smaller id, and empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import normalize_term
from newsloom.operators.curation import review_queue
from newsloom.operators.extractors import all_names, found_names
from newsloom.sources.domain import Domain, with_domain
from newsloom.sources.store import listed

def matcher(terms: list[str], ignore_case: bool = True) -> Callable[[str | None], list[str]]:
    """A function of a text: its leftmost-longest matches that do not overlap, in order, as `scan` says. One automaton over all
    terms reads a text once, however many terms there are."""
    import ahocorasick

    wanted = sorted({t for t in terms if t})
    machine = ahocorasick.Automaton()
    for t in wanted:
        machine.add_word(t, t)
    machine.make_automaton()
    inside = lambda c: c.isalnum() or c == "_"

    def find(x: str | None) -> list[str]:
        if not x or not wanted:
            return []
        x = x.replace("’", "'")
        x = x.lower() if ignore_case else x
        best: dict[int, str] = {}  # the longest term that begins at a place
        for last, t in machine.iter(x):
            first, after = last + 1 - len(t), x[last + 1 : last + 2]
            if not (first and inside(x[first - 1])) and not (after and (inside(after) or after == "'")) and len(t) > len(best.get(first, "")):
                best[first] = t
        out, end = [], 0
        for first in sorted(best):
            if first >= end:
                out.append(best[first])
                end = first + len(best[first])
        return out

    return find


def scan(text: Column, terms: list[str], ignore_case: bool = True) -> Column:
    """The leftmost-longest matches that do not overlap, in order. terms: a dictionary's terms (a broadcast rule set),
    normalised where case is ignored. A match stands between characters that are no letters, digits or underscores, and no
    apostrophe follows. Null text: none."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = matcher(terms, ignore_case)  # once for all batches of a task
        for texts in batches:
            yield texts.map(find)

    return run(text)


def term_counts(texts: DataFrame, terms: dict[bool, list[str]]) -> DataFrame:
    """texts: doc_id, title, body. doc_id, term, cs, t, b: how often each term stands in title and body, one row for each term that
    a row of texts holds. terms: those of each case sensitivity."""

    def start() -> Callable[[dict], list[tuple]]:
        finders = [(cs, matcher(ts, not cs)) for cs, ts in terms.items() if ts]

        def find(row: dict) -> list[tuple]:
            out = []
            for cs, matches in finders:
                t, b = Counter(matches(row["title"])), Counter(matches(row["body"]))
                out += [(term, cs, t[term], b[term]) for term in t | b]
            return out

        return find

    return found_names(texts.select("doc_id", "title", "body"), ("doc_id",), "term string, cs boolean, t long, b long", start)


def classify(articles: DataFrame, dictionary: DataFrame, min_score: float = 1.0, skip_title: str = r"(?iu)\b(offerta|offerte)\b") -> DataFrame:
    """articles: doc_id, title, body; dictionary: topic_id, type, term (at least two characters).
    doc_id, topic_id, score (3 a title match, 1 a body match), position (both, title, body).

    Titles with a skipped word get no topic. The dictionary is small by nature (curated rules); its terms become one
    pattern, and matches join it by term.
    """
    dictionary = dictionary.where(F.length("term") >= 2).withColumn("term", normalize_term("term"))
    terms = [r["term"] for r in dictionary.select("term").distinct().collect()]  # the curated rule set
    kept = articles.where(~F.coalesce(F.col("title"), F.lit("")).rlike(skip_title))
    counts = term_counts(kept, {False: terms})
    scored = counts.join(F.broadcast(dictionary.select("term", "topic_id", "type").distinct()), "term").groupBy("doc_id", "topic_id", "type").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))
    position = F.when((F.col("t") > 0) & (F.col("b") > 0), "both").when(F.col("t") > 0, "title").otherwise("body")
    return scored.select("doc_id", "topic_id", "type", (3.0 * F.col("t") + F.col("b")).alias("score"), position.alias("position")).where(F.col("score") >= min_score)


def cap_topics(matches: DataFrame, caps: dict[str, int]) -> DataFrame:
    """The best topics of each type in a document, as many as its cap; types without a cap keep all."""
    limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("type")), F.lit(1 << 30))
    w = Window.partitionBy("doc_id", "type").orderBy(F.desc("score"), "topic_id")
    return matches.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= limit).drop("__place")


def composite_rules(matches: DataFrame, rules: list[tuple[int, list[int]]]) -> DataFrame:
    """Rules in order: where a document has all components, the composite topic takes their place with the sum of scores,
    so that a rule can use up what a later one needs. rules: (composite topic, components), a small curated list."""
    sums = matches.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("topic_id", "score"))).alias("m"))
    m = F.col("m")
    for composite, parts in rules:
        m = _apply_rule(m, composite, F.array(*[F.lit(p).cast("bigint") for p in parts]))
    return sums.select("doc_id", F.explode(m).alias("topic_id", "score"))


def _apply_rule(m: Column, composite: int, ids: Column) -> Column:
    has = F.size(F.array_except(ids, F.map_keys(m))) == 0
    total = F.aggregate(ids, F.lit(0.0), lambda a, p: a + F.coalesce(F.try_element_at(m, p), F.lit(0.0)))
    rest = F.map_filter(m, lambda k, v: ~F.array_contains(ids, k) & (k != composite))
    return F.when(has, F.map_concat(rest, F.create_map(F.lit(composite).cast("bigint"), total))).otherwise(m)


def drop_subsumed(matches: DataFrame, names: DataFrame) -> DataFrame:
    """Without the matches whose tokens are a contiguous proper part of another match's of the document. Matches without a name
    stay. The matches of a document meet in one row."""
    padded = names.select("topic_id", F.concat(F.lit(" "), normalize_term("name"), F.lit(" ")).alias("p")).groupBy("topic_id").agg(F.collect_set("p").alias("__padded"))
    own = matches.join(F.broadcast(padded), "topic_id", "left").groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in matches.columns if c != "doc_id"], "__padded")).alias("m"))
    own = own.withColumn("all", F.array_distinct(F.flatten(F.filter(F.transform("m", lambda x: x["__padded"]), lambda p: p.isNotNull()))))
    inside = lambda p: F.exists("all", lambda q: F.contains(q, p) & (F.length(q) > F.length(p)))
    kept = F.filter("m", lambda x: F.col("doc_id").isNull() | x["__padded"].isNull() | ~F.exists(x["__padded"], inside))
    return own.select("doc_id", F.inline(kept)).select(*matches.columns)


def mine_entities(texts: DataFrame, brands: tuple[str, ...] = (), common: tuple[str, ...] = ()) -> DataFrame:
    """texts: doc_id, source, text. normalized, kind, surface (first by document), occurrences, sources. Null texts have no
    entities; occurrences of one document count once for each surface."""
    kept = frozenset(common)
    each = found_names(texts.select("doc_id", "source", "text"), ("doc_id", "source"), "pos int, surface string, kind string", lambda: lambda row: [
        (i, *name) for i, name in enumerate(all_names(row["text"], brands, kept))])
    return each.groupBy(normalize_term("surface").alias("normalized"), "kind").agg(
        F.min(F.struct("doc_id", "pos", F.col("surface").alias("s")))["s"].alias("surface"), F.count("*").alias("occurrences"), F.count_distinct("source").alias("sources"))


DICTIONARY = [(1, "function", "the"), (2, "function", "and"), (3, "function", "of"), (4, "relative", "that"), (5, "relative", "with"), (6, "phrase", "of the")]


def _dictionary(spark):
    return listed(spark, DICTIONARY, "topic_id bigint, type string, term string")


def _matches(spark, sf):
    return classify(Domain(spark, sf).texts(), _dictionary(spark))


def _entities(spark, sf):
    return mine_entities(Domain(spark, sf).table("documents").select("doc_id", "source", "text"))


def _review(spark, sf):
    """The first of the queue, all entities unresolved; hints are the topics whose names their words are."""
    found = _entities(spark, sf).withColumns({"topic_id": F.lit(None).cast("long"), "ignored": F.lit(False)})
    terms = Domain(spark, sf).topics().select(normalize_term("name").alias("term"), F.col("topic_id").cast("long").alias("topic_id"))
    return review_queue(found, terms, 1).select("normalized", "kind", "surface", "occurrences", "sources", F.array_join("hints", ",").alias("hints"))


def _scan_sql(c: str, terms: str = "of  the|that|with|the|and|of") -> str:
    # every boundary character twice, so that one match's end can be the next one's start
    doubled = f"regexp_replace('  ' || lower(replace({c}, '’', '''')) || '  ', '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g')"
    return f"list_transform(regexp_extract_all({doubled}, '[^\\p{{L}}\\p{{N}}_]({terms})[^\\p{{L}}\\p{{N}}_'']', 1), lambda x: replace(x, '  ', ' '))"


_MATCH_SQL = with_domain("texts", f"""
, d AS (SELECT * FROM (VALUES {", ".join(f"({a}::BIGINT, '{b}', '{c}')" for a, b, c in DICTIONARY)}) v(topic_id, type, term)),
h AS (SELECT doc_id, unnest({_scan_sql("title")}) AS term, 1 AS t, 0 AS b FROM texts UNION ALL SELECT doc_id, unnest({_scan_sql("body")}), 0, 1 FROM texts),
m AS (SELECT doc_id, topic_id, type, 3.0::DOUBLE * sum(t) + sum(b) AS score, CASE WHEN sum(t) > 0 AND sum(b) > 0 THEN 'both' WHEN sum(t) > 0 THEN 'title' ELSE 'body' END AS position FROM h JOIN d USING (term) GROUP BY 1, 2, 3)""")
QUERIES = {
    "dict_classify": _matches,
    "dict_scan": lambda spark, sf: _matches(spark, sf).groupBy("topic_id").agg(F.count("*").alias("docs"), F.sum("score").alias("score")),
    "topn_caps": lambda spark, sf: cap_topics(_matches(spark, sf), {"function": 2, "relative": 1}),
    "composite_rules": lambda spark, sf: composite_rules(_matches(spark, sf), [(100, [4, 5]), (101, [5, 6])]),
    "subsumption": lambda spark, sf: drop_subsumed(_matches(spark, sf), _dictionary(spark).withColumnRenamed("term", "name").select("topic_id", "name")).select("doc_id", "topic_id", "score"),
    "entity_mining": _entities,
    "entity_type_counts": lambda spark, sf: _entities(spark, sf).groupBy("kind").agg(F.count("*").alias("n")),
    "entity_review": _review,
}
ORACLE_SQL = {
    "dict_classify": _MATCH_SQL + " SELECT * FROM m",
    "dict_scan": _MATCH_SQL + " SELECT topic_id, count(*) AS docs, sum(score) AS score FROM m GROUP BY 1",
    "topn_caps": _MATCH_SQL + " SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, type ORDER BY score DESC, topic_id) <= CASE type WHEN 'function' THEN 2 WHEN 'relative' THEN 1 ELSE 1000000 END",
    "composite_rules": _MATCH_SQL + ", f AS (SELECT doc_id, max((topic_id = 4)::INT) + max((topic_id = 5)::INT) = 2 AS first, max((topic_id = 5)::INT) + max((topic_id = 6)::INT) = 2 AS second FROM m GROUP BY 1) SELECT doc_id, CASE WHEN first AND topic_id IN (4, 5) THEN 100 WHEN NOT first AND second AND topic_id IN (5, 6) THEN 101 ELSE topic_id END::BIGINT AS topic_id, sum(score) AS score FROM m JOIN f USING (doc_id) GROUP BY 1, 2",
    "subsumption": _MATCH_SQL + " SELECT doc_id, topic_id, score FROM m WHERE NOT (topic_id IN (1, 3) AND EXISTS (SELECT 1 FROM m x WHERE x.doc_id = m.doc_id AND x.topic_id = 6))",
}
