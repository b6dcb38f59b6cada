"""Toxicity behind a noisy channel: restore obfuscated words, then score the restored text.

Channel: an author's letter may be written as a look-alike (0 for o, $ for s), repeated, masked, or set apart by spaces
or symbols. A suspicious token (or a run of single characters) becomes a lattice of what each character can stand for,
and Viterbi finds the path that is most probable under a character trigram model of the corpus. Plain words without a
doubled letter have a lattice of one path and stay as they are. A run of single characters can hold several words: its
lattice has word boundaries too, and known words are looked for from each of its positions.

Score: words of the restored text weigh what their stems' document frequencies among labelled toxic and clean texts
say (log odds); a logistic model turns a document's strongest words into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import fold, give_back, materialize, table
from newsloom.llm.words import chunks, text_buffer

#: About so many labelled documents of each class are learnt from.
SAMPLE = 5000
STEMS = (3, 4, 5, 6)
#: A stem counts from such log odds on, and if its counts are so many nats likelier under its own share of toxic
#: documents than under the sample's (about a million stems are tried, so chance gives 14 nats hardly ever).
LEAST_ODDS, LEAST_EVIDENCE = 2.5, 14.0
CACHE_WORDS = 150_000
#: What a written character can stand for besides itself; '' is a mere separator.
LOOKALIKES = {
    "0": ("o",), "1": ("i", "l"), "2": ("z",), "3": ("e",), "4": ("a",), "5": ("s",), "6": ("g", "b"), "7": ("t",), "8": ("b",), "9": ("g",),
    "@": ("a",), "$": ("s", ""), "!": ("i", "l", ""), "|": ("l", "i", ""), "+": ("t", ""), "(": ("c", ""), "*": ("a", "e", "i", "o", "u", ""),
    "#": ("h", ""), "&": ("a", ""), "%": ("",), ".": ("",), "-": ("",), "_": ("",), "'": ("",), ",": ("",), "~": ("",), "^": ("",), "=": ("",), "/": ("",),
}
#: ln of the channel's probabilities.
SUBSTITUTED, SEPARATED, COLLAPSED = math.log(0.05), math.log(0.05), math.log(0.2)
_EDGE = ".,;:!?\"'()[]{}<>«»“”„…-_*&%$#|/\\~^=+`"
_PLAIN = re.compile(r"(?:([^\W\d_])(?!\1\1))+")
_DOUBLED = re.compile(r"(.)\1", re.S)
_REPEATS = re.compile(r"(.)\1*", re.S)
_SYMBOLS = re.compile(r"([*&%$#!.?,;:~^=+|])\1{2,}$")
#: Words of such lengths count.
SHORTEST, LONGEST = 3, 40
#: Inside a run of single characters, words count that take so many of them, and beginnings of so many letters.
LEAST_RUN = 4
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäãåæçèéêëìíîïñòóôöõøùúûüýßœ"
_CODE = {c: k + 1 for k, c in enumerate(LETTERS)}
SIZE = len(LETTERS) + 1  # 0: outside of a word


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams of all texts, words set apart by two boundaries; SIZE^3 numbers at most leave the tasks."""
    code = np.zeros(0x180, np.int64)
    for c, k in _CODE.items():
        code[ord(c)] = k

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            raw, at = text_buffer(pc.utf8_lower(batch.column(0)))
            for a, b in chunks(at):
                piece = raw[at[a] : at[b]].astype(np.int64)
                lead, tail = piece[:-1], piece[1:]  # two-byte characters of U+0080 to U+017F
                point = np.append(np.where((lead >= 0xC2) & (lead < 0xC6), ((lead & 31) << 6) | (tail & 63), lead), piece[-1:])
                point = point[(piece & 0xC0) != 0x80]
                k = np.where(point < 0x180, code[np.minimum(point, 0x17F)], 0)
                # a second boundary before each word
                double = np.repeat(k, np.where((k == 0) & (np.append(k[1:], 0) > 0), 2, 1))
                double = np.concatenate(([0, 0], double, [0]))
                total += np.bincount((double[:-2] * SIZE + double[1:-1]) * SIZE + double[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    return np.bincount(rows["k"].to_numpy(), rows["n"].to_numpy(), SIZE**3)


class Channel:
    """Restores one token at a time."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(SIZE, SIZE, SIZE)
        two = three.sum(axis=0)
        one = two.sum(axis=0)
        p1 = (one + 0.5) / (one.sum() + 0.5 * SIZE)
        p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
        self.lm = np.log((three + 5 * p2) / (three.sum(axis=2, keepdims=True) + 5)).tolist()

    @staticmethod
    def options(char: str, n: int) -> list[tuple[str, float]]:
        """What n times the same character can stand for, and at what cost."""
        if char in _CODE:
            return [(char, 0.0)] if n == 1 else [(char, COLLAPSED), (char * 2, 0.0 if n == 2 else COLLAPSED)]
        out: list[tuple[str, float]] = []
        for x in LOOKALIKES.get(char, ("",)):
            out += [(x, SUBSTITUTED if x else SEPARATED)] if n == 1 or not x else [(x, SUBSTITUTED + COLLAPSED), (x * 2, 2 * SUBSTITUTED)]
        return out

    def decode(self, text: str) -> str:
        """The most probable restoration of a token. Viterbi over the last two letters."""
        paths: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for m in _REPEATS.finditer(text):
            options = self.options(m[1], len(m[0]))
            new: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, made) in paths.items():
                for x, cost in options:
                    s, i, j = score + cost, a, b
                    for c in x:
                        k = _CODE[c]
                        s += self.lm[i][j][k]
                        i, j = j, k
                    if (i, j) not in new or new[i, j][0] < s:
                        new[i, j] = (s, made + x)
            paths = new
        return max(((s + self.lm[a][b][0], made) for (a, b), (s, made) in paths.items()), default=(0.0, ""))[1]

    def segment(self, run: str) -> list[str]:
        """The most probable words of a run of single characters: as decode, but each may begin a new word."""
        # a path is (score, its last piece and what comes before it)
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for m in _REPEATS.finditer(run):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, made) in paths.items():
                for x, cost in self.options(m[1], len(m[0])):
                    # the boundaries stand before, or within a doubled letter
                    for at in (None, *range(len(x))):
                        s, i, j = score + cost, a, b
                        for k, c in enumerate(x):
                            if k == at:
                                s += self.lm[i][j][0]
                                i = j = 0
                            s += self.lm[i][j][_CODE[c]]
                            i, j = j, _CODE[c]
                        if (i, j) not in new or new[i, j][0] < s:
                            new[i, j] = (s, (x if at is None else f"{x[:at]} {x[at:]}", made))
            paths = new
        made = max(((s + self.lm[a][b][0], made) for (a, b), (s, made) in paths.items()), key=lambda p: p[0])[1]
        pieces = []
        while made:
            piece, made = made
            pieces.append(piece)
        return "".join(reversed(pieces)).split()

    def restore(self, token: str) -> tuple[str, ...]:
        """The words that a lower-cased token can stand for: itself without edge marks, and its restoration."""
        word = token.strip(_EDGE)
        if _PLAIN.fullmatch(word) and (word == token or token.rstrip(".,;:!?") == word or _SYMBOLS.search(token)):
            if not _DOUBLED.search(word):
                return (word,)
            token = word
        elif not any(c.isalpha() for c in token):
            return (word,)
        token = _SYMBOLS.sub("", token)
        # what must stay a letter: with too many, no restoration is a word that counts
        if len(token) > LONGEST and sum("" not in LOOKALIKES.get(m[1], "" if m[1] in _CODE else ("",)) for m in _REPEATS.finditer(token)) > LONGEST:
            return (word,)
        return tuple(dict.fromkeys((word, self.decode(token))))


def tokens(text: str) -> list[str]:
    """Lower-cased tokens; every run of three or more single letters is also joined into one token."""
    out = text.lower().split()
    run: list[str] = []
    joined = []
    for t in out:
        if len(t) == 1 or len(t) == 2 and t[1] in _EDGE:
            run.append(t[0])
        elif run:
            if len(run) > 2:
                joined.append("".join(run))
            run = []
    if len(run) > 2:
        joined.append("".join(run))
    return out + joined


def stems(word: str) -> Iterator[str]:
    """What a word is known by: itself, and its beginnings, marked as such."""
    yield word
    for n in STEMS:
        if len(word) > n:
            yield word[:n] + "-"


def stem_counts(labelled: DataFrame, channel) -> DataFrame:
    """stem, toxic, clean: in how many distinct texts of each label it occurs."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restore = Channel(channel.value).restore
        made: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                words = {w for t in set(tokens(text)) for w in restore(t) if SHORTEST <= len(w) <= LONGEST}
                made[int(toxic)].update({s for w in words for s in stems(w)})
        for label in (0, 1):
            yield pd.DataFrame({"stem": list(made[label]), "toxic": [n if label else 0 for n in made[label].values()], "clean": [0 if label else n for n in made[label].values()]})

    rows = labelled.select("text", "toxic").mapInPandas(count, "stem string, toxic long, clean long")
    return rows.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


class Lexicon:
    """A text's strongest words, by cached weights of its tokens."""

    def __init__(self, channel: Channel, weights: dict[str, float]):
        self.channel, self.weights, self.cache = channel, weights, {}
        self.root: dict = {}  # letters, then the weight of a word under "" and of a beginning under "-"
        for stem, w in weights.items():
            node = self.root
            for c in stem.removesuffix("-"):
                node = node.setdefault(c, {})
            node["-" if stem.endswith("-") else ""] = w

    def _word(self, word: str) -> float:
        return max(self.weights.get(s, 0.0) for s in stems(word)) if SHORTEST <= len(word) <= LONGEST else 0.0

    def _weigh(self, token: str) -> float:
        return max(0.0, *map(self._word, self.channel.restore(token)))

    def spaced(self, run: str) -> dict[str, float]:
        """The weighted words of a run of single characters: those of its segments, and those that begin at any of its places."""
        hits = {w: x for w in self.channel.segment(run) if (x := self._word(w)) > 0}
        pieces = [(m[1], len(m[0])) for m in _REPEATS.finditer(run)]
        for first in range(len(pieces)):
            walks = [(self.root, "", 0)]
            for k in range(first, len(pieces)):
                char, n = pieces[k]
                new = {}
                for node, made, taken in walks:
                    for x, _ in self.channel.options(char, n):
                        at = node
                        for c in x:
                            at = at.get(c)
                            if at is None:
                                break
                        if at is None or at is self.root:
                            continue
                        word = made + x
                        new[word] = (at, word, taken + n)
                        if x and "" in at and len(word) >= SHORTEST and taken + n >= LEAST_RUN:
                            hits[word] = max(hits.get(word, 0.0), at[""])
                        if x and "-" in at and len(word) >= LEAST_RUN and k + 1 < len(pieces):
                            hits[word] = max(hits.get(word, 0.0), at["-"])
                walks = list(new.values())
                if not walks:
                    break
        return hits

    def features(self, text: str) -> tuple[float, float, float, float]:
        """The three strongest distinct words' log odds, and ln(1 + all hits)."""
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        hits: dict[str, float] = {}
        found = 0
        all_tokens = text.lower().split()
        for t in all_tokens:
            w = cache.get(t)
            if w is None:
                w = cache[t] = self._weigh(t)
            if w:
                hits[t] = w
                found += 1
        if sum(1 for t in all_tokens if len(t) <= 2) > 2:
            for run in tokens(text)[len(all_tokens) :]:
                words = self.spaced(run)
                # of words inside one another the longest, so that none counts twice
                for w, x in words.items():
                    if not any(w != other and w in other and words[other] >= x for other in words):
                        hits[w] = max(hits.get(w, 0.0), x)
                        found += 1
        top = sorted(hits.values(), reverse=True)[:3] + [0.0] * 3
        return top[0], top[1], top[2], math.log1p(found)


def train(docs: DataFrame, labels: DataFrame, train_fold: Column, sample: int = SAMPLE) -> dict:
    """counts (letter trigrams of all texts), weights (of stems), logistic (coefficients, intercept).

    Labels are learnt from the rows of train_fold only, about `sample` of each class by a hash of the id; a document
    with several labels counts as toxic if one of them is 1; null labels are none.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    spark = docs.sparkSession
    counts = trigram_counts(docs)
    channel = spark.sparkContext.broadcast(counts)
    known = labels.where(F.col("toxic").isNotNull() & train_fold).groupBy("doc_id").agg((F.max("toxic") == 1).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    part = F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(1 << 30))
    share = {k: int(min(1.0, sample / n) * (1 << 30)) for k, n in sizes.items()}
    chosen = known.where(part < F.when(F.col("toxic") == 1, share.get(1, 0)).otherwise(share.get(0, 0)))
    # at most about 2 * sample rows of an id and a label
    rows = docs.where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    rows = materialize(rows)
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}  # two rows
    if len(n) < 2:
        return {"counts": counts, "weights": {}, "logistic": (np.zeros(4), 5.0 if n.get(1) else -5.0)}
    odds = F.log((F.col("toxic") + 0.1) / (n[1] + 0.2)) - F.log((F.col("clean") + 0.1) / (n[0] + 0.2))
    both = F.col("toxic") + F.col("clean")
    nats = lambda c, share: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / both / share)).otherwise(0.0)
    evidence = nats("toxic", n[1] / (n[0] + n[1])) + nats("clean", n[0] / (n[0] + n[1]))
    strong = stem_counts(rows, channel).withColumn("w", odds).where((evidence >= LEAST_EVIDENCE) & (F.col("w") >= LEAST_ODDS))
    # no more rows than the sample's texts have frequent stems
    weights = {r["stem"]: r["w"] for r in strong.collect()}
    shared = spark.sparkContext.broadcast((counts, weights))

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(Channel(shared.value[0]), shared.value[1])
        for batch in batches:
            yield pd.DataFrame({"f": [list(lexicon.features(t)) for t in batch["text"]], "label": batch["toxic"].astype(float)})

    data = rows.select("text", "toxic").mapInPandas(described, "f array<double>, label double").select(array_to_vector("f").alias("features"), "label")
    fitted = LogisticRegression(regParam=0.002, maxIter=40).fit(data)
    return {"counts": counts, "weights": weights, "logistic": (fitted.coefficients.toArray(), fitted.intercept)}


def score(docs: DataFrame, model: dict, prefix: str = "") -> DataFrame:
    """All columns of docs, score (0 to 1) and predicted (1 from 0.5 on), whose names begin with `prefix`; columns of docs that
    have these names are replaced.

    Null text counts as empty. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made = [f"{prefix}score", f"{prefix}predicted"]
    kept = [c for c in docs.columns if c not in made]
    extra = docs.schema["text"].dataType.simpleString() != "string"  # else the texts need not go to the workers twice
    place = kept.index("text")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        lexicon = Lexicon(Channel(m["counts"]), m["weights"])
        weights, intercept = m["logistic"]
        for batch in batches:
            text = batch.column(batch.num_columns - 1 if extra else place)
            x = np.array([lexicon.features(text[i].as_py() or "") for i in range(batch.num_rows)]).reshape(-1, 4)
            p = 1 / (1 + np.exp(-np.clip(x @ weights + intercept, -50, 50)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*kept, *made])
        del lexicon
        give_back()

    rows = docs.select(*kept, *([F.col("text").cast("string").alias("__text")] if extra else []))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept] + [f"`{made[0]}` double", f"`{made[1]}` int"])
    return rows.mapInArrow(weigh, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = train(docs, labels, ~held_out)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return score(rows, model).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE_SQL: dict[str, str] = {}
