"""Context-tree weighting over bytes.

The next byte is predicted bit by bit; each bit's node (the byte's bits so far) has a context tree whose branches are
the preceding bytes, most recent first, down to DEPTH. Every node of every tree keeps a Krichevsky-Trofimov estimate,
and a node mixes its own estimate with its children's by their block probabilities.

Training is aggregation: tasks count byte (DEPTH + 1)-grams of the training texts and Spark sums them. Distinct grams
are dealt by the last two bytes of their context, so that a partition holds whole subtrees: there block probabilities
go from the deepest nodes up and mixing weights from the root down, in arrays. That gives the log probability of every
gram that any document has; a document's score is the sum over its bytes.

Texts end with byte 0xFF, which UTF-8 never has; it also stands before the first byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import fold, give_back, materialize, most_frequent, table
from newsloom.llm.words import chunks, text_buffer, word_hashes

DEPTH = 6
#: Bytes of context by which grams are dealt to partitions.
TOP = 2
#: The most frequent grams and words, so many at most, go to every task (16 bytes each); what else a document has is
#: joined with the full tables.
FREQUENT_GRAMS = 1_500_000
FREQUENT_WORDS = 500_000
GATHER = 3_000_000
END = 0xFF


def text_grams(column: pa.Array, depth: int = DEPTH) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, grams, row of each gram) for ranges of rows; a gram packs depth + 1 bytes, the
    newest in the low byte. A row of n bytes has n + 1 grams, the last of the end mark."""
    raw, at = text_buffer(column)
    for a, b in chunks(at):
        sizes = at[a + 1 : b + 1] - at[a:b]
        room = sizes + depth + 1
        starts = np.concatenate(([0], np.cumsum(room)))
        line = np.full(starts[-1], END, np.int64)
        into = np.repeat(starts[:-1] + depth - (at[a:b] - at[a]), sizes) + np.arange(at[b] - at[a])
        line[into] = raw[at[a] : at[b]]
        grams = np.zeros(len(line) - depth, np.int64)
        for j in range(depth + 1):
            grams = (grams << 8) | line[j : len(line) - depth + j]
        # drop the grams that run over into the next row
        keep = np.ones(len(line), bool)
        for j in range(depth):
            keep[starts[:-1] + j] = False
        yield a, b, grams[keep[depth:]], np.repeat(np.arange(b - a), sizes + 1)


def gram_counts(docs: DataFrame, train: Column, depth: int = DEPTH) -> DataFrame:
    """gram, n: counts in training texts; 0 for grams of other texts only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.int64), np.empty(0, np.int64))
            # the low bit tells training grams from others
            return pa.RecordBatch.from_arrays([pa.array(keys >> 1), pa.array(np.where(keys & 1, n, 0))], ["gram", "n"])

        for batch in batches:
            flags = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, _, grams, row in text_grams(batch.column(0), depth):
                held.append((grams << 1) | flags[a + row])
                size += len(grams)
                if size > GATHER:
                    yield flush()
                    held, size = [], 0
        yield flush()
        held = []
        give_back()

    rows = docs.select(F.col("text").cast("string").alias("text"), train.alias("train"))
    return rows.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 0.5: shifted by 8, then Stirling's series."""
    shift = np.zeros_like(x)
    for j in range(8):
        shift += np.log(x + j)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


class Level:
    """Nodes of one depth: counts, estimate of bit 1, ln of own and of mixed block probability, stopping weight."""

    def __init__(self, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.n0, self.n1 = n0, n1
        self.kt = (n1 + 0.5) / (n0 + n1 + 1)
        self.own = _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1.0) - 1.1447298858494002
        self.mixed = self.own if below is None else np.logaddexp(self.own, below) - 0.6931471805599453
        self.stop = np.ones(len(n0)) if below is None else np.minimum(np.exp(self.own - self.mixed - 0.6931471805599453), 1.0)
        self.met = n0 + n1 > 0


def _subtrees(grams: np.ndarray, n: np.ndarray, bit: int, depth: int) -> tuple[np.ndarray, list[Level], list[np.ndarray], np.ndarray]:
    """The trees of one bit position below TOP bytes of context: (order of the grams, levels from TOP to depth, for each
    level the node of each node one deeper (of each gram for the last), the prefix and newest byte of the level-TOP nodes).

    Nodes of every depth are runs in the order of (bits so far, most recent byte, the byte before it, ...).
    """
    newest = grams & 255
    key = ((newest | 256) >> (8 - bit)).astype(np.int64)
    for j in range(1, depth + 1):
        key = (key << 8) | ((grams >> (8 * j)) & 255)
    order = np.argsort(key, kind="stable")
    key, one = key[order], ((newest >> (7 - bit)) & 1)[order]
    n = n[order]
    n0, n1 = np.where(one == 0, n, 0).astype(float), np.where(one == 1, n, 0).astype(float)
    levels, parents, below = [], [], None
    last = np.arange(len(key))  # where each node one deeper begins
    for d in range(depth, TOP - 1, -1):
        cut = key[last] >> (8 * (depth - d))
        start = np.flatnonzero(np.append(True, cut[1:] != cut[:-1]))
        n0, n1 = np.add.reduceat(n0, start), np.add.reduceat(n1, start)
        below = None if below is None else np.add.reduceat(below, start)
        levels.append(Level(n0, n1, below))
        below = levels[-1].mixed
        of = np.zeros(len(last), np.int64)
        of[start] = 1
        parents.append(np.cumsum(of) - 1)
        last = last[start]
    return order, levels[::-1], parents[::-1], key[last] >> (8 * (depth - TOP))


def _gather(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def gram_log_probabilities(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """gram, n, lp: ln of the mixed probability of the gram's newest byte after its others.

    A partition holds whole subtrees below TOP bytes of context (grams are dealt by these bytes); what lies above has
    at most 2^16 nodes and is summed over partitions. A node that training has not met adds no evidence: its nearest
    met ancestor's estimate stands for it, and 1/2 where there is none.
    """
    dealt = counts.repartition(F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * TOP) - 1)))

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, n = _gather(batches)
        if not len(grams):
            return
        for bit in range(8):
            _, levels, _, node = _subtrees(grams, n, bit, depth)
            key = node >> 8  # bits so far, most recent byte
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sums = [np.add.reduceat(x, start) for x in (levels[0].n0, levels[0].n1, levels[0].mixed)]
            yield pa.RecordBatch.from_arrays([pa.array(key[start]), *map(pa.array, sums)], ["key", "n0", "n1", "below"])

    rows = dealt.mapInArrow(tops, "key long, n0 double, n1 double, below double").groupBy("key").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below")).toArrow().to_pandas()  # at most 2^16 rows
    size = 1 << 16
    n0, n1, below = (np.bincount(rows["key"], rows[c], size) for c in ("n0", "n1", "below"))
    one = Level(n0, n1, below)
    zero = Level(n0.reshape(256, 256).sum(axis=1), n1.reshape(256, 256).sum(axis=1), np.where(one.met, one.mixed, 0).reshape(256, 256).sum(axis=1))
    above = dealt.sparkSession.sparkContext.broadcast((zero.kt, zero.stop, zero.met, one.kt, one.stop, one.met))

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, n = _gather(batches)
        if not len(grams):
            return
        kt0, stop0, met0, kt1, stop1, met1 = above.value
        lp = np.zeros(len(grams))
        for bit in range(8):
            order, levels, parents, node = _subtrees(grams, n, bit, depth)
            first = node >> 8
            bits = first >> 8
            done = np.where(met0[bits], stop0[bits] * kt0[bits], 0)
            rest = np.where(met0[bits], 1 - stop0[bits], 1.0)
            last = np.where(met0[bits], kt0[bits], 0.5)
            steps = [(met1[first], stop1[first], kt1[first])] + [(x.met, x.stop, x.kt) for x in levels]
            for k, (met, stop, kt) in enumerate(steps):
                if k > 1:  # to the nodes of this depth
                    of = parents[k - 2]
                    done, rest, last = done[of], rest[of], last[of]
                done = np.where(met, done + rest * stop * kt, done + rest * last)
                rest = np.where(met, rest * (1 - stop), 0.0)
                last = np.where(met, kt, last)
            p1 = np.empty(len(grams))
            p1[order] = done[parents[-1]] + (rest * last)[parents[-1]]
            lp += np.log(np.where((grams >> (7 - bit)) & 1, p1, 1 - p1))
        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n), pa.array(lp)], ["gram", "n", "lp"])

    return dealt.mapInArrow(mix, "gram long, n long, lp double")


class HashTable:
    """Values of 64-bit keys by open addressing in one array; 0 for keys it does not hold."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, values.dtype)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]
            done = self.keys[slot] == keys
            self.values[slot[done]] = values[done]
            keys, values, slot = keys[~done], values[~done], (slot[~done] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        held = self.keys[slot]
        open_ = np.flatnonzero((held != keys) & (held != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            open_ = open_[(held != keys[open_]) & (held != -1)]
        return self.values[slot]


def word_counts(docs: DataFrame, train: Column) -> DataFrame:
    """w, c: hash and count of each word of the training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["w", "c"])

        for batch in batches:
            for _, _, words, _ in word_hashes(batch.column(0)):
                held.append(words)
                size += len(words)
                if size > GATHER:
                    yield flush()
                    held, size = [], 0
        yield flush()
        held = []
        give_back()

    texts = docs.where(train).select(F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def _runs(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, key) in this order: keys, how often, owners."""
    by = np.lexsort((keys, owner))
    keys, owner = keys[by], owner[by]
    start = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[start], np.diff(np.append(start, len(keys))), owner[start]


def score_documents(docs: DataFrame, held_out: Column, depth: int = DEPTH, frequent_grams: int = FREQUENT_GRAMS,
                    frequent_words: int = FREQUENT_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of docs.

    score is the model's log10 probability of the text and its end mark; bits_per_byte the code length over these bytes.

    held_out (never null) tells the rows whose texts are not learnt. Null text counts as empty: no words, one end token.
    With nothing learnt every bit has probability 1/2. Repeated rows are scored each; other columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    grams = materialize(gram_log_probabilities(materialize(gram_counts(docs, ~held_out, depth)), depth))
    words = materialize(word_counts(docs, ~held_out))
    sums = words.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    ends = docs.where(~held_out).count()
    total, distinct = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    per_token, end_log = math.log10(total + 0.5 * (distinct + 1)), math.log10(ends + 0.5)
    some_words, all_words = most_frequent(words, "w", "c", frequent_words)
    some_grams, all_grams = most_frequent(grams, "gram", "n", frequent_grams)
    w, g = some_words.toArrow(), some_grams.select("gram", "lp").toArrow()  # about frequent_words and frequent_grams rows at most
    # the tables themselves go to the tasks (32 to 64 bytes a key), so that a worker holds them once
    model = sc.broadcast((HashTable(w["w"].to_numpy(), w["c"].to_numpy()), HashTable(g["gram"].to_numpy(), g["lp"].to_numpy())))
    del w, g

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count_of, lp_of = model.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            n = batch.num_rows
            tokens, known, base, own = (np.zeros(n) for _ in range(4))
            size = np.diff(text_buffer(batch.column(0))[1]) + 1
            rare: dict[str, list[np.ndarray]] = {"w": [], "wn": [], "g": [], "gn": []}
            cuts = {"w": np.zeros(n + 1, np.int64), "g": np.zeros(n + 1, np.int64)}

            def put(kind: str, keys: np.ndarray, owner: np.ndarray, a: int, b: int, rare=rare, cuts=cuts) -> None:
                keys, times, owner = _runs(keys, owner)
                rare[kind].append(keys)
                rare[kind + "n"].append(times)
                cuts[kind][a + 1 : b + 1] = np.bincount(owner, minlength=b - a)

            for a, b, hashes, first in word_hashes(batch.column(0)):
                hashes, owner = hashes.view(np.int64), np.repeat(np.arange(b - a), np.diff(first))
                count = count_of(hashes)
                tokens[a:b] = np.diff(first) + 1
                known[a:b] = np.bincount(owner, count > 0, b - a) + (ends > 0)
                base[a:b] = np.bincount(owner, np.log10(count + 0.5), b - a) + end_log
                if not all_words:
                    put("w", hashes[count == 0], owner[count == 0], a, b)
            for a, b, found, owner in text_grams(batch.column(0), depth):
                lp = lp_of(found)  # 0 for grams beyond the frequent ones
                own[a:b] = np.bincount(owner, lp, b - a)
                if not all_grams:
                    put("g", found[lp == 0], owner[lp == 0], a, b)
            join = lambda parts: pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64())
            lists = {k: pa.ListArray.from_arrays(pa.array(np.cumsum(cuts[k[0]]).astype(np.int32)), join(v)) for k, v in rare.items()}
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(n)), batch.column(1), batch.column(2), pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64)),
                 pa.array(base - tokens * per_token), pa.array(own / math.log(10)), pa.array(size), *lists.values()],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "bytes", *lists])
            row += n
        give_back()

    slim = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"))
    parts = materialize(slim.mapInArrow(
        score, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, bytes long, "
        "w array<long>, wn array<long>, g array<long>, gn array<long>"))
    model.destroy()
    out = parts.drop("w", "wn", "g", "gn")
    each = lambda k: parts.select("row", F.explode(F.arrays_zip(k, k + "n")).alias("r")).select("row", F.col(f"r.{k}").alias("key"), F.col(f"r.{k}n").alias("times"))
    if not all_words:  # the counts of other words
        more = each("w").join(words, F.col("key") == F.col("w")).groupBy("row").agg(
            F.sum("times").alias("more_known"), F.sum(F.col("times") * (F.log10(F.col("c") + 0.5) - math.log10(0.5))).alias("more_base"))
        out = out.join(more, "row", "left")
    else:
        out = out.withColumns({"more_known": F.lit(0), "more_base": F.lit(0.0)})
    if not all_grams:
        more = each("g").join(grams, F.col("key") == F.col("gram")).groupBy("row").agg((F.sum(F.col("times") * F.col("lp")) / math.log(10)).alias("more_score"))
        out = out.join(more, "row", "left")
    else:
        out = out.withColumn("more_score", F.lit(0.0))
    plus = lambda a, b, kind: (F.col(a) + F.coalesce(b, F.lit(0))).cast(kind)
    return out.select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "more_known", "long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        plus("base", "more_base", "double").alias("base_score"), plus("score", "more_score", "double").alias("score"),
        (plus("score", "more_score", "double") * (-math.log2(10)) / F.col("bytes")).alias("bits_per_byte"))


def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) == 1)


QUERIES = {"op4_context_tree": op4_context_tree}
ORACLE_SQL: dict[str, str] = {}
