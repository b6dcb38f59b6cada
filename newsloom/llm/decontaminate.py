"""Benchmark decontamination by size-partitioned containment MinHash.

Test items are partitioned by their number of distinct five-word shingles. A partition's sketch keeps the k smallest
hashes of each item, k = n - ceil(t n) + 1 for n shingles: a document that contains at least a share t of an item must
hold one of these k (only n - ceil(t n) may be missing), so the sketch finds every contained item, however long the
document is. A document probes the sketches of the partitions whose items it is large enough to contain; what it meets
there are its candidates, and only these are verified, by the exact containment over all shingles of item and document.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import give_back, join_ids, materialize, table
from newsloom.llm.words import shingle_sets

THRESHOLD = 0.75
#: Items with this many shingles in all go to every task (about 24 bytes a shingle); beyond it they are joined.
BROADCAST_SHINGLES = 2_000_000
#: Bits of the filter over the sketches' hashes (2 MB) that documents' shingles pass before they are joined.
FILTER_BITS = 1 << 24


def item_shingles(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """item_id, h, n, size_class (of items with 2^c to 2^(c+1) - 1 shingles), in_sketch. Null and empty texts have none."""
    at = round(threshold * 1_000_000)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, sizes, sketch = [], [], [], []
            for item, own in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True):
                n = len(own)
                k = n - -(-at * n // 1_000_000) + 1
                ids += [item] * n
                hashes.append(own.view(np.int64))
                sizes += [n] * n
                sketch += [i < k for i in range(n)]  # ascending hashes: the k smallest
            flat = np.concatenate(hashes) if hashes else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(flat), pa.array(sizes, pa.int64()), pa.array(sketch, pa.bool_())], ["item_id", "h", "n", "in_sketch"])

    slim = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    cutted = slim.mapInArrow(cut, "item_id long, h long, n long, in_sketch boolean")
    return cutted.withColumn("size_class", F.floor(F.log2("n")).cast("int"))


class Sketches:
    """Items by size class: the sketches' hashes, sorted, with the item of each; and every item's whole set."""

    def __init__(self, item: np.ndarray, h: np.ndarray, n: np.ndarray, size_class: np.ndarray, in_sketch: np.ndarray, threshold: float):
        self.at = round(threshold * 1_000_000)
        _, item = np.unique(np.rec.fromarrays([item, n]), return_inverse=True)  # one item_id may have several texts
        by = np.lexsort((h.view(np.uint64), item))
        self.cuts = np.searchsorted(item[by], np.arange(int(item.max()) + 2 if len(item) else 1))
        self.h = h.view(np.uint64)[by]
        self.classes = []
        for c in sorted(set(size_class.tolist())):
            of = np.flatnonzero((size_class == c) & in_sketch)
            of = of[np.argsort(h[of].view(np.uint64), kind="stable")]
            self.classes.append((-(-self.at * (1 << c) // 1_000_000), h[of].view(np.uint64), item[of]))

    def candidates(self, own: np.ndarray) -> np.ndarray:
        """Items (numbers) of which a document with these shingles, ascending, meets the sketch."""
        met = []
        for least, hashes, items in self.classes:
            if len(own) < least:  # too small for any item of this class and of larger ones
                break
            if len(hashes) > 4 * len(own):
                low, high = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
                met += [items[a:b] for a, b in zip(low[high > low], high[high > low], strict=True)]
            else:
                at = np.searchsorted(own, hashes)
                at[at == len(own)] = 0
                met.append(items[own[at] == hashes])
        return np.unique(np.concatenate(met)) if met else np.empty(0, np.int64)

    def contained(self, own: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, shingles shared, shingles of the item) of each contained item."""
        out = []
        for i in self.candidates(own).tolist():
            whole = self.h[self.cuts[i] : self.cuts[i + 1]]
            at = np.searchsorted(own, whole)
            at[at == len(own)] = 0
            shared = int((own[at] == whole).sum())
            if shared * 1_000_000 >= len(whole) * self.at:
                out.append((i, shared, len(whole)))
        return out


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment for every pair whose containment of the item's shingle set in the
    document's is at least `threshold`.

    Null and empty texts have no shingles and are in no pair. Rows that repeat a doc_id are matched each by itself and
    give equal pairs once; repeated item rows likewise. Items whose id is null, and other columns, are ignored; empty
    tables give no rows.
    """
    parts = materialize(item_shingles(items.where("item_id IS NOT NULL"), threshold).distinct())
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _in_tasks(slim, parts, threshold) if parts.count() <= broadcast_shingles else _joined(slim, parts, threshold)
    return found.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment")).distinct()


def _in_tasks(slim: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    own = parts.toArrow()  # at most broadcast_shingles rows
    columns = [own[c].to_numpy() for c in ("item_id", "h", "n", "size_class", "in_sketch")]
    names = np.unique(np.rec.fromarrays([columns[0], columns[2]]))["f0"] if len(columns[0]) else np.empty(0, np.int64)
    sketches = slim.sparkSession.sparkContext.broadcast((Sketches(*columns, threshold), names))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, item_ids = sketches.value
        for batch in batches:
            rows = [(i, *hit) for i, own in enumerate(shingle_sets(batch.column(1))) for hit in known.contained(own)]
            at, item, shared, n = np.array(rows, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(item_ids[item]), pa.array(shared), pa.array(n)], ["doc_id", "item_id", "n_shared", "n_item"])
        give_back()

    return slim.mapInArrow(match, "doc_id long, item_id long, n_shared long, n_item long")


def _joined(slim: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """The same where the items are too many for every task. A bitmap of the sketches' hashes goes to the tasks, and only
    shingles that pass it are joined with the sketches; then the candidates' documents are joined with the candidates."""
    at = round(threshold * 1_000_000)
    place = F.pmod(F.col("h"), F.lit(FILTER_BITS))
    words = parts.where("in_sketch").groupBy(F.shiftright(place.cast("long"), 5).alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {FILTER_BITS}) % 32 AS INT))")).alias("bits")).toArrow()  # FILTER_BITS / 32 rows at most
    bitmap = np.zeros(FILTER_BITS // 32, np.uint32)
    bitmap[words["w"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    passing = slim.sparkSession.sparkContext.broadcast(bitmap)
    schema = "doc_id long, tag binary, size long, h long"

    def shingles(filtered: bool):
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, tags, sizes, hashes = [], [], [], []
                for i, own in enumerate(shingle_sets(batch.column(1))):
                    bit = (own.view(np.int64) % FILTER_BITS).astype(np.int64)
                    kept = own[(passing.value[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 > 0] if filtered else own
                    rows.append(np.full(len(kept), i))
                    # a row of docs is told from another with its id by its set
                    tags += [blake2b(own.tobytes(), digest_size=8).digest()] * len(kept)
                    sizes.append(np.full(len(kept), len(own)))
                    hashes.append(kept.view(np.int64))
                flat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(flat(rows))), pa.array(tags, pa.binary()), pa.array(flat(sizes)), pa.array(flat(hashes))], ["doc_id", "tag", "size", "h"])
            give_back()

        return cut

    sketch = parts.where("in_sketch").select("h", "item_id", "n", "size_class")
    large_enough = F.expr(f"size >= ceil({at} * shiftleft(1L, size_class) / 1000000)")
    candidates = materialize(slim.mapInArrow(shingles(True), schema).join(sketch, "h").where(large_enough).select("doc_id", "tag", "item_id", "n").distinct())
    ids = materialize(candidates.where("doc_id IS NOT NULL").select("doc_id").distinct())
    again = join_ids(slim, ids, "doc_id", "left_semi").unionByName(slim.where("doc_id IS NULL")).mapInArrow(shingles(False), schema).drop("size").distinct()
    same = again["doc_id"].eqNullSafe(candidates["doc_id"]) & (again["tag"] == candidates["tag"])
    pairs = candidates.join(again, same).select(candidates["doc_id"], candidates["tag"], "item_id", "n", "h").join(parts.select("item_id", "n", "h"), ["item_id", "n", "h"])
    shared = pairs.groupBy("doc_id", "tag", "item_id", F.col("n").alias("n_item")).agg(F.count("*").alias("n_shared"))
    return shared.where(F.col("n_shared") * 1_000_000 >= F.col("n_item") * at)


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that contain an item; all columns stay. Rows with a null doc_id cannot be named and stay."""
    hit = materialize(contained_items(docs, items, threshold).where("doc_id IS NOT NULL").select("doc_id").distinct())
    return join_ids(docs, hit, "doc_id", "left_anti").select(*docs.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contaminated document with each item that it contains."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
SHINGLES_SQL = (
    "SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))"
    " WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s"
)
QUERIES = {"op2_decontaminate": op2_decontaminate}
ORACLE_SQL = {
    "op2_decontaminate": f"""
WITH d AS (SELECT doc_id AS id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id AS id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
ds AS ({SHINGLES_SQL} FROM d), bs AS ({SHINGLES_SQL} FROM b), n AS (SELECT id, count(*) AS n_item FROM bs GROUP BY id),
p AS (SELECT ds.id AS doc_id, bs.id AS item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM p JOIN n ON n.id = item_id
WHERE 100 * n_shared >= 75 * n_item"""
}
