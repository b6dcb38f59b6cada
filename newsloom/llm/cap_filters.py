"""Near-duplicate vectors by spherical-cap filters.

Filters are the directions of structured random product codes: a vector is rotated at random and cut into PARTS parts, each
part has its own code of random directions, and a filter is one direction of each. A vector belongs to all filters whose inner
product with it reaches `alpha`; they are decoded part by part, leaving a branch as soon as the best of the rest cannot reach
it. Vectors that share a filter meet there and are verified. Each of CODES codes has about as many filters as there are vectors,
so that unrelated vectors rarely meet at any size of the input; `alpha` is where simulated pairs at the very threshold share a
filter of some code in RECALL of all cases (closer pairs more often). Measured recall is in README.

Groups of near copies can hold a third of all vectors and would fill their filters. Before filtering, vectors of one nearest
filter are gathered in balls around one of them, whose radius is below half the threshold's angle: all pairs in a ball link
for certain, without being looked at. A ball takes part as one entity, in every filter of any of its members. Two entities
whose pivots and radii tell that all or no pairs of their members link are settled so; the pairs in doubt are measured,
member by member, in blocks. Within a filter only entities meet; a filter with many is cut into blocks that meet each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import drop_folder, give_back, materialize, small, table, write_table
from newsloom.llm.jaccard_join import components

COSINE, RECALL, CODES, PARTS, SEED = 0.9, 0.95, 8, 2, 11
#: Entities of a filter in one task's block; members of a ball in one block.
BLOCK, MEMBERS = 2048, 256
#: A ball's radius as a part of the threshold's angle: below one half, so that any two members link.
RADIUS = 0.49
#: Rounds that look for further balls among what a cell has left, where that is more than a block.
ROUNDS = 3
#: Pivots (some 600 bytes each) go to every task up to this number; beyond it they are joined.
BROADCAST_PIVOTS = 20_000
#: Angles from double cosines are this exact at least.
SLACK = 1e-6


class ProductCodes:
    """Random directions of `dim` dimensions in several codes, each direction the concatenation of one of `size` for every part."""

    def __init__(self, dim: int, filters: int, codes: int = CODES, parts: int = PARTS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.parts, self.width = parts, max(2, -(-dim // parts))
        self.size = max(2, math.ceil(filters ** (1 / parts) - 1e-9))
        whole = self.width * parts
        self.rotations = [np.linalg.qr(rng.normal(size=(whole, whole)))[0][:dim].astype(np.float32) for _ in range(codes)]
        own = rng.normal(size=(codes, parts, self.size, self.width))
        self.codes = (own / np.linalg.norm(own, axis=3, keepdims=True) / math.sqrt(parts)).astype(np.float32)

    def turned(self, units: np.ndarray) -> np.ndarray:
        return units.astype(np.float32) @ self.rotations[0]

    def _inner(self, units: np.ndarray, code: int) -> np.ndarray:
        """parts x vectors x size."""
        turned = units.astype(np.float32) @ self.rotations[code]
        return turned.reshape(len(units), self.parts, self.width).transpose(1, 0, 2) @ self.codes[code].transpose(0, 2, 1)

    def nearest(self, units: np.ndarray) -> np.ndarray:
        """The filter of the first code with the greatest inner product."""
        out = np.zeros(len(units), np.int64)
        for best in self._inner(units, 0).argmax(axis=2):
            out = out * self.size + best
        return out

    def decode(self, units: np.ndarray, alpha: float, rows: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """(vector, filter) of all filters whose inner product with the vector is alpha at least."""
        at, ids = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for first in range(0, len(units), rows):
            for code in range(len(self.codes)):
                inner = self._inner(units[first : first + rows], code)
                rest = np.zeros((self.parts + 1, inner.shape[1]), np.float32)
                rest[:-1] = inner.max(axis=2)[::-1].cumsum(axis=0)[::-1]
                row = (rest[0] >= alpha).nonzero()[0]
                total, filt = np.zeros(len(row), np.float32), np.full(len(row), code, np.int64)
                for part in range(self.parts):
                    reached = total[:, None] + inner[part, row]
                    keep, c = (reached + rest[part + 1, row][:, None] >= alpha).nonzero()
                    row, total, filt = row[keep], reached[keep, c], filt[keep] * self.size + c
                at.append(row + first)
                ids.append(filt)
        return np.concatenate(at), np.concatenate(ids)

    def found(self, a: np.ndarray, b: np.ndarray, alpha: float) -> float:
        """The share of pairs of rows of a and b that have a filter in common."""
        keys, filters = [], len(self.codes) * self.size**self.parts
        for x in (a, b):
            at, filt = self.decode(x, alpha)
            keys.append(at * filters + filt)
        return len(np.unique(np.intersect1d(*keys, assume_unique=True) // filters)) / max(1, len(a))

    def calibrate(self, cosine: float, recall: float, pairs: int = 1000) -> float:
        """The greatest alpha (to 1/128) at which random pairs of that cosine share a filter so often."""
        rng = np.random.default_rng(SEED + 1)
        a, b = rng.normal(size=(2, pairs, len(self.rotations[0])))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
        b = cosine * a + math.sqrt(1 - cosine**2) * b
        alpha = 1.0
        while alpha > -1 and self.found(a, b, alpha) < recall:
            alpha -= 1 / 128
        return alpha


def _units(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a binary column of dim doubles each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _unit_vectors(df: DataFrame, dim: int) -> DataFrame:
    """vec_id, u: the vector scaled to length 1 as bytes of dim doubles (shorter ones end in zeros); null where the vector is
    null, zero or holds null or non-finite components."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            wide = np.zeros((batch.num_rows, dim))
            sizes, flat = np.diff(column.offsets.to_numpy()), column.values.to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(len(sizes)), sizes)
            first = column.offsets.to_numpy()
            wide[at, np.arange(len(at)) - np.repeat(first[:-1] - first[0], sizes)] = flat[first[0] : first[-1]]
            good = column.is_valid().to_numpy(zero_copy_only=False) & np.isfinite(wide).all(axis=1)  # a null component is no number
            wide[~good] = 0
            wide /= np.maximum(np.abs(wide).max(axis=1, keepdims=True, initial=0), 5e-324)  # no overflow in squares
            length = np.linalg.norm(wide, axis=1)
            good &= length > 0
            units = wide / np.where(good, length, 1)[:, None]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([u.tobytes() if g else None for u, g in zip(units, good, strict=True)], pa.binary())], ["vec_id", "u"])

    return df.mapInArrow(rows, "vec_id long, u binary")


def _gather(vectors: DataFrame, dim: int, code: ProductCodes, radius: float, block: int, rounds: int) -> DataFrame:
    """vec_id, row, u, ent, rho: vectors (with their cell) in balls. ent: the row of the ball's pivot, itself a member; a
    vector alone is its own."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, pivot = batch.column("row").to_numpy(), batch.column("pivot").to_numpy(zero_copy_only=False)
                u, held = _units(batch.column("u"), dim), ~np.isnan(pivot)
                rho = np.full(len(u), np.inf)
                rho[held] = _angle((u[held] * _units(batch.column("pu").filter(pa.array(held)), dim)).sum(axis=1))
                rho[held & (pivot == own)] = 0
                fits = rho <= radius
                alone = [pa.array(x) for x in (np.where(fits, pivot, own).astype(np.int64), np.where(fits, rho, 0.0), fits)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "row", "u", "cell")), *alone],
                                                 ["vec_id", "row", "u", "cell", "ent", "rho", "fits"])
        give_back()

    spark = vectors.sparkSession
    left, done, held = vectors, [], []
    for r in range(rounds):
        full = left.groupBy("cell").agg(F.min("row").alias("pivot"), F.count("*").alias("rows")).where(F.col("rows") > (1 if r == 0 else block))
        full = materialize(full.select("cell", "pivot"))
        n = full.count()
        if r and not n:
            break
        pivots = left.join(F.broadcast(full) if n <= BROADCAST_PIVOTS else full, "cell").where("row = pivot").select("cell", "pivot", F.col("u").alias("pu"))
        met = left.join(F.broadcast(pivots) if n <= BROADCAST_PIVOTS else pivots, "cell", "left")
        out, path = write_table(met.select("vec_id", "row", "u", "cell", F.col("pivot").cast("double").alias("pivot"), "pu").mapInArrow(
            near, "vec_id long, row long, u binary, cell long, ent long, rho double, fits boolean"))
        done.append(out.where("fits"))
        left, held = out.where("NOT fits").select("vec_id", "row", "u", "cell"), [*held, path]
    whole = left.withColumn("ent", F.col("row")).withColumn("rho", F.lit(0.0))
    for df in done:
        whole = whole.unionByName(df.drop("fits"))
    if len(held) == 1:
        return whole.drop("cell")
    whole = materialize(whole.drop("cell"))
    for path in held:
        drop_folder(spark, path)
    return whole


def _meet(entries: DataFrame, dim: int, cosine: float) -> DataFrame:
    """a, b: entities of one filter whose pivots are near enough for a link of their members, by rounded vectors and their
    error's bound. entries are dealt and sorted by flt, lo, hi; where lo and hi differ, only blocks lo and hi meet."""
    angle, tile = math.acos(cosine), 1024

    def limit(reach: np.ndarray, error: np.ndarray) -> np.ndarray:
        return np.cos(np.minimum(angle + reach, np.pi)) - error - 1e-5

    def pairs(runs: np.ndarray, ent: np.ndarray, block: np.ndarray, cross: np.ndarray, q: np.ndarray, err: np.ndarray, reach: np.ndarray):
        """Pairs of rows within runs, given by their first rows and the end."""
        sizes = np.diff(runs)
        run_end = np.repeat(runs[1:], sizes)
        little = np.repeat(sizes <= 64, sizes)
        for step in range(1, int(sizes[sizes <= 64].max(initial=1))):  # rows of short runs with the row `step` later
            i = (little & (np.arange(len(ent)) + step < run_end)).nonzero()[0]
            for k in range(0, len(i), 1 << 16):
                x = i[k : k + (1 << 16)]
                y = x + step
                good = np.einsum("ij,ij->i", q[x], q[y]) >= limit(reach[x] + reach[y], err[x] + err[y] + err[x] * err[y])
                good &= ~cross[x] | (block[x] != block[y])
                yield ent[x[good]], ent[y[good]]
        for lo, hi in zip(runs[:-1][sizes > 64], runs[1:][sizes > 64], strict=True):
            for i in range(lo, hi, tile):
                for j in range(i, hi, tile):
                    x, y = np.arange(i, min(hi, i + tile)), np.arange(j, min(hi, j + tile))
                    good = q[x] @ q[y].T >= limit(reach[x][:, None] + reach[y], err[x][:, None] + err[y] + err[x][:, None] * err[y])
                    good &= (x[:, None] < y) & (~cross[x][:, None] | (block[x][:, None] != block[y]))
                    x, y = good.nonzero()
                    yield ent[i + x], ent[j + y]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda c: batch.column(c).to_numpy()
            q = np.frombuffer(b"".join(batch.column("q").to_pylist()), np.int8).reshape(batch.num_rows, -1).astype(np.float32) * col("scale")[:, None]
            new = [col("flt"), col("lo"), col("hi"), col("ent"), col("block"), q, col("err").astype(float), col("reach")]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            key = np.column_stack(held[:3])
            changes = np.append(0, (key[1:] != key[:-1]).any(axis=1).nonzero()[0] + 1)
            if len(changes) > 1:
                yield from out(held, changes)
                held = [x[changes[-1] :] for x in held]
        if held is not None:
            yield from out(held, np.array([0, len(held[0])]))
        give_back()

    def out(held: list[np.ndarray], runs: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, lo, hi, ent, block, q, err, reach = [x[: runs[-1]] for x in held]
        for x, y in pairs(runs, ent, block, lo != hi, q, err, reach):
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    dealt = entries.repartition("flt", "lo", "hi").sortWithinPartitions("flt", "lo", "hi")
    return dealt.mapInArrow(rows, "a long, b long")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK, members: int = MEMBERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings.

    Vectors that are null, zero or hold null or non-finite components link with nothing and are their own component. Shorter
    vectors count as ending in zeros. Rows that repeat a vec_id are vectors each; a null vec_id links as any other and has
    the least known id of its component. Links reported have cosine >= `cosine` in double precision; see the module for those
    found. An empty table gives no rows; other columns are ignored. cosine: above 0.
    """
    spark = embeddings.sparkSession
    slim = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    dim = max(1, slim.agg(F.max(F.size("e"))).first()[0] or 1)
    vectors = materialize(_unit_vectors(slim, dim).withColumn("row", F.monotonically_increasing_id()))
    n = vectors.where("u IS NOT NULL").count()
    code, angle = ProductCodes(dim, max(16, n)), math.acos(cosine)
    alpha = code.calibrate(cosine, recall)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = code.nearest(_units(batch.column("u"), dim))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["vec_id", "row", "u", "cell"])
        give_back()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """flt, ent of ent, u."""
        for batch in batches:
            if batch.num_rows:
                at, flt = code.decode(_units(batch.column("u"), dim), alpha)
                yield pa.RecordBatch.from_arrays([pa.array(flt), batch.column("ent").take(pa.array(at))], ["flt", "ent"])
        give_back()

    def rounded(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scale = (np.abs(turned).max(axis=1) / 127).astype(np.float32)
        q = np.rint(turned / np.maximum(scale, 1e-30)[:, None]).astype(np.int8)
        return q, scale, (np.linalg.norm(turned - q * scale[:, None], axis=1) + 1e-6).astype(np.float32)

    entry = "flt long, ent long, q binary, scale float, err float, reach double"

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All filters of ent, u, reach, each with the rounded vector; or the one given as flt."""
        for batch in batches:
            if not batch.num_rows:
                continue
            units = _units(batch.column("u"), dim)
            at, flt = (np.arange(len(units)), batch.column("flt").to_numpy()) if "flt" in batch.schema.names else code.decode(units, alpha)
            q, scale, err = rounded(code.turned(units))
            q = _packed(q)
            for k in range(0, len(at), 1 << 15):
                x = at[k : k + (1 << 15)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flt[k : k + (1 << 15)]), batch.column("ent").take(pa.array(x)), q.take(pa.array(x)), pa.array(scale[x]), pa.array(err[x]),
                     batch.column("reach").take(pa.array(x))], ["flt", "ent", "q", "scale", "err", "reach"])
        give_back()

    found = vectors.where("u IS NOT NULL").select("vec_id", "row", "u").mapInArrow(cells, "vec_id long, row long, u binary, cell long")
    found = _gather(materialize(found), dim, code, angle * RADIUS, block, rounds)
    balls = found.groupBy("ent").agg(F.count("*").alias("n"), F.max("rho").alias("reach")).where("n > 1")
    balls = materialize(balls)
    of_ball = small(balls)
    pivots = found.where("row = ent").select("ent", "u").join(of_ball, "ent", "left").select(
        "ent", "u", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("reach", F.lit(0.0)).alias("reach"))
    alone = pivots.where("n = 1").select("ent", "u", "reach")
    in_balls = found.join(small(balls.select("ent")), "ent", "left_semi").select("ent", "u")
    shared = materialize(in_balls.mapInArrow(decoded, "flt long, ent long").distinct())
    counts = alone.select("ent", "u").mapInArrow(decoded, "flt long, ent long").unionByName(shared).groupBy("flt").count()
    hot = materialize(counts.where(F.col("count") > block).select("flt", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    every = alone.mapInArrow(entries, entry).unionByName(
        shared.join(pivots.where("n > 1").select("ent", "u", "reach"), "ent").select("ent", "u", "reach", "flt").mapInArrow(entries, entry))
    every = every.join(small(hot), "flt", "left").withColumn("block", F.pmod(F.xxhash64("ent"), F.coalesce("blocks", F.lit(1))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    every = every.withColumn("other", other).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    pairs = materialize(_meet(every.drop("other", "blocks"), dim, cosine).distinct())

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of entities with links: all of their members' pairs, or such as must be measured."""
        for batch in batches:
            if not batch.num_rows:
                continue
            inner = (_units(batch.column("ua"), dim) * _units(batch.column("ub"), dim)).sum(axis=1)
            na, nb, reach = batch.column("na").to_numpy(), batch.column("nb").to_numpy(), batch.column("reach").to_numpy()
            one, apart = (na == 1) & (nb == 1), _angle(inner)
            whole = np.where(one, inner >= cosine, apart + reach <= angle - SLACK)
            doubt = ~one & ~whole & (apart - reach <= angle + SLACK)
            keep = pa.array(whole | doubt)
            cut = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "na", "nb")), pa.array(whole)], ["a", "b", "na", "nb", "whole"])
            yield cut.filter(keep)
        give_back()

    side = lambda x: pivots.select(F.col("ent").alias(x), F.col("u").alias(f"u{x}"), F.col("n").alias(f"n{x}"), F.col("reach").alias(f"r{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ua", "ub", "na", "nb", (F.col("ra") + F.col("rb")).alias("reach"))
    met = materialize(both.mapInArrow(settled, "a long, b long, na long, nb long, whole boolean"))
    whole, doubt = met.where("whole"), met.where("NOT whole")
    edges, counted = whole.select("a", "b"), None
    if not doubt.isEmpty():
        edge, counted = _measured(doubt, found, dim, cosine, members)
        edges = edges.unionByName(edge)
    roots = components(edges)
    more = whole.select(F.col("a").alias("ent"), F.col("nb").alias("links")).unionByName(whole.select(F.col("b").alias("ent"), F.col("na").alias("links")))
    null = lambda kind: F.lit(None).cast(kind)
    about = (
        more.withColumn("root", null("long"))
        .unionByName(balls.select("ent", (F.col("n") - 1).alias("links"), null("long").alias("root")))
        .unionByName(roots.select(F.col("node").alias("ent"), F.lit(0).cast("long").alias("links"), "root"))
        .unionByName(roots.select(F.col("root").alias("ent"), F.lit(0).cast("long").alias("links"), "root"))
        .groupBy("ent").agg(F.sum("links").alias("links"), F.coalesce(F.max("root"), F.col("ent")).alias("root"))
    )
    about = materialize(about)
    linked = found.select("vec_id", "row", "ent").join(small(about), "ent", "left")
    least = linked.where("root IS NOT NULL").groupBy("root").agg(F.min("vec_id").alias("component"))
    about = materialize(about.join(least, "root").select("ent", "links", "component", F.lit(True).alias("linked")))
    linked = found.select("vec_id", "row", "ent").join(small(about), "ent", "left")
    if counted is not None:
        linked = linked.join(small(counted), "row", "left").withColumn("links", F.coalesce("links", F.lit(0)) + F.coalesce("n_measured", F.lit(0)))
    out = linked.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.when(F.col("linked"), F.col("component")).otherwise(F.col("vec_id")).alias("component_id"))
    out = out.unionByName(vectors.where("u IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _measured(doubt: DataFrame, found: DataFrame, dim: int, cosine: float, size: int) -> tuple[DataFrame, DataFrame]:
    """Of pairs of entities in doubt (a, b, na, nb): those with a link (a, b), and how many links each member has (row, n_measured)."""
    ents = materialize(doubt.select(F.col("a").alias("ent"), F.col("na").alias("n")).unionByName(doubt.select(F.col("b").alias("ent"), F.col("nb").alias("n"))).distinct())
    own = found.select("ent", "row", "u").join(small(ents), "ent")
    blocks = materialize(
        own.withColumn("block", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / size)).cast("int"))
        .groupBy("ent", "block").agg(F.collect_list(F.struct("row", "u")).alias("m")).select("ent", "m.row", "m.u"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, rows, links = [], [], [], []
            for x, y, rx, ux, ry, uy in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "rx", "ux", "ry", "uy")), strict=True):
                at = lambda u: np.frombuffer(b"".join(u), np.float64).reshape(-1, dim)
                close = at(ux) @ at(uy).T >= cosine
                for own_rows, n in ((rx, close.sum(axis=1)), (ry, close.sum(axis=0))):
                    some = n.nonzero()[0]
                    a, b, rows, links = a + [x] * len(some), b + [y] * len(some), rows + [own_rows[i] for i in some], links + n[some].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, rows, links)], ["a", "b", "row", "links"])
        give_back()

    side = lambda x, k: blocks.select(F.col("ent").alias(x), F.col("row").alias(f"r{k}"), F.col("u").alias(f"u{k}"))
    out = doubt.select("a", "b").join(side("a", "x"), "a").join(side("b", "y"), "b").mapInArrow(counts, "a long, b long, row long, links long")
    out = materialize(out.groupBy("a", "b", "row").agg(F.sum("links").alias("links")))
    return out.select("a", "b").distinct(), materialize(out.groupBy("row").agg(F.sum("links").alias("n_measured")))


def op11_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_cap_filters": op11_cap_filters}
ORACLE_SQL = {
    "op11_cap_filters": """
WITH RECURSIVE e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v,
    coalesce(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS good FROM embeddings),
l AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.r <> b.r AND a.good AND b.good AND list_cosine_similarity(a.v, b.v) >= 0.9),
w AS (SELECT r AS root, r AS node FROM e UNION SELECT w.root, l.b FROM w JOIN l ON l.a = w.node),
c AS (SELECT w.node, min(e.vec_id) AS component_id FROM w JOIN e ON e.r = w.root GROUP BY w.node)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.r) AS n_links, c.component_id, e.vec_id IS NOT DISTINCT FROM c.component_id AS kept
FROM e JOIN c ON c.node = e.r"""
}
