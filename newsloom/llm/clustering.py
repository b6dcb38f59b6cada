"""Exact k-means over whole-number vectors with Elkan's bounds.

Every vector carries an upper bound of the distance to its centroid and a lower bound for each of the k centroids. A round
first moves the bounds by how far the centroids moved, then skips each centroid whose lower bound, or whose half distance
to the vector's own centroid, is greater than the upper bound. What is left is measured exactly, in whole numbers.

Ties go to the smaller number. A centroid is skipped only where it is strictly farther: upper bounds are rounded up, lower
bounds and half distances down, and equality is measured. So the result is that of measuring everything.

The vectors and their bounds are one table of the shared store, read and written once a round; the table of the round before
is deleted. Centroid sums are kept on the driver (k x dimensions numbers) and corrected by the vectors that changed cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import drop_folder, give_back, table, write_table

CLUSTERS, ROUNDS, DIM, SCALE = 40, 5, 64, 256
#: Components must be below it in size: squared distances of DIM components then fit 64 bits.
LARGEST = 1 << 27
#: Below it products and squared distances are doubles that hold them exactly.
IN_DOUBLES = 1 << 22
STATE = "vec_id long, x binary, was int, cluster int, upper double, lower binary, distance long"


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _root_down(squared: np.ndarray) -> np.ndarray:
    """Square roots of whole numbers up to 2^63, rounded down."""
    return np.nextafter(np.sqrt(np.nextafter(squared.astype(float), 0)), 0)


def _root_up(squared: np.ndarray) -> np.ndarray:
    return _up(np.sqrt(_up(squared.astype(float))))


class Centroids:
    """What a task needs to know of the centroids: themselves, half their distances, how far they moved."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None):
        self.points, k = now, len(now)
        gaps = now[:, None, :] - now[None, :, :]
        self.half = _root_down((gaps * gaps).sum(axis=2)) / 2
        apart = self.half.copy()
        apart[np.arange(k), np.arange(k)] = np.inf
        self.nearest = apart.min(axis=1)
        moved = np.zeros((k, 1), np.int64) if before is None else now - before
        self.moved = np.where((moved != 0).any(axis=1), _root_up((moved * moved).sum(axis=1)), 0.0)


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, at: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """cluster, upper, lower after the centroids moved, and how many distances were measured.

    x: rows of whole numbers. cluster, upper, lower: of the round before; any cluster with infinity and zeros to begin.
    """
    k, exact = len(at.points), np.abs(x).max(initial=0) < IN_DOUBLES and np.abs(at.points).max() < IN_DOUBLES
    kind = np.float64 if exact else np.int64
    x, points = x.astype(kind), at.points.astype(kind)
    squares, measured = (x * x).sum(axis=1), 0

    def measure(rows: np.ndarray, c: np.ndarray | int) -> np.ndarray:
        nonlocal measured
        measured += len(rows)
        if isinstance(c, int):
            both = x[rows] @ points[c]
            return (squares[rows] - 2 * both + points[c] @ points[c]).astype(np.int64)
        gap = x[rows] - points[c]
        return (gap * gap).sum(axis=1).astype(np.int64)

    cluster, upper = cluster.copy(), np.where(at.moved[cluster] > 0, _up(upper + at.moved[cluster]), upper)
    lower = np.where(at.moved > 0, np.maximum(np.nextafter(lower - at.moved, -np.inf), 0), lower)
    rows = (~(upper < at.nearest[cluster])).nonzero()[0]
    open_ = ~(upper[rows, None] < lower[rows]) & ~(upper[rows, None] < at.half[cluster[rows]])
    open_[np.arange(len(rows)), cluster[rows]] = False
    rows = rows[open_.any(axis=1)]
    best = measure(rows, cluster[rows])
    upper[rows], lower[rows, cluster[rows]] = _root_up(best), _root_down(best)
    for c in range(k):
        own = cluster[rows]
        some = ((own != c) & ~(upper[rows] < lower[rows, c]) & ~(upper[rows] < at.half[own, c])).nonzero()[0]
        if not len(some):
            continue
        found = measure(rows[some], c)
        lower[rows[some], c] = _root_down(found)
        closer = (found < best[some]) | (found == best[some]) & (c < own[some])
        some = some[closer]
        best[some], cluster[rows[some]], upper[rows[some]] = found[closer], c, _root_up(found[closer])
    return cluster, upper, lower, measured


def _floats_down(lower: np.ndarray) -> np.ndarray:
    """Doubles as 32-bit floats that are no greater."""
    out = lower.astype(np.float32)
    return np.where(out > lower, np.nextafter(out, np.float32(-np.inf)), out)


def _round(df: DataFrame, at: Centroids, scale: int, dim: int, last: bool) -> DataFrame:
    """The next state of df: a state, or (to begin) vec_id and v, an array of doubles."""
    k = len(at.points)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if batch.num_columns == 2:
                with np.errstate(over="ignore"):
                    wide = np.floor(batch.column(1).flatten().to_numpy().reshape(n, dim) * scale)
                if np.abs(wide).max() >= LARGEST:
                    raise ValueError(f"a component leaves the {LARGEST} that exact distances allow")
                x, cluster, upper, lower = wide.astype(np.int64), np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, k))
                was = np.full(n, -1)
            else:
                held = lambda c, kind, width: np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(n, width)
                x, was = held("x", "<i4", dim).astype(np.int64), batch.column("cluster").to_numpy()
                cluster, upper, lower = was.astype(np.int64), batch.column("upper").to_numpy(), held("lower", "<f4", k).astype(float)
            cluster, upper, lower, _ = assign(x, cluster, upper, lower, at)
            gap = x - at.points[cluster]
            distance = (gap * gap).sum(axis=1) if last else np.zeros(n, np.int64)
            pack = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pack(x.astype("<i4")), pa.array(was, pa.int32()), pa.array(cluster, pa.int32()), pa.array(upper),
                 pack(_floats_down(lower)), pa.array(distance)], ["vec_id", "x", "was", "cluster", "upper", "lower", "distance"])
        give_back()

    return df.mapInArrow(rows, STATE)


def _changes(state: DataFrame, k: int, dim: int) -> dict[int, list[int]]:
    """By cluster: what the vectors that entered or left it add to its sums, and to its count (the last number)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i4").reshape(-1, dim)
                x = np.column_stack([x.astype(np.int64), np.ones(len(x), np.int64)])
                was, now = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                np.add.at(total, now, x)
                np.subtract.at(total, was[was >= 0], x[was >= 0])
        c, i = total.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(i, pa.int32()), pa.array(total[c, i])], ["c", "i", "s"])

    moved = state.where("was <> cluster").select("was", "cluster", "x").mapInArrow(sums, "c int, i int, s long")
    out: dict[int, list[int]] = {}
    for r in moved.groupBy("c", "i").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).collect():  # k x (dim + 1) rows at most
        out.setdefault(r["c"], [0] * (dim + 1))[r["i"]] = int(r["s"])
    return out


def kept_vectors(embeddings: DataFrame, dim: int = DIM) -> DataFrame:
    """vec_id and v (doubles) of the vectors of dim components, none of them null or non-finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    wide = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return wide.where(F.col("v").isNotNull() & (F.size("v") == dim)).where(~F.exists("v", bad))


def elkan_clusters(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    A null vec_id is clustered but never an initial centroid. Rows that repeat a vec_id are vectors each, and in the order
    of initial centroids by their components. With fewer vectors than k there are fewer clusters; without any, no rows.
    Components of 2^27 and more in size (after scaling) raise an error. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    vectors = kept_vectors(embeddings, dim)
    first = vectors.where("vec_id IS NOT NULL").orderBy(F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256), "v").limit(k)
    with np.errstate(over="ignore"):
        start = [np.floor(np.array(r["v"]) * scale) for r in first.select("v", "vec_id").collect()]
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    if np.abs(start).max() >= LARGEST:
        raise ValueError(f"a component leaves the {LARGEST} that exact distances allow")
    now, before, totals = np.array(start).astype(np.int64), None, [[0] * (dim + 1) for _ in start]
    state, folder = vectors, None
    for r in range(rounds + 1):
        new, path = write_table(_round(state, Centroids(now, before), scale, dim, r == rounds))
        if folder:
            drop_folder(spark, folder)
        state, folder = new, path
        if r < rounds:
            for c, change in _changes(state, len(now), dim).items():
                totals[c] = [a + b for a, b in zip(totals[c], change, strict=True)]
            before, now = now, np.array([[s // t[-1] for s in t[:-1]] if t[-1] else old.tolist() for t, old in zip(totals, now, strict=True)], np.int64)
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    inertia = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(exact("distance").alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    about = [(c, s, sum(inertia.values()), digest[c]) for c, s in inertia.items()]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_elkan_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elkan_clusters(table(spark, sf_dir, "embeddings"))


def _sql(rounds: int = ROUNDS) -> str:
    parts = [
        f"""k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM k WHERE vec_id IS NOT NULL
  QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id), v) <= {CLUSTERS})""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT k.rid, any_value(k.vec_id) AS vec_id, any_value(k.v) AS v,
  min({{'d': list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'c': c.c}}) AS m FROM k, c{r} c GROUP BY k.rid)""")
        if r < rounds:
            parts.append(f"""s{r} AS MATERIALIZED (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT m.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i)""")
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.v, c.v) AS v FROM c{r} c
  LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY c) n ON n.c = c.c)""")
    return f"""WITH {", ".join(parts)}
SELECT a.vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.m.c"""


QUERIES = {"op12_elkan_clustering": op12_elkan_clustering}
ORACLE_SQL = {"op12_elkan_clustering": _sql()}
