"""Exact top-k inner-product search by dual-tree traversal of cover trees.

Vectors are dealt to blocks by a hash of their id, queries to query blocks; every pair of blocks meets in one task
(queries against all rows, in blocks). There both sides are indexed in cover trees. A pair of nodes is pruned when its
bound <q, c> + |q| Rc + |c| Rq + Rq Rc, with the nodes' points q, c and covering radii Rq, Rc, is below the worst kth
score of the query group so far; what remains is scored exactly, and the blocks' best are merged by a window. All query
blocks meet the first data block first; its kth scores are the bounds that every other meeting starts with.

Cover tree: a node is a point that covers its rows within 2^level. Its children are points of the node on the level
below, itself among them (nesting), each more than 2^(level - 1) apart (separation), and every row lies within that
distance of its child (covering). Levels on which nothing parts are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import give_back, materialize, table

TOP = 20
BLOCK_ROWS = 32_768
QUERY_BLOCK_ROWS = 8_192
LEAF = 256
#: A node is not split where its children would hold fewer rows on average than such a part of a leaf, as far as so many of
#: its rows tell.
FEWEST, PROBED = 4, 256


@dataclass
class Node:
    rows: np.ndarray
    point: np.ndarray
    level: int
    radius: float  #: the distance to the farthest row, 2^level at most
    children: list[Node] = field(default_factory=list)


def cover_tree(points: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> Node:
    """The cover tree of points[rows] (one row at least), whose leaves hold `leaf` rows at most, or more where these are
    equal or too far apart for the next level to gather them."""

    wide = points.astype(float)
    squares, fewest = (wide**2).sum(axis=1), max(2, leaf // FEWEST)

    def from_point(own: np.ndarray, row: int) -> np.ndarray:
        """Distances of rows to a row; 0 where only rounding parts them."""
        both = squares[own] + squares[row]
        gap = both - 2 * (wide[own] @ wide[row])
        return np.sqrt(np.where(gap <= 1e-14 * both, 0.0, gap))

    def node(own: np.ndarray, row: int, away: np.ndarray) -> Node:
        radius = float(away.max())
        return Node(own, points[row], math.ceil(math.log2(radius)) if radius > 0 else -1075, radius)

    root = node(rows, int(rows[0]), from_point(rows, int(rows[0])))
    todo = [(root, int(rows[0]))]
    while todo:
        at, row = todo.pop()
        if len(at.rows) <= leaf or at.radius == 0:
            continue
        reach = 2.0 ** (at.level - 1)
        some, gaps = wide[at.rows[:: max(1, len(at.rows) // PROBED)]], squares[at.rows[:: max(1, len(at.rows) // PROBED)]]
        close = ((gaps[:, None] + gaps[None, :] - 2 * some @ some.T <= reach**2).sum() - len(some)) / max(1, len(some) * (len(some) - 1))
        if close * len(at.rows) < fewest:
            continue
        # farthest first, so that every new child is more than `reach` from all others
        near, to, heads = from_point(at.rows, row), np.zeros(len(at.rows), np.int64), [row]
        while near.max() > reach and len(heads) * fewest <= len(at.rows):
            heads.append(int(at.rows[near.argmax()]))
            away = from_point(at.rows, heads[-1])
            to[away < near] = len(heads) - 1
            near = np.minimum(near, away)
        if near.max() > reach:  # the sample told too much
            continue
        by = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[by], np.arange(len(heads) + 1))
        for k, head in enumerate(heads):
            inside = by[cuts[k] : cuts[k + 1]]
            at.children.append(node(at.rows[inside], head, near[inside]))
            todo.append((at.children[-1], head))
    return root


class _Search:
    """Best k of each query over the points seen: by score, then smaller id. floors: scores below which nothing counts."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray | None = None):
        self.points, self.ids, self.queries, self.query_ids, self.k = points, ids, queries, query_ids, k
        lowest = -np.inf if queries.dtype.kind == "f" else np.iinfo(np.int64).min
        self.lowest = np.array(lowest, queries.dtype)
        self.floors = np.full(len(queries), self.lowest) if floors is None else floors
        self.best = np.full((len(queries), k), self.lowest)  # descending
        self.best_ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.pruned = self.scored = 0

    def run(self, queries: Node, data: Node) -> None:
        todo = [(queries, data)]
        while todo:
            q, c = todo.pop()
            bound = self.bound(q, c)
            rounding = 1e-6 * (abs(bound) + np.linalg.norm(q.point.astype(float)) * np.linalg.norm(c.point.astype(float)) + 1)
            if bound + rounding < float(np.maximum(self.best[q.rows, -1], self.floors[q.rows]).min()):
                self.pruned += 1
            elif q.children and (not c.children or q.radius >= c.radius):
                todo += [(child, c) for child in q.children]
            elif c.children:
                todo += [(q, child) for child in sorted(c.children, key=lambda n: self.bound(q, n))]  # the most promising comes next
            else:
                for i in range(0, len(c.rows), 4096):  # far apart or equal vectors can make a large leaf
                    for j in range(0, len(q.rows), 1024):
                        self.score(q.rows[j : j + 1024], c.rows[i : i + 4096])

    @staticmethod
    def bound(q: Node, c: Node) -> float:
        return float(
            np.dot(q.point.astype(float), c.point.astype(float)) + np.linalg.norm(q.point.astype(float)) * c.radius
            + np.linalg.norm(c.point.astype(float)) * q.radius + q.radius * c.radius)

    def score(self, q: np.ndarray, c: np.ndarray) -> None:
        self.scored += 1
        scores = self.queries[q] @ self.points[c].T
        scores[self.query_ids[q][:, None] == self.ids[c][None, :]] = self.lowest
        scores[scores < self.floors[q][:, None]] = self.lowest
        # a row that only ties with the worst can still have the smaller id
        better = (scores.max(axis=1) >= self.best[q, -1]).nonzero()[0]
        if len(better):
            rows, own = q[better], scores[better]
            least = self.best[rows, -1]
            if own.shape[1] > self.k:  # what is below the kth of these alone cannot count
                least = np.maximum(least, np.partition(own, own.shape[1] - self.k, axis=1)[:, -self.k])
            at, col = ((own >= least[:, None]) & (own > self.lowest)).nonzero()
            of = np.concatenate([np.repeat(np.arange(len(rows)), self.k), at])
            both = np.concatenate([self.best[rows].ravel(), own[at, col]])
            ids = np.concatenate([self.best_ids[rows].ravel(), self.ids[c[col]]])
            order = np.lexsort((ids, -both if both.dtype.kind == "f" else ~both, of))
            place = np.arange(len(order)) - np.searchsorted(of[order], of[order])
            order = order[place < self.k].reshape(len(rows), self.k)
            self.best[rows], self.best_ids[rows] = both[order], ids[order]

    def result(self) -> pd.DataFrame:
        at, col = (self.best != self.lowest).nonzero()
        return pd.DataFrame({"query_id": self.query_ids[at], "vec_id": self.best_ids[at, col], "score": self.best[at, col].astype(np.int64)})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_BLOCK_ROWS) -> DataFrame:
    """vectors and queries: vec_id, v (array of whole numbers). query_id, rank, vec_id, score of each query's k best.

    A row whose vec_id is the query's is the query itself and no candidate. Shorter vectors count as padded with zeros.
    Squared lengths must be below 2^62, else an error is raised (below 2^53 scores are doubles, which hold them exactly,
    beyond that 64-bit integers). Queries without candidates and empty tables give no rows; ties go to the smaller vec_id;
    repeated rows of one vec_id are candidates each; of a query with several vectors the least one (as an array) is asked.
    """
    vectors = materialize(vectors.select("vec_id", "v"))
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    queries = materialize(queries.groupBy("vec_id").agg(F.min("v").alias("v")))
    size = vectors.select("v").unionByName(queries.select("v")).agg(F.max(F.size("v")).alias("dim"), F.max(squared).alias("squared")).first()
    if (size["squared"] or 0) >= 2.0**62:
        raise ValueError("inner products may leave 64 bits")
    dim, kind = size["dim"] or 1, np.float64 if (size["squared"] or 0) < 2.0**53 else np.int64
    n_blocks, n_query_blocks = max(1, math.ceil(vectors.count() / block_rows)), max(1, math.ceil(queries.count() / query_rows))
    spread = lambda df, salt, n: df.withColumn(salt, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    data, asked = spread(vectors, "cb", n_blocks), spread(queries, "qb", n_query_blocks)

    def matrix(column: pd.Series) -> np.ndarray:
        out = np.zeros((len(column), dim), kind)
        for i, v in enumerate(column):
            out[i, : len(v)] = v
        return out

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        low = -np.inf if kind is np.float64 else np.iinfo(np.int64).min
        floors = np.array([low if x is None or x != x else x for x in left["floor"].tolist()], kind)
        search = _Search(matrix(left["v"]), left["vec_id"].to_numpy(), matrix(right["v"]), right["vec_id"].to_numpy(), k, floors)
        search.run(cover_tree(search.queries, np.arange(len(left)), 64), cover_tree(search.points, np.arange(len(right))))
        out = search.result()
        give_back()
        return out

    def meetings(asked: DataFrame, first: int, last: int) -> DataFrame:
        """The best of every query in the data blocks from first to before last."""
        every = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b - 1)))
        left = asked.withColumn("cb", every(first, last))
        right = data.where(F.col("cb").between(first, last - 1)).withColumn("qb", every(0, n_query_blocks))
        return left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInPandas(meet, "query_id long, vec_id long, score long")

    found = meetings(asked.withColumn("floor", F.lit(None).cast("long")), 0, 1)
    if n_blocks > 1:
        found = materialize(found)
        floors = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        found = found.unionByName(meetings(asked.join(floors, "vec_id", "left"), 1, n_blocks))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, v = floor(64 x); vectors that are null or hold null or non-finite components, and null ids, are left out."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    wide = embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    kept = wide.where(F.col("e").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("e", bad))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("e", lambda x: F.floor(x * 64)).alias("v"))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


QUERIES = {"op10_topk_search": op10_topk_search}
ORACLE_SQL = {
    "op10_topk_search": """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""
}
