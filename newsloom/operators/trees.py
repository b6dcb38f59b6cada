"""Trees of any depth: levels from the roots, nested values from the leaves, descendants of an owned root.

A row whose parent is missing, belongs to nothing that a root reaches, or stands in a cycle, is in no tree. Siblings are in the
order of their positions, then ids. A tree is one value, so it has to fit a task; there may be any number of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.feeds import descendants
from newsloom.sources import store
from newsloom.sources.domain import Domain


def levels(nodes: DataFrame) -> DataFrame:
    """nodes (id, parent_id and more) with their level, from 0 for roots; those that no root reaches are left out. One join a
    level, each written to the shared store."""
    folder = store.work_folder(nodes.sparkSession, "tree")
    nodes = store.once(nodes, f"{folder}/nodes")
    at = store.once(nodes.where("parent_id IS NULL").withColumn("level", F.lit(0)), f"{folder}/level=0")
    out, depth = at, 0
    while not at.isEmpty():
        depth += 1
        up = at.select(F.col("id").alias("parent_id"))
        at = store.once(nodes.join(up, "parent_id", "left_semi").select(*nodes.columns).withColumn("level", F.lit(depth)), f"{folder}/level={depth}")
        out = out.unionByName(at)
    return out


def nested(nodes: DataFrame, fields: list[str]) -> DataFrame:
    """id and tree of every root: a JSON object of the fields and `children`, an array of such objects. nodes: id, parent_id,
    position and the fields. Folded level by level from the deepest one."""
    folder = store.work_folder(nodes.sparkSession, "tree")
    all_ = store.once(levels(nodes), f"{folder}/levels")
    depth = all_.agg(F.max("level")).first()[0]
    if depth is None:
        return all_.select("id", F.lit("").alias("tree")).limit(0)
    below = None
    for level in range(depth, -1, -1):
        own = all_.where(F.col("level") == level).withColumn("__head", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
        if below is None:
            own = own.withColumn("__inside", F.lit(""))
        else:
            inside = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "id", "tree"))), lambda c: c["tree"]), ",")
            own = own.join(below.groupBy("parent_id").agg(inside.alias("__inside")).withColumnRenamed("parent_id", "__up"), F.col("id") == F.col("__up"), "left")
        tree = F.concat(F.col("__head").substr(F.lit(1), F.length("__head") - 1), F.lit(',"children":['), F.coalesce("__inside", F.lit("")), F.lit("]}"))
        below = store.once(own.select("id", "parent_id", F.coalesce("position", F.lit(0)).alias("position"), tree.alias("tree")), f"{folder}/up={level}")
    return below.select("id", "tree")


def owned_descendants(categories: DataFrame, root: int, user_id: int) -> DataFrame:
    """category_id of a user's root and all of the same user's below it; nothing for another's root. categories: category_id,
    parent_id, user_id."""
    return descendants(categories.where(F.col("user_id") == user_id).select("category_id", "parent_id"), root)


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, their nations, the segments of each, its customers, and their first orders; customers of one nation hang from
    nothing, two nodes from each other."""
    d = Domain(spark, sf_dir)
    node = lambda df, id_, parent, name, position: df.select(id_.cast("long").alias("id"), parent.cast("long").alias("parent_id"), name.alias("name"), position.cast("int").alias("position"))
    c = F.col
    segment = F.ascii("c_mktsegment") + (c("c_nationkey") + 1) * 10_000
    segments = d.table("customer").select(segment.alias("s"), "c_nationkey", "c_mktsegment").distinct()
    firsts = d.table("orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o"))
    parts = [
        node(d.table("region"), c("r_regionkey") + 1, F.lit(None), c("r_name"), 9 - c("r_regionkey")),
        node(d.table("nation"), c("n_nationkey") + 100, c("n_regionkey") + 1, c("n_name"), F.lit(0)),
        node(segments, c("s"), c("c_nationkey") + 100, c("c_mktsegment"), F.length("c_mktsegment")),
        node(d.table("customer"), c("c_custkey") + 1_000_000, F.when(c("c_nationkey") == 7, -5).otherwise(segment), c("c_name"), c("c_custkey") % 5),
        node(firsts, c("o") + 100_000_000, c("o_custkey") + 1_000_000, F.lit("first"), F.lit(None)),
        node(spark.createDataFrame([(-1, -2), (-2, -1)], "a long, b long"), c("a"), c("b"), F.lit("cycle"), F.lit(0)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested(_nodes(spark, sf_dir), ["id", "name", "position"]).select("id", F.sha2("tree", 256).alias("tree_sha256"), F.length("tree").cast("long").alias("n_chars"))


def _forest_sql() -> str:
    json = "'{\"id\":' || n.id || ',\"name\":\"' || n.name || '\",\"position\":' || coalesce(n.position::VARCHAR, 'null') || ',\"children\":[' || coalesce(x, '') || ']}'"
    tables = [
        "SELECT r_regionkey + 1 AS id, NULL::BIGINT AS parent_id, r_name AS name, 9 - r_regionkey AS position FROM region",
        "SELECT n_nationkey + 100, n_regionkey + 1, n_name, 0 FROM nation",
        "SELECT DISTINCT ascii(c_mktsegment) + (c_nationkey + 1) * 10000, c_nationkey + 100, c_mktsegment, length(c_mktsegment) FROM customer",
        "SELECT c_custkey + 1000000, CASE WHEN c_nationkey = 7 THEN -5 ELSE ascii(c_mktsegment) + (c_nationkey + 1) * 10000 END, c_name, c_custkey % 5 FROM customer",
        "SELECT min(o_orderkey) + 100000000, o_custkey + 1000000, 'first', NULL FROM orders GROUP BY o_custkey",
    ]
    parts = [f"n{k}(id, parent_id, name, position) AS ({t})" for k, t in enumerate(tables)]
    below = "(SELECT NULL::BIGINT AS parent_id, NULL::VARCHAR AS x WHERE false)"
    for k in range(4, -1, -1):
        parts.append(f"t{k} AS (SELECT n.id, n.parent_id, coalesce(n.position, 0) AS position, {json} AS tree FROM n{k} n LEFT JOIN {below} b ON b.parent_id = n.id)")
        below = f"(SELECT parent_id, string_agg(tree, ',' ORDER BY position, id) AS x FROM t{k} GROUP BY 1)"
    return f"WITH {', '.join(parts)} SELECT id::BIGINT AS id, sha256(tree) AS tree_sha256, length(tree) AS n_chars FROM t0"


QUERIES = {"category_forest": _forest}
ORACLE_SQL = {"category_forest": _forest_sql()}
