"""Changes instead of tables: what turns one set of edges into another, applied without rewriting what stays.

Keys are compared null-safe; repeated keys are an error of the caller's (the greatest values count); equal tables change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.articles import article_topics
from newsloom.sources.domain import Domain, with_domain


def changes(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """op (insert, update or delete), the keys and the values after the change (null for a delete): a full join of both."""
    one = lambda df, name: df.groupBy(*keys).agg(F.max(F.struct(*values)).alias(name))
    a, b = one(old, "__old").alias("a"), one(new, "__new").alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = a.join(b, on, "full")
    op = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "delete").when(~F.col("__old").eqNullSafe(F.col("__new")), "update")
    take = lambda k: F.when(F.col("__new").isNotNull(), F.col(f"b.{k}")).otherwise(F.col(f"a.{k}")).alias(k)
    return both.select(op.alias("op"), *[take(k) for k in keys], *[F.col(f"__new.{v}").alias(v) for v in values]).where("op IS NOT NULL")


def apply_changes(table: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """The table after the changes: rows of changed keys go, inserts and updates come. Applying them twice is applying them once."""
    on = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    touched = log.select(*keys).distinct()
    stays = table.join(touched, on(table, touched), "left_anti")
    return stays.unionByName(log.where("op <> 'delete'").select(*table.columns))


def reclassify(articles: DataFrame, edges: DataFrame, topics: DataFrame, source: str | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """(changes, new topics) of classifying articles (as article_topics takes them, with source) anew: all, or those of one source.

    edges: doc_id, topic_id, score, position. Edges of other articles stay; `how` goes to article_topics (curated_only,
    title_only and so on).
    """
    chosen = articles if source is None else articles.where(F.col("source") == source)
    new, made = article_topics(chosen, topics, **how)
    old = edges.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi")
    return changes(old, new, ["doc_id", "topic_id"], ["score", "position"]), made


def _edges_of_source(d: Domain, source: int) -> tuple[DataFrame, DataFrame]:
    """Edges of a source's articles as they are, and as they are without returned items, with doubled scores of some."""
    own = d.articles().where(F.col("source_id") % 10 == source).select("article_id")
    old = d.edges().join(own, "article_id", "left_semi").select("article_id", "topic_id", F.col("score").cast("double").alias("score"), "position")
    rows = d.table("lineitem").where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("article_id"), (F.col("l_partkey") + F.when(F.col("l_linenumber") == 7, 1).otherwise(0)).alias("topic_id"), "l_quantity", "l_linestatus")
    new = rows.groupBy("article_id", "topic_id").agg(F.sum("l_quantity").cast("double").alias("score"), F.min("l_linestatus").alias("position")).join(own, "article_id", "left_semi")
    return old, new


def _log(spark, sf):
    return changes(*_edges_of_source(Domain(spark, sf), 3), ["article_id", "topic_id"], ["score", "position"])


def _applied(spark, sf):
    d = Domain(spark, sf)
    old, new = _edges_of_source(d, 3)
    log = changes(old, new, ["article_id", "topic_id"], ["score", "position"])
    every = d.edges().select("article_id", "topic_id", F.col("score").cast("double").alias("score"), "position")
    once = apply_changes(every, log, ["article_id", "topic_id"])
    return apply_changes(once, log, ["article_id", "topic_id"])


_NEW = """
, own AS (SELECT article_id FROM articles WHERE source_id % 10 = 3),
o AS (SELECT article_id, topic_id, score::DOUBLE AS score, position FROM edges SEMI JOIN own USING (article_id)),
n AS (SELECT l_orderkey AS article_id, l_partkey + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS topic_id, sum(l_quantity)::DOUBLE AS score, min(l_linestatus) AS position
  FROM lineitem WHERE l_returnflag <> 'R' AND l_orderkey IN (SELECT article_id FROM own) GROUP BY 1, 2)"""
QUERIES = {"edge_changes": _log, "edges_changed": _applied}
ORACLE_SQL = {
    "edge_changes": with_domain("articles edges", _NEW + """
SELECT CASE WHEN o.article_id IS NULL THEN 'insert' WHEN n.article_id IS NULL THEN 'delete' ELSE 'update' END AS op, coalesce(n.article_id, o.article_id) AS article_id, coalesce(n.topic_id, o.topic_id) AS topic_id,
  n.score, n.position FROM o FULL JOIN n ON o.article_id = n.article_id AND o.topic_id = n.topic_id
WHERE o.article_id IS NULL OR n.article_id IS NULL OR o.score <> n.score OR o.position <> n.position"""),
    "edges_changed": with_domain("articles edges", _NEW + " SELECT * FROM n UNION ALL SELECT article_id, topic_id, score::DOUBLE AS score, position FROM edges ANTI JOIN own USING (article_id)"),
}
