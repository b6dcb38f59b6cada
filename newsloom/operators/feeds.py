"""Timelines with keyset pages, category trees and the joins around them.

Null ids and times are in no timeline, equal times are ordered by id, and empty tables give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import encode_cursor
from newsloom.sources.domain import Domain, with_domain


def descendants(categories: DataFrame, root: int) -> DataFrame:
    """category_id of the root and all below it; a recursive query, one join a level. An unknown root gives no rows."""
    spark, view = categories.sparkSession, f"categories_{uuid.uuid4().hex}"
    categories.createOrReplaceTempView(view)
    found = spark.sql(
        f"WITH RECURSIVE d AS (SELECT category_id FROM {view} WHERE category_id = {int(root)} "
        f"UNION ALL SELECT c.category_id FROM {view} c JOIN d ON c.parent_id = d.category_id) SELECT category_id FROM d")
    spark.catalog.dropTempView(view)  # the plan holds what it named
    return found


def timeline(articles: DataFrame, source_ids: DataFrame, limit: int = 30, before: tuple | None = None, topic_edges: DataFrame | None = None) -> DataFrame:
    """Indexed articles of the sources, newest first, one page; `before` is the (time, id) of the last row seen.

    Semi-joins keep one row an article; filter, order and limit become one top-k.
    """
    rows = articles.where("status = 'indexed'").join(source_ids, "source_id", "left_semi")
    if topic_edges is not None:
        rows = rows.join(topic_edges, "article_id", "left_semi")
    if before is not None:
        t, i = F.lit(before[0]).cast("timestamp_ntz"), F.lit(before[1])
        rows = rows.where((F.col("published_at") < t) | ((F.col("published_at") == t) & (F.col("article_id") < i)))
    page = rows.orderBy(F.desc("published_at"), F.desc("article_id")).limit(limit)
    return page.select("article_id", "source_id", "published_at", encode_cursor("published_at", "article_id").alias("cursor"))


PAGE_TWO = ("1998-06-01 00:00:00", 1_000_000_000)
TOPIC = 7


def _user(spark, sf, **more):
    d = Domain(spark, sf)
    return timeline(d.articles(), d.subscriptions().where("user_id = 1").select("source_id"), **more)


def _user_category(spark, sf):
    d = Domain(spark, sf)
    return timeline(d.articles(), d.followed_sources(descendants(d.categories(), 101)))


def _topic(spark, sf):
    d = Domain(spark, sf)
    return timeline(d.articles(), d.sources().select("source_id"), topic_edges=d.edges().where(F.col("topic_id") == TOPIC).select("article_id"))


def _public(spark, sf):
    d = Domain(spark, sf)
    return timeline(d.articles(), d.followed_sources(d.categories().where("is_public")))


def _global(spark, sf):
    d = Domain(spark, sf)
    return timeline(d.articles(), d.followed_sources(d.categories().where("is_public")), limit=50)


def _hydrated(spark, sf):
    """A page of articles with their source and topics, most weighty first."""
    d = Domain(spark, sf)
    page = timeline(d.articles(), d.sources().select("source_id"), limit=100)
    topics = d.edges().join(page.select("article_id"), "article_id", "left_semi").join(d.topics().select("topic_id", "name"), "topic_id")
    nested = topics.groupBy("article_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "topic_id", "name"))).alias("t"))
    return page.join(d.sources().select("source_id", "title"), "source_id").join(nested, "article_id", "left").select(
        "article_id", "title", F.array_join(F.transform("t", lambda x: F.concat_ws(":", x["topic_id"], x["name"])), "|").alias("topics"))


def _colors(spark, sf):
    d = Domain(spark, sf)
    return d.sources().join(d.categories(), "category_id").select("source_id", F.concat(F.lit("#"), F.lpad(F.hex(F.col("category_id").cast("bigint") * 4096), 6, "0")).alias("color"))


def _featured(spark, sf):
    d = Domain(spark, sf)
    hint = F.when(F.col("segment").isin("BUILDING", "MACHINERY"), F.lower("segment")).otherwise("_other")
    return d.sources().where("balance > 9000").withColumn("hint", hint).groupBy("hint").agg(
        F.array_join(F.sort_array(F.collect_list(F.lpad(F.col("source_id").cast("string"), 9, "0"))), ",").alias("source_ids"), F.count("*").alias("n"))


def _tree(spark, sf):
    """Roots with their children in order; a child whose parent is missing is in no tree."""
    d = Domain(spark, sf)
    kids = d.categories().where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("children"))
    return d.categories().where("parent_id IS NULL").join(kids.withColumnRenamed("parent_id", "category_id"), "category_id", "left").select("category_id", "name", "children")


_PAGE_SQL = "SELECT article_id, source_id, published_at, rtrim(translate(to_base64(encode(strftime(published_at, '%Y-%m-%dT%H:%M:%S.%f') || '|' || article_id)), '+/', '-_'), '=') AS cursor FROM articles WHERE status = 'indexed' AND source_id IN ({}) {} ORDER BY published_at DESC, article_id DESC LIMIT {}"
_PUBLIC = "SELECT source_id FROM subscriptions JOIN categories USING (category_id) WHERE is_public {}"
QUERIES = {
    "timeline_user": _user,
    "timeline_page2": lambda spark, sf: _user(spark, sf, before=PAGE_TWO),
    "timeline_user_category": _user_category,
    "timeline_topic": _topic,
    "timeline_public": _public,
    "timeline_global": _global,
    "timeline_hydrated": _hydrated,
    "category_descendants": lambda spark, sf: descendants(Domain(spark, sf).categories(), 102),
    "category_tree": _tree,
    "source_color_map": _colors,
    "featured_grouped": _featured,
}
_SUB = "SELECT source_id FROM subscriptions WHERE user_id = 1"
ORACLE_SQL = {
    "timeline_user": with_domain("articles subscriptions", _PAGE_SQL.format(_SUB, "", 30)),
    "timeline_page2": with_domain("articles subscriptions", _PAGE_SQL.format(
        _SUB, f"AND (published_at < '{PAGE_TWO[0]}' OR published_at = '{PAGE_TWO[0]}' AND article_id < {PAGE_TWO[1]})", 30)),
    "timeline_user_category": with_domain("articles subscriptions categories", _PAGE_SQL.format(
        "SELECT source_id FROM subscriptions JOIN categories USING (category_id) WHERE category_id = 101 OR parent_id = 101", "", 30)),
    "timeline_topic": with_domain("articles edges sources", _PAGE_SQL.format(
        "SELECT source_id FROM sources", f"AND EXISTS (SELECT 1 FROM edges e WHERE e.article_id = articles.article_id AND topic_id = {TOPIC})", 30)),
    "timeline_public": with_domain("articles subscriptions categories", _PAGE_SQL.format(_PUBLIC.format(""), "", 30)),
    "timeline_global": with_domain("articles subscriptions categories", _PAGE_SQL.format(_PUBLIC.format(""), "", 50)),
    "timeline_hydrated": with_domain("articles edges topics sources", """
, p AS (SELECT * FROM articles WHERE status = 'indexed' ORDER BY published_at DESC, article_id DESC LIMIT 100)
SELECT p.article_id, s.title, (SELECT string_agg(topic_id || ':' || name, '|' ORDER BY e.score DESC, topic_id) FROM edges e JOIN topics USING (topic_id) WHERE e.article_id = p.article_id) AS topics
FROM p JOIN sources s USING (source_id)"""),
    "category_descendants": with_domain("categories", "SELECT category_id FROM categories WHERE category_id = 102 OR parent_id = 102"),
    "category_tree": with_domain("categories", "SELECT r.category_id, r.name, string_agg(c.name, ',' ORDER BY c.name) AS children FROM categories r LEFT JOIN categories c ON c.parent_id = r.category_id WHERE r.parent_id IS NULL GROUP BY 1, 2"),
    "source_color_map": with_domain("sources categories", "SELECT source_id, '#' || lpad(to_hex(category_id::BIGINT * 4096), 6, '0') AS color FROM sources JOIN categories USING (category_id)"),
    "featured_grouped": with_domain("sources", "SELECT CASE WHEN segment IN ('BUILDING', 'MACHINERY') THEN lower(segment) ELSE '_other' END AS hint, string_agg(lpad(source_id::VARCHAR, 9, '0'), ',' ORDER BY source_id) AS source_ids, count(*) AS n FROM sources WHERE balance > 9000 GROUP BY 1"),
}
