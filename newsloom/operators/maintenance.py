"""Scheduling, retention, statistics, deduplicating ingest, additive upserts and merges.

Null keys match nothing, and empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import normalize_term, slugify
from newsloom.sources.domain import Domain, with_domain


def due_sources(sources: DataFrame, now, limit: int = 50) -> DataFrame:
    """Active sources never fetched, or fetched poll_s seconds ago (one second of grace; 1,800 by default); the longest
    ago first, never fetched before all."""
    age = F.timestamp_diff("SECOND", F.col("last_fetched_at"), F.lit(now).cast("timestamp_ntz"))
    due = F.col("last_fetched_at").isNull() | (age + 1 >= F.coalesce("poll_s", F.lit(1800)))
    return sources.where((F.col("status") == "active") & due).orderBy(F.asc_nulls_first("last_fetched_at"), "source_id").limit(limit)


def retention_candidates(articles: DataFrame, counters: DataFrame, protected: list[DataFrame], before) -> DataFrame:
    """article_id of articles published before the time, without reads, and in none of the protected sets. What is kept is one
    table, so articles are sorted and joined once, however many sets there are."""
    kept = counters.where("reads > 0").select("article_id")
    for ids in protected:
        kept = kept.unionByName(ids.select("article_id"))
    return articles.where(F.col("published_at") < F.lit(before).cast("timestamp_ntz")).select("article_id").join(kept, "article_id", "left_anti")


def insert_absent(existing: DataFrame, candidates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The candidates to insert: the first of each key, where the key is not there yet."""
    first = candidates.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")
    return first.join(existing.select(key), key, "left_anti")


def additive_upsert(existing: DataFrame, batch: DataFrame, keys: list[str], count: str, keep: str) -> DataFrame:
    """Counts of equal keys add up; `keep` stays as it is in `existing`, else as it is first in the batch."""
    rows = existing.select(*keys, count, keep, F.lit(0).alias("__new")).unionByName(batch.select(*keys, count, keep, F.lit(1).alias("__new")))
    return rows.groupBy(*keys).agg(F.sum(count).alias(count), F.min(F.struct("__new", keep))[keep].alias(keep))


def merge_topics(topics: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges after each topic that is not curated has given its edges to the curated topic of its normalised name (the
    smallest id); an article's own curated edge is preferred."""
    named = topics.withColumn("term", normalize_term("name"))
    curated = named.where("is_curated").groupBy("term").agg(F.min("topic_id").alias("target_id"))
    moves = named.where("NOT is_curated").join(curated, "term").select("topic_id", "target_id")
    moved = edges.join(moves, "topic_id", "left").withColumn("own", F.col("target_id").isNull()).withColumn("topic_id", F.coalesce("target_id", "topic_id"))
    best = F.row_number().over(Window.partitionBy("article_id", "topic_id").orderBy(F.desc("own"), F.desc("score"), "edge_source", "position"))
    return moved.withColumn("n", best).where("n = 1").select("article_id", "topic_id", "score")


def unique_slugs(rows: DataFrame, name: str, key: str) -> DataFrame:
    """A slug for each row: the name's; those that repeat are numbered from 2 in the order of the key."""
    n = F.row_number().over(Window.partitionBy("base").orderBy(key))
    return rows.withColumn("base", slugify(name)).withColumn("slug", F.when(n > 1, F.concat_ws("-", "base", n)).otherwise(F.col("base"))).select(key, "slug")


def erase_user(events: DataFrame, user_id: int) -> DataFrame:
    """Events with the user's identifying columns set to null."""
    own = F.col("user_id") == user_id
    return events.withColumns({c: F.when(~F.coalesce(own, F.lit(False)), F.col(c)) for c in ("user_id", "fingerprint", "ua", "ip") if c in events.columns})


def broken_sources(log: DataFrame, failures: int = 5) -> DataFrame:
    """log: source_id, at, ok. Sources whose last fetches are `failures` or more failures in a row."""
    last_ok = F.max(F.when(F.col("ok"), F.col("at"))).over(Window.partitionBy("source_id"))
    since = log.withColumn("last_ok", last_ok).where(~F.col("ok") & (F.col("last_ok").isNull() | (F.col("at") > F.col("last_ok"))))
    return since.groupBy("source_id").agg(F.count("*").alias("failures")).where(F.col("failures") >= failures)


NOW = "1998-06-01 00:00:00"


def _due(spark, sf):
    d = Domain(spark, sf)
    last = d.articles().groupBy("source_id").agg(F.max("published_at").alias("last_fetched_at"))
    rows = d.sources().join(last, "source_id", "left").select("source_id", "last_fetched_at", F.lit("active").alias("status"), (F.col("category_id") * 86400 * 30).cast("bigint").alias("poll_s"))
    return due_sources(rows, NOW).select("source_id", "last_fetched_at")


def _retention(spark, sf):
    d = Domain(spark, sf)
    counters = d.activity().where("event_type = 'preview_open'").groupBy(F.col("target_id").alias("article_id")).agg(F.count("*").alias("reads"))
    matched = d.edges().where("topic_id % 50 = 0").select("article_id")
    featured = d.articles().join(d.sources().where("balance > 5000"), "source_id", "left_semi").select("article_id")
    return retention_candidates(d.articles(), counters, [matched, featured], "1997-01-01")


def _orphans(spark, sf):
    """Topics that no article has: all parts have some, so suppliers stand for topics beside them, numbered after the last."""
    d = Domain(spark, sf)
    last = d.topics().agg(F.max("topic_id").alias("last"))
    more = d.table("supplier").crossJoin(F.broadcast(last)).select((F.col("last") + F.col("s_suppkey")).alias("topic_id"), F.col("s_name").alias("name"))
    return d.topics().select("topic_id", "name").unionByName(more).join(d.edges().select("topic_id").distinct(), "topic_id", "left_anti").select("topic_id", "name")


def _stats(spark, sf):
    return Domain(spark, sf).topics().groupBy("type").agg(
        F.count("*").alias("n"), F.count_if("is_curated").alias("curated"), F.count_if(F.col("size") > 25).alias("large"))


def _top_topics(spark, sf):
    d = Domain(spark, sf)
    return d.edges().groupBy("topic_id").agg(F.count_distinct("article_id").alias("n")).join(d.topics().select("topic_id", "name"), "topic_id").orderBy(F.desc("n"), "topic_id").limit(50)


def _ingest(spark, sf):
    d = Domain(spark, sf)
    docs = d.table("documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return insert_absent(docs.where("doc_id % 3 = 0").select("h"), docs.where("doc_id % 3 <> 0"), "h", ["doc_id"]).select("doc_id", "h")


def _additive(spark, sf):
    d = Domain(spark, sf)
    part = lambda k: d.edges().where(F.col("article_id") % 2 == k).groupBy((F.col("topic_id") % 40).alias("k"), "edge_source").agg(F.count("*").alias("n"), F.min("topic_id").alias("surface"))
    return additive_upsert(part(0), part(1), ["k", "edge_source"], "n", "surface")


def _last_session(spark, sf):
    return Domain(spark, sf).activity().groupBy("user_id").agg(F.max("ts").alias("last_seen"))


def _dashboard(spark, sf):
    d = Domain(spark, sf)
    t = d.topics().agg(F.count_if("is_curated").alias("curated"), F.count_if(~F.col("is_curated")).alias("uncurated"))
    return t.crossJoin(d.edges().agg(F.count("*").alias("edges"))).crossJoin(d.articles().agg(F.count("*").alias("articles"), F.count_if(F.col("status") == "indexed").alias("indexed")))


def _broken(spark, sf):
    log = Domain(spark, sf).activity().select((F.col("user_id") % 300).alias("source_id"), F.col("event_id").alias("at"), (F.col("status") == 200).alias("ok"))
    return broken_sources(log, 2)


QUERIES = {
    "due_sources": _due, "retention_candidates": _retention, "orphan_topics": _orphans, "topic_stats_by_type": _stats, "top_topics": _top_topics,
    "edges_by_source": lambda spark, sf: Domain(spark, sf).edges().groupBy("edge_source").agg(F.count("*").alias("n")),
    "dedup_ingest": _ingest, "additive_upsert": _additive,
    "merge_curated": lambda spark, sf: merge_topics((d := Domain(spark, sf)).topics(), d.edges()),
    "last_session": _last_session, "dashboard_counts": _dashboard,
    "slugify_names": lambda spark, sf: unique_slugs(Domain(spark, sf).topics(), "name", "topic_id"),
    "erase_user": lambda spark, sf: erase_user(Domain(spark, sf).activity(), 5).select("event_id", "user_id"),
    "broken_sources": _broken,
}
ORACLE_SQL = {
    "due_sources": with_domain("articles sources", f", l AS (SELECT source_id, max(published_at) AS t FROM articles GROUP BY 1) SELECT source_id, t AS last_fetched_at FROM sources LEFT JOIN l USING (source_id) WHERE t IS NULL OR floor(epoch(TIMESTAMP '{NOW}' - t)) + 1 >= category_id::BIGINT * 86400 * 30 ORDER BY t NULLS FIRST, source_id LIMIT 50"),
    "retention_candidates": with_domain("articles edges sources activity", "SELECT article_id FROM articles a WHERE published_at < '1997-01-01' AND NOT EXISTS (SELECT 1 FROM activity e WHERE e.target_id = a.article_id AND event_type = 'preview_open') AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.article_id = a.article_id AND topic_id % 50 = 0) AND NOT EXISTS (SELECT 1 FROM sources s WHERE s.source_id = a.source_id AND balance > 5000)"),
    "orphan_topics": with_domain("topics edges", ", t AS (SELECT topic_id, name FROM topics UNION ALL SELECT (SELECT max(topic_id) FROM topics) + s_suppkey, s_name FROM supplier) SELECT topic_id, name FROM t WHERE topic_id NOT IN (SELECT topic_id FROM edges)"),
    "topic_stats_by_type": with_domain("topics", "SELECT type, count(*) AS n, count(*) FILTER (WHERE is_curated) AS curated, count(*) FILTER (WHERE size > 25) AS large FROM topics GROUP BY 1"),
    "top_topics": with_domain("topics edges", "SELECT topic_id, count(DISTINCT article_id) AS n, any_value(name) AS name FROM edges JOIN topics USING (topic_id) GROUP BY 1 ORDER BY n DESC, topic_id LIMIT 50"),
    "edges_by_source": with_domain("edges", "SELECT edge_source, count(*) AS n FROM edges GROUP BY 1"),
    "dedup_ingest": "SELECT min(doc_id) AS doc_id, sha256(text) AS h FROM documents WHERE doc_id % 3 <> 0 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0) GROUP BY text",
    "additive_upsert": with_domain("edges", "SELECT topic_id % 40 AS k, edge_source, count(*) AS n, coalesce(min(topic_id) FILTER (WHERE article_id % 2 = 0), min(topic_id)) AS surface FROM edges GROUP BY 1, 2"),
    "merge_curated": with_domain("topics edges", ", t AS (SELECT *, lower(trim(name)) AS term FROM topics), c AS (SELECT term, min(topic_id) AS target FROM t WHERE is_curated GROUP BY 1), m AS (SELECT t.topic_id, target FROM t JOIN c USING (term) WHERE NOT is_curated) SELECT article_id, coalesce(target, e.topic_id) AS topic_id, score FROM edges e LEFT JOIN m USING (topic_id) QUALIFY row_number() OVER (PARTITION BY article_id, coalesce(target, e.topic_id) ORDER BY target IS NULL DESC, score DESC, edge_source, position) = 1"),
    "last_session": with_domain("activity", "SELECT user_id, max(ts) AS last_seen FROM activity GROUP BY 1"),
    "dashboard_counts": with_domain("topics edges articles", "SELECT * FROM (SELECT count(*) FILTER (WHERE is_curated) AS curated, count(*) FILTER (WHERE NOT is_curated) AS uncurated FROM topics), (SELECT count(*) AS edges FROM edges), (SELECT count(*) AS articles, count(*) FILTER (WHERE status = 'indexed') AS indexed FROM articles)"),
    "slugify_names": with_domain("topics", ", b AS (SELECT topic_id, trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM topics), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY topic_id) AS n FROM b) SELECT topic_id, CASE WHEN n > 1 THEN base || '-' || n ELSE base END AS slug FROM n"),
    "erase_user": with_domain("activity", "SELECT event_id, CASE WHEN user_id <> 5 THEN user_id END AS user_id FROM activity"),
    "broken_sources": with_domain("activity", ", l AS (SELECT user_id % 300 AS source_id, event_id, status = 200 AS ok, max(event_id) FILTER (WHERE status = 200) OVER (PARTITION BY user_id % 300) AS last_ok FROM activity) SELECT source_id, count(*) AS failures FROM l WHERE NOT ok AND (last_ok IS NULL OR event_id > last_ok) GROUP BY 1 HAVING count(*) >= 2"),
}
