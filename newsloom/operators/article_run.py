"""The way of new articles as one run: markup made safe and text, topics of the title, changes of edges, rows of the search
index, alerts, and the articles' new states.

Articles whose source is missing fail and give nothing else; articles that are not new stay as they are. Null texts are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.markup import normalize_articles
from newsloom.functions.text import source_domain
from newsloom.operators.alerts import match_alerts
from newsloom.operators.articles import _topics, article_topics
from newsloom.operators.changes import apply_changes, changes
from newsloom.operators.classify import _scan_sql
from newsloom.operators.search import search_rows
from newsloom.sources import store
from newsloom.sources.domain import Domain, with_domain

#: What a run gives.
PARTS = ("articles", "edge_changes", "edges", "topics", "search_rows", "alerts")


def process_articles(articles: DataFrame, sources: DataFrame, topics: DataFrame, edges: DataFrame, alert_topics: DataFrame, **how) -> dict[str, DataFrame]:
    """PARTS by name. articles: article_id, source_id, title, description, content_html, image_url, url, page_html, published_at,
    status; sources: source_id, url_site, url_feed, kind; topics as article_topics takes them; edges: article_id, topic_id, score,
    position; alert_topics: alert_id, topic_id, mode. `how` goes to article_topics, which sees titles alone.
    """
    new = articles.where("status = 'new'")
    own = new.join(sources.select("source_id"), "source_id", "left_semi").select(*articles.columns)
    whole = normalize_articles(own)
    found, made = article_topics(own.select(F.col("article_id").alias("doc_id"), "title", F.lit("").alias("body"), F.array().cast("array<string>").alias("taxonomy")), topics, title_only=True, **how)
    found = store.once(found.select(F.col("doc_id").alias("article_id"), "topic_id", "score", "position"), f"{store.work_folder(articles.sparkSession, 'run')}/found")
    ids = own.select("article_id")
    log = changes(edges.join(ids, "article_id", "left_semi"), found, ["article_id", "topic_id"], ["score", "position"])
    every = topics.unionByName(made)
    listed = found.join(every.select("topic_id", "slug"), "topic_id").groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "topic_id", "slug"))).alias("t"))
    rows = whole.join(listed, "article_id", "left").join(sources.select("source_id", "kind", source_domain("url_feed", "url_site").alias("source_domain")), "source_id")
    rows = search_rows(rows.select(
        "article_id", "title", "description", "content_text", F.col("content_html_safe").alias("content_html"), "source_id", "source_domain", F.col("t.topic_id").alias("topic_ids"),
        F.array_join("t.slug", ",").alias("topic_slugs"), F.col("published_at").cast("timestamp").alias("published_at"), "kind"))
    state = F.when(F.col("status") != "new", F.col("status")).when(F.col("__own"), "indexed").otherwise("failed")
    done = articles.join(ids.withColumn("__own", F.lit(True)), "article_id", "left").withColumn("status", state)
    done = done.join(whole.select("article_id", F.col("image").alias("__image")), "article_id", "left").withColumn("image_url", F.coalesce(F.nullif("image_url", F.lit("")), "__image"))
    return {
        "articles": done.select(*articles.columns), "edge_changes": log, "edges": apply_changes(edges, log, ["article_id", "topic_id"]), "topics": every, "search_rows": rows,
        "alerts": match_alerts(alert_topics, found.select("article_id", "topic_id")),
    }


def _run(d: Domain) -> dict[str, DataFrame]:
    """All documents as new articles; sources from src0 on but for those whose name ends in 7, three alerts."""
    texts = d.texts()
    articles = texts.select(
        F.col("doc_id").alias("article_id"), F.col("source").alias("source_id"), "title", F.lit(None).cast("string").alias("description"), "body", F.lit(None).cast("string").alias("image_url"),
        F.format_string("https://%s.example/%d", "source", "doc_id").alias("url"), F.lit(None).cast("string").alias("page_html"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("published_at"),
        F.lit("new").alias("status")).withColumnRenamed("body", "content_html")
    sources = texts.where("source IS NOT NULL AND source NOT LIKE '%7'").select(F.col("source").alias("source_id"), F.lit(None).cast("string").alias("url_site"), F.concat(F.lit("https://"), "source", F.lit(".example/feed")).alias("url_feed"), F.lit("rss").alias("kind")).distinct()
    edges = texts.where("doc_id % 4 = 0").select(F.col("doc_id").alias("article_id"), F.lit(3).cast("bigint").alias("topic_id"), F.lit(3.0).alias("score"), F.lit("title").alias("position"))
    alerts = store.listed(d.spark, [(1, 1, "any"), (2, 1, "all"), (2, 3, "all"), (3, 2, "any"), (3, 3, "any")], "alert_id int, topic_id bigint, mode string")
    return process_articles(articles, sources, _topics(d.spark).where("topic_id < 4"), edges, alerts, curated_only=True)


def _rows(spark, sf):
    out = _run(Domain(spark, sf))
    rows = out["search_rows"].select("article_id", "topic_slugs", "source_domain", "published_at")
    return out["articles"].select("article_id", "status").join(rows, "article_id", "left")


_TITLES = f"""
, a AS (SELECT doc_id, source, title FROM texts WHERE source IS NOT NULL AND source NOT LIKE '%7'),
m AS (SELECT doc_id, CASE term WHEN 'the' THEN 1 WHEN 'und' THEN 3 ELSE 2 END AS topic_id, count(*) * 3.0::DOUBLE AS score
  FROM (SELECT doc_id, unnest({_scan_sql("title", "of  the|with  the|the|und")}) AS term FROM a WHERE NOT regexp_matches(title, '(?i)(^|[^\\p{{L}}\\p{{N}}_])offert[ae]($|[^\\p{{L}}\\p{{N}}_])')) GROUP BY 1, 2),
k AS (SELECT * FROM m WHERE NOT (topic_id = 1 AND EXISTS (SELECT 1 FROM m x WHERE x.doc_id = m.doc_id AND x.topic_id = 2)))"""
QUERIES = {
    "articles_processed": _rows,
    "articles_edge_changes": lambda spark, sf: _run(Domain(spark, sf))["edge_changes"],
    "articles_alerted": lambda spark, sf: _run(Domain(spark, sf))["alerts"],
}
ORACLE_SQL = {
    "articles_processed": with_domain("texts", _TITLES + """
, s AS (SELECT doc_id, string_agg(CASE topic_id WHEN 1 THEN 'the' WHEN 2 THEN 'of-the' ELSE 'und' END, ',' ORDER BY score DESC, topic_id) AS slugs FROM k GROUP BY 1)
SELECT t.doc_id AS article_id, CASE WHEN a.doc_id IS NULL THEN 'failed' ELSE 'indexed' END AS status, CASE WHEN a.doc_id IS NOT NULL THEN coalesce(slugs, '') END AS topic_slugs,
  a.source || '.example' AS source_domain, CASE WHEN a.doc_id IS NOT NULL THEN 1700000000 + t.doc_id END AS published_at
FROM texts t LEFT JOIN a USING (doc_id) LEFT JOIN s USING (doc_id)"""),
    "articles_edge_changes": with_domain("texts", _TITLES + """
, o AS (SELECT doc_id, 3 AS topic_id, 3.0::DOUBLE AS score FROM a WHERE doc_id % 4 = 0)
SELECT CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN k.doc_id IS NULL THEN 'delete' ELSE 'update' END AS op, coalesce(k.doc_id, o.doc_id) AS article_id, coalesce(k.topic_id, o.topic_id)::BIGINT AS topic_id, k.score,
  CASE WHEN k.doc_id IS NOT NULL THEN 'title' END AS position FROM o FULL JOIN k ON o.doc_id = k.doc_id AND o.topic_id = k.topic_id WHERE o.doc_id IS NULL OR k.doc_id IS NULL OR o.score <> k.score"""),
    "articles_alerted": with_domain("texts", _TITLES + """
, t AS (SELECT * FROM (VALUES (1, 1, 'any'), (2, 1, 'all'), (2, 3, 'all'), (3, 2, 'any'), (3, 3, 'any')) v(alert_id, topic_id, mode))
SELECT alert_id, doc_id AS article_id, count(*) AS hits FROM t JOIN k USING (topic_id) GROUP BY 1, 2, mode HAVING mode = 'any' OR count(*) = 2"""),
}
