"""Queries that apply the scalar functions of the domain to whole tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from newsloom.functions.text import decode_cursor, encode_cursor, fix_mojibake, open_graph, parse_date, title_and_description
from newsloom.operators.alerts import alert_problem, normalize_channels
from newsloom.operators.enrichment import allowed_by_robots, bot_challenge, discovery, normalize_url
from newsloom.operators.events import coerce_events
from newsloom.operators.security import exempt
from newsloom.sources.domain import Domain, with_domain

NOW = "2024-03-01 00:00:00"


def _coerced(spark, sf):
    e = Domain(spark, sf).table("events")
    n = F.col("event_id")
    raw = e.select(
        "event_id", F.when(n % 5 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("ts"), F.when(n % 3 == 0, "nope").otherwise(F.md5(n.cast("string").cast("binary"))).alias("session_id"),
        F.when(n % 7 == 0, "").otherwise(F.repeat("event_type", 9)).alias("event_type"), F.when(n % 2 == 0, "").otherwise(F.lit("PROPPATCH")).alias("method"))
    out = coerce_events(raw, datetime.fromisoformat(NOW))
    return out.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "session_id", "event_type", "method")


def _channels(spark, sf):
    made = F.array(F.upper(F.element_at(F.array(*map(F.lit, ("email", "push", "fax"))), (F.col("source_id") % 3 + 1).cast("int"))), F.lit("sms"), F.when(F.col("source_id") % 2 == 0, " Email "))
    return Domain(spark, sf).sources().select("source_id", F.array_join(normalize_channels(made), ",").alias("channels"))


def _cursors(spark, sf):
    t, i = decode_cursor("cursor")
    rows = Domain(spark, sf).articles().select(encode_cursor("published_at", "article_id").alias("cursor"))
    return rows.select(t.alias("published_at"), i.alias("article_id"))


def _dates(spark, sf):
    day = F.col("published_at").cast("timestamp")
    text = F.when(F.col("article_id") % 3 == 0, F.concat(F.date_format(day, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).when(F.col("article_id") % 3 == 1, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return Domain(spark, sf).articles().select("article_id", parse_date(F.coalesce(text, F.lit("yesterday"))).cast("timestamp_ntz").alias("parsed"))


def _metadata(spark, sf):
    meta = open_graph("html", "url")
    return Domain(spark, sf).table("pages").select("page_id", meta["title"].alias("title"), meta["icon"].alias("icon"))


def _robots(spark, sf):
    d = Domain(spark, sf)
    rules = spark.createDataFrame([("o", "/1", False), ("o", "/11", True), ("o", "/2", True), ("o", "/2", False), ("p", "/", False)], "origin string, prefix string, allow boolean")
    asked = d.articles().select(F.when(F.col("article_id") % 9 == 0, "p").otherwise("o").alias("origin"), F.concat(F.lit("/"), F.col("article_id")).alias("path"))
    return allowed_by_robots(asked, rules)


def _kinds(spark, sf):
    n = F.col("page_id")
    flags = Domain(spark, sf).table("pages").select(
        "page_id", (n % 11 == 0).alias("is_challenge"), (n % 2 == 0).alias("is_feed"), F.when(n % 3 == 0, "http://x/wp-json").alias("wp_root"), F.when(n % 5 == 0, F.array(F.lit("/feed"))).alias("links"),
        F.when(n % 7 == 0, "/rss").alias("common_path"))
    return discovery(flags).select("page_id", "kind")


def _problems(spark, sf):
    d = Domain(spark, sf)
    ids = F.collect_list("topic_id")
    known, invalid = F.array(*[F.lit(i).cast("bigint") for i in range(1, 151)]), F.array(*[F.lit(i).cast("bigint") for i in (7, 70, 77)])
    return d.edges().groupBy((F.col("article_id") % 3000).alias("alert_id")).agg(alert_problem(F.transform(ids, lambda t: t.cast("bigint")), known, invalid).alias("problem"))


QUERIES = {
    "events_coerced": _coerced,
    "alert_channels": _channels,
    "alert_problems": _problems,
    "cursors_decoded": _cursors,
    "dates_parsed": _dates,
    "page_metadata": _metadata,
    "robots_allowed": _robots,
    "source_kinds": _kinds,
    "urls_normalized": lambda spark, sf: Domain(spark, sf).table("pages").select("page_id", normalize_url(F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^[a-z]+://", " ")).otherwise(F.col("url"))).alias("url")),
    "titles_challenged": lambda spark, sf: Domain(spark, sf).texts().where(bot_challenge(F.col("title"), ["The ", "onthe"])).select("doc_id"),
    "mojibake_mended": lambda spark, sf: Domain(spark, sf).table("nation").select("n_nationkey", fix_mojibake(F.concat("n_name", F.lit("Ã¬"))).alias("name")),
    "paths_exempt": lambda spark, sf: Domain(spark, sf).activity().groupBy(exempt(F.concat(F.lit("/"), F.col("target_id")), ["/7"], ["/1", "/22"]).alias("exempt")).agg(F.count("*").alias("n")),
    "meta_texts": lambda spark, sf: Domain(spark, sf).topics().select("topic_id", title_and_description("name", F.when(F.col("topic_id") % 2 == 0, F.col("type")).otherwise(" ")).alias("text")),
}
ORACLE_SQL = {
    "events_coerced": f"""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN TIMESTAMP '{NOW}' ELSE date_trunc('second', ts) END AS ts, CASE WHEN event_id % 3 <> 0 THEN md5(event_id::VARCHAR) END AS session_id,
CASE WHEN event_id % 7 = 0 THEN 'http_request' ELSE substr(repeat(event_type, 9), 1, 32) END AS event_type, CASE WHEN event_id % 2 <> 0 THEN 'PROPPATC' END AS method FROM events""",
    "alert_channels": with_domain("sources", """ SELECT source_id, CASE source_id % 3 WHEN 0 THEN 'email' WHEN 1 THEN CASE WHEN source_id % 2 = 0 THEN 'push,email' ELSE 'push' END ELSE CASE WHEN source_id % 2 = 0 THEN 'email' ELSE 'inapp' END END AS channels FROM sources"""),
    "alert_problems": with_domain("edges", """, g AS (SELECT article_id % 3000 AS alert_id, count(DISTINCT topic_id) AS n, min(topic_id) < 1 OR max(topic_id) > 150 AS other, max((topic_id IN (7, 70, 77))::INT) AS bad FROM edges GROUP BY 1)
SELECT alert_id, CASE WHEN n > 10 THEN 'too_many' WHEN other THEN 'unknown' WHEN bad = 1 THEN 'invalid' END AS problem FROM g"""),
    "cursors_decoded": with_domain("articles", " SELECT published_at::TIMESTAMP AS published_at, article_id FROM articles"),
    "dates_parsed": with_domain("articles", " SELECT article_id, CASE WHEN article_id % 3 < 2 THEN date_trunc('second', published_at::TIMESTAMP) END AS parsed FROM articles"),
    "page_metadata": "SELECT page_id, substr(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' '), ''), 1, 500) AS title, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/favicon.ico' AS icon FROM pages",
    "robots_allowed": with_domain("articles", """, a AS (SELECT DISTINCT CASE WHEN article_id % 9 = 0 THEN 'p' ELSE 'o' END AS origin, '/' || article_id AS path FROM articles)
SELECT origin, path, CASE WHEN origin = 'p' THEN false WHEN starts_with(path, '/11') THEN true WHEN starts_with(path, '/1') THEN false ELSE true END AS allowed FROM a"""),
    "source_kinds": "SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'challenge' WHEN page_id % 2 = 0 THEN 'rss' WHEN page_id % 3 = 0 THEN 'wordpress' WHEN page_id % 5 = 0 OR page_id % 7 = 0 THEN 'rss' ELSE 'invalid' END AS kind FROM pages",
    "urls_normalized": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://' || regexp_replace(url, '^[a-z]+://', '') ELSE url END AS url FROM pages",
    "titles_challenged": with_domain("texts", " SELECT doc_id FROM texts WHERE contains(lower(title), 'the ') OR contains(lower(title), 'onthe')"),
    "mojibake_mended": "SELECT n_nationkey, n_name || 'ì' AS name FROM nation",
    "paths_exempt": with_domain("activity", " SELECT coalesce(target_id = 7 OR starts_with('/' || target_id, '/1') OR starts_with('/' || target_id, '/22'), false) AS exempt, count(*) AS n FROM activity GROUP BY 1"),
    "meta_texts": with_domain("topics", " SELECT topic_id, CASE WHEN topic_id % 2 = 0 THEN name || '. ' || type ELSE name END AS text FROM topics"),
}
