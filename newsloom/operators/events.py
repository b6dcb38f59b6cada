"""Engagement events in batch: coercion, breakdowns, counters, rate limits and bans.

Null keys are left out of counters, repeated rows count each, and empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.sources.domain import Domain, with_domain

# The event types that clients may send, and those that a day's report expects.
ALLOWED = ("impression", "preview_open", "dwell_5s", "dwell_15s", "dwell_60s", "original_open", "related_click", "bookmark", "share", "search")
SIGNALS = ("impression", "preview_open", "original_open", "bookmark", "share")


def coerce_events(raw: DataFrame, now) -> DataFrame:
    """Typed events: a bad time becomes `now`, a bad session null; types have 32 characters at most, methods 8; an empty
    method is null and an empty type `http_request`."""
    uuid = r"^[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$"
    return raw.withColumns({
        "ts": F.coalesce(F.try_to_timestamp("ts"), F.lit(now)),
        "session_id": F.when(F.col("session_id").rlike(uuid), F.col("session_id")),
        "event_type": F.substring(F.coalesce(F.nullif("event_type", F.lit("")), F.lit("http_request")), 1, 32),
        "method": F.nullif(F.substring("method", 1, 8), F.lit("")),
    })


def accepted_events(raw: DataFrame) -> DataFrame:
    """Client events of the allowed types, as they are written; others, and those without a type, are dropped without a word."""
    return raw.where(F.col("event_type").isin(*ALLOWED))


def engagement_counters(events: DataFrame) -> DataFrame:
    """Reads (previews and originals), opens (originals) and the last of them for each target."""
    read = F.col("event_type").isin("preview_open", "original_open")
    return events.where(read & F.col("target_id").isNotNull()).groupBy("target_id").agg(
        F.count("*").alias("reads"), F.count_if(F.col("event_type") == "original_open").alias("opens"), F.max("ts").alias("last_read_at"))


def rate_limited(events: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """Windows in which a user sent more than `limit` events."""
    start = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds) * seconds).cast("timestamp_ntz")
    return events.groupBy("user_id", start.alias("window_start")).agg(F.count("*").alias("n")).where(F.col("n") > limit)


def auto_bans(strikes: DataFrame, hours: int = 24) -> DataFrame:
    """ip, expires_at: 24 hours from the last strike; a permanent ban (null expiry) stays."""
    until = F.max(F.col("ts") + F.make_dt_interval(hours=F.lit(hours)))
    return strikes.groupBy("ip").agg(F.when(F.count_if(F.col("permanent")) > 0, None).otherwise(until).alias("expires_at"))


def top_by(events: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values, null among them; ties by value."""
    return events.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(n)


def _breakdown(spark, sf):
    return Domain(spark, sf).activity().groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_distinct(F.when(F.col("status") == 200, F.col("user_id"))).alias("good_users"), F.max("ts").alias("last_ts"))


def _freshness(spark, sf):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return Domain(spark, sf).activity().agg(F.max("ts").alias("last_ts"), F.timestamp_diff("SECOND", F.max("ts"), now).cast("bigint").alias("lag_s"), F.count("*").alias("n"))


def _zero_fill(spark, sf):
    wanted = spark.createDataFrame([(s,) for s in SIGNALS], "event_type string")
    counts = Domain(spark, sf).activity().groupBy("event_type").agg(F.count("*").alias("n"))
    return wanted.join(counts, "event_type", "left").select("event_type", F.coalesce("n", F.lit(0)).alias("n"))


def _coverage(spark, sf):
    actors = Domain(spark, sf).activity().groupBy("user_id").agg(F.count_if(F.col("event_type").isin(*SIGNALS)).alias("signals"))
    return actors.agg(F.count("*").alias("actors"), F.count_if(F.col("signals") >= 1).alias("with_one"), F.count_if(F.col("signals") >= 5).alias("with_five"), F.sum("signals").alias("signals"))


def _bans(spark, sf):
    strikes = Domain(spark, sf).activity().where("status = 500").select((F.col("user_id") % 200).alias("ip"), "ts", (F.col("target_id") == 13).alias("permanent"))
    return auto_bans(strikes)


def _deduped(spark, sf):
    """One impression a user and target: the first."""
    e = Domain(spark, sf).activity().where("event_type = 'impression'")
    return e.groupBy("user_id", "target_id").agg(F.min(F.struct("ts", "event_id")).alias("f")).select("user_id", "target_id", F.col("f.event_id").alias("event_id"))


def _pruned(spark, sf):
    """Days kept after pruning 20 days before the end, with their rows."""
    e = Domain(spark, sf).activity().where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    return e.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


_SIGNALS = ", ".join(f"'{s}'" for s in SIGNALS)
def _accepted(spark, sf):
    """The log as clients send it: what they may send, and the server's own types beside it."""
    d = Domain(spark, sf)
    sent = d.activity().select("event_id", "event_type").unionByName(d.table("events").select("event_id", F.concat("event_type", F.lit("_5s")).alias("event_type")))
    sent = sent.unionByName(d.table("events").select("event_id", F.when(F.col("value") > 10, "dwell_15s").when(F.col("value") > 5, "SHARE").alias("event_type")))
    return accepted_events(sent).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


QUERIES = {
    "events_accepted": _accepted,
    "event_type_breakdown": _breakdown,
    "event_freshness": _freshness,
    "event_zero_fill": _zero_fill,
    "signal_coverage": _coverage,
    "engagement_counters": lambda spark, sf: engagement_counters(Domain(spark, sf).activity()),
    "rate_limit_minutes": lambda spark, sf: rate_limited(Domain(spark, sf).activity(), 1),
    "top_blocked": lambda spark, sf: top_by(Domain(spark, sf).activity().where("status = 500"), "target_id"),
    "auto_ban_upsert": _bans,
    "impression_dedupe": _deduped,
    "events_pruned": _pruned,
}
ORACLE_SQL = {
    "events_accepted": with_domain("activity", f", s AS (SELECT event_id, event_type FROM activity UNION ALL SELECT event_id, event_type || '_5s' FROM events UNION ALL SELECT event_id, CASE WHEN value > 10 THEN 'dwell_15s' WHEN value > 5 THEN 'SHARE' END FROM events) SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM s WHERE event_type IN ({', '.join(repr(a) for a in ALLOWED)}) GROUP BY 1"),
    "event_type_breakdown": with_domain("activity", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) FILTER (WHERE status = 200) AS good_users, max(ts) AS last_ts FROM activity GROUP BY 1"),
    "event_freshness": with_domain("activity", "SELECT max(ts) AS last_ts, floor(epoch(TIMESTAMP '2024-02-01' - max(ts)))::BIGINT AS lag_s, count(*) AS n FROM activity"),
    "event_zero_fill": with_domain("activity", f"SELECT w.event_type, count(a.event_id) AS n FROM (SELECT unnest([{_SIGNALS}]) AS event_type) w LEFT JOIN activity a USING (event_type) GROUP BY 1"),
    "signal_coverage": with_domain("activity", f", a AS (SELECT user_id, count(*) FILTER (WHERE event_type IN ({_SIGNALS})) AS s FROM activity GROUP BY 1) SELECT count(*) AS actors, count(*) FILTER (WHERE s >= 1) AS with_one, count(*) FILTER (WHERE s >= 5) AS with_five, sum(s)::BIGINT AS signals FROM a"),
    "engagement_counters": with_domain("activity", "SELECT target_id, count(*) AS reads, count(*) FILTER (WHERE event_type = 'original_open') AS opens, max(ts) AS last_read_at FROM activity WHERE event_type IN ('preview_open', 'original_open') AND target_id IS NOT NULL GROUP BY 1"),
    "rate_limit_minutes": with_domain("activity", "SELECT user_id, date_trunc('minute', ts) AS window_start, count(*) AS n FROM activity GROUP BY 1, 2 HAVING count(*) > 1"),
    "top_blocked": with_domain("activity", "SELECT target_id::VARCHAR AS \"value\", count(*) AS n FROM activity WHERE status = 500 GROUP BY 1 ORDER BY n DESC, \"value\" NULLS FIRST LIMIT 10"),
    "auto_ban_upsert": with_domain("activity", "SELECT user_id % 200 AS ip, CASE WHEN count(*) FILTER (WHERE target_id = 13) > 0 THEN NULL ELSE max(ts) + INTERVAL 24 HOUR END AS expires_at FROM activity WHERE status = 500 GROUP BY 1"),
    "impression_dedupe": with_domain("activity", "SELECT user_id, target_id, arg_min(event_id, (ts, event_id)) AS event_id FROM activity WHERE event_type = 'impression' GROUP BY 1, 2"),
    "events_pruned": with_domain("activity", "SELECT ts::DATE AS day, count(*) AS n FROM activity WHERE ts >= '2024-01-10' GROUP BY 1"),
}
