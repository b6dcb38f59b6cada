"""Streaming queries run over the event table to its end; their rows equal the batch queries'."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import events as batch
from newsloom.sources.domain import Domain, with_domain
from newsloom.sources.store import children, delete, work_folder
from newsloom.streaming import events as stream
from newsloom.streaming import state
from newsloom.streaming.event_table import EventTable, stream_to_table


def _work(spark: SparkSession) -> str:
    return work_folder(spark, "stream")


def _activity_stream(spark: SparkSession, sf_dir: str, work: str) -> DataFrame:
    """The activity table, written as files and read as a stream."""
    rows = Domain(spark, sf_dir).activity()
    rows.write.parquet(f"{work}/in")
    return stream.read_events(spark, f"{work}/in", rows.schema)


def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = _work(spark)
    limited = stream.rate_limit_stream(_activity_stream(spark, sf_dir, work), 1)
    out = stream.latest(stream.run_to_table(limited, f"{work}/out", f"{work}/state", "update"), ["user_id", "window_start"])
    return out.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = _work(spark)
    stream.write_events(_activity_stream(spark, sf_dir, work), f"{work}/log", f"{work}/counters", f"{work}/state").awaitTermination()
    return stream.read_counters(spark, f"{work}/counters").withColumn("last_read_at", F.col("last_read_at").cast("timestamp_ntz"))


def stream_bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = _work(spark)
    e = _activity_stream(spark, sf_dir, work)
    strikes = e.where("status = 500").select((F.col("user_id") % 200).alias("ip"), "ts", (F.col("target_id") == 13).alias("permanent"))
    out = stream.bans(stream.run_to_table(strikes, f"{work}/out", f"{work}/state", increments=stream.strike_increments))
    return out.select("ip", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"))


def stream_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and targets with an impression; one row each."""
    work = _work(spark)
    firsts = stream.first_impressions(_activity_stream(spark, sf_dir, work), ["user_id", "target_id"]).select("user_id", "target_id")
    return stream.run_to_table(firsts, f"{work}/out", f"{work}/state").drop("batch")


#: Slices of the event table that ordered streams take as micro-batches, one after another.
SLICES = 4


def _ordered_stream(rows: DataFrame, work: str) -> DataFrame:
    """rows (with ts) as a stream of SLICES micro-batches in the order of their times (rows without one first); a day of
    watermark. The slices are written one after another, since a file source takes the oldest files first, each by all tasks as
    equally many files: empty ones fill up those that have too few rows."""
    spark = rows.sparkSession
    files = spark.sparkContext.defaultParallelism
    cuts = rows.approxQuantile("__at", [i / SLICES for i in range(1, SLICES)], 0.01) if not rows.isEmpty() else []
    cuts = cuts or [0.0] * (SLICES - 1)
    for i, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        part = rows.where(F.col("__at") >= low) if low is not None else rows
        part = part.where((F.col("__at") < high) | F.col("__at").isNull() if low is None else F.col("__at") < high) if high is not None else part
        part.drop("__at").repartition(files).write.parquet(f"{work}/in/slice={i}")
        for _ in range(files - sum(name.endswith(".parquet") for name in children(spark, f"{work}/in/slice={i}"))):
            part.drop("__at").where(F.lit(False)).coalesce(1).write.mode("append").parquet(f"{work}/in/slice={i}")
    source = spark.readStream.schema(rows.drop("__at").schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(f"{work}/in")
    return source.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")


def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Domain(spark, sf_dir).activity().withColumn("__at", F.unix_micros(F.col("ts").cast("timestamp")).cast("double"))


def _last(df: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    state.use_rocksdb(df.sparkSession)
    return stream.latest(stream.run_to_table(df, path, checkpoint, "update"), keys)


def stream_source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources (here: what events point to) by their fetches, errors among them, over several micro-batches."""
    work = _work(spark)
    fetches = _ordered_stream(_activity(spark, sf_dir).select(F.col("target_id").alias("source_id"), "ts", "event_id", (F.col("status") < 500).alias("ok"), "__at"), work)
    out = _last(state.source_health(fetches), f"{work}/out", f"{work}/state", ["source_id"])
    return out.select("source_id", "failures", "status", F.col("last_success_at").cast("timestamp_ntz").alias("last_success_at"))


def stream_ending_bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bans over several micro-batches; those that the watermark has passed are not active."""
    work = _work(spark)
    rows = _activity(spark, sf_dir).where("status = 500").select((F.col("user_id") * 7).alias("ip"), "ts", (F.col("target_id") == 13).alias("permanent"), "__at")
    out = _last(state.ending_bans(_ordered_stream(rows, work)), f"{work}/out", f"{work}/state", ["ip"])
    return out.select("ip", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"), "active")


def stream_tier_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = _work(spark)
    rows = _activity(spark, sf_dir).select("ts", F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("session_id"), F.when(F.col("user_id") % 5 != 0, F.col("user_id") % 50).alias("ip"), "__at")
    over = state.tier_limits(_ordered_stream(rows, work), {"user": 1, "anon": 2}, "10 minutes")
    out = stream.latest(stream.run_to_table(over, f"{work}/out", f"{work}/state", "update"), ["tier", "caller", "window_start"])
    return out.select("tier", "caller", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


TODAY, KEPT_DAYS = date(2024, 1, 30), 20


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day after a stream was appended twice, days were made ahead and old ones dropped; late rows under no day."""
    work = _work(spark)
    rows = _activity(spark, sf_dir)
    table = EventTable(spark, f"{work}/table", rows.drop("__at").withColumn("ts", F.col("ts").cast("timestamp")).schema)
    for run in range(2):  # the second run numbers its batches as the first did and replaces them
        stream_to_table(_ordered_stream(rows, f"{work}/{run}"), table, f"{work}/state{run}", TODAY, KEPT_DAYS).awaitTermination()
    table.create_ahead(TODAY)
    table.drop_old(date(2024, 2, 3), KEPT_DAYS)
    days = spark.createDataFrame([(d,) for d in table.days()], "day date")
    counted = days.join(table.read(table.days()[0]).groupBy("day").agg(F.count("*").alias("n")), "day", "left")
    out = counted.select("day", F.coalesce("n", F.lit(0)).alias("n")).unionByName(table.late().agg(F.lit(None).cast("date").alias("day"), F.count("*").alias("n")))
    for run in range(2):
        delete(spark, f"{work}/{run}")
    return out


QUERIES = {"stream_rate_limit": stream_rate_limit, "stream_counters": stream_counters, "stream_bans": stream_bans, "stream_impressions": stream_impressions,
           "stream_source_health": stream_source_health, "stream_ending_bans": stream_ending_bans, "stream_tier_limits": stream_tier_limits, "event_days": event_days}
_HEALTH = """
, e AS (SELECT target_id AS source_id, ts, event_id, status < 500 AS ok FROM activity WHERE target_id IS NOT NULL AND ts IS NOT NULL),
g AS (SELECT *, count_if(ok) OVER w AS runs, max(CASE WHEN ok THEN ts END) OVER w AS success FROM e WINDOW w AS (PARTITION BY source_id ORDER BY ts, event_id)),
r AS (SELECT source_id, runs, success, count_if(NOT ok) AS failures FROM g GROUP BY 1, 2, 3)
SELECT source_id, failures::INTEGER AS failures, CASE WHEN failures >= 5 THEN 'broken' WHEN runs > 0 THEN 'active' ELSE 'pending' END AS status, success AS last_success_at
FROM r QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY runs DESC) = 1"""
_BANS = """
, s AS (SELECT user_id * 7 AS ip, max(ts) + INTERVAL 24 HOUR AS until, bool_or(target_id = 13) AS permanent FROM activity WHERE status = 500 GROUP BY 1),
w AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM activity WHERE status = 500)
SELECT ip, CASE WHEN NOT permanent THEN until END AS expires_at, permanent OR date_trunc('milliseconds', until) > date_trunc('milliseconds', mark) AS active FROM s, w"""
_TIERS = """
, c AS (SELECT ts, CASE WHEN user_id % 3 <> 0 THEN 'user' ELSE 'anon' END AS tier, CASE WHEN user_id % 3 <> 0 THEN user_id::VARCHAR WHEN user_id % 5 <> 0 THEN (user_id % 50)::VARCHAR ELSE 'unknown' END AS caller FROM activity)
SELECT tier, caller, time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, count(*) AS n FROM c GROUP BY 1, 2, 3 HAVING count(*) > CASE tier WHEN 'user' THEN 1 ELSE 2 END"""
_DAYS = """
, k AS (SELECT unnest(generate_series(DATE '2024-01-14', DATE '2024-02-06', INTERVAL 1 DAY))::DATE AS day),
n AS (SELECT ts::DATE AS day, count(*) AS n FROM activity GROUP BY 1),
d AS (SELECT day FROM n WHERE day >= DATE '2024-01-14' UNION SELECT day FROM k WHERE day >= DATE '2024-01-30')
SELECT day, coalesce(n, 0) AS n FROM d LEFT JOIN n USING (day)
UNION ALL SELECT NULL, count(*) FROM activity WHERE ts IS NULL OR ts::DATE < DATE '2024-01-10'"""
ORACLE_SQL = {
    "stream_source_health": with_domain("activity", _HEALTH),
    "stream_ending_bans": with_domain("activity", _BANS),
    "stream_tier_limits": with_domain("activity", _TIERS),
    "event_days": with_domain("activity", _DAYS),
    "stream_rate_limit": batch.ORACLE_SQL["rate_limit_minutes"],
    "stream_counters": batch.ORACLE_SQL["engagement_counters"],
    "stream_bans": batch.ORACLE_SQL["auto_ban_upsert"],
    "stream_impressions": batch.ORACLE_SQL["impression_dedupe"].replace(", arg_min(event_id, (ts, event_id)) AS event_id", ""),
}
