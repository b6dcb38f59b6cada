"""Structured Streaming over the event log: append with counters, tumbling rate limits, deduplicated impressions, bans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from newsloom.operators.events import engagement_counters


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """Event files as a stream; event time is a timestamp with a watermark of one day."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 200).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")


def rate_limit_stream(events: DataFrame, limit: int, window: str = "60 seconds") -> DataFrame:
    """Users with more than `limit` events in a tumbling window."""
    counts = events.groupBy("user_id", F.window("ts", window).alias("w")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > limit).select("user_id", F.col("w.start").alias("window_start"), "n")


def first_impressions(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each key within the watermark; state ends with it."""
    return events.where("event_type = 'impression'").dropDuplicatesWithinWatermark(keys)


def write_events(events: DataFrame, log: str, counters: str, checkpoint: str):
    """Appends each micro-batch to a log partitioned by day and its counters to a table of increments. A batch that runs
    again replaces its own increments and its own part of the log, so each event counts once."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        batch.withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy("day").parquet(f"{log}/batch={batch_id}")
        engagement_counters(batch).write.mode("overwrite").parquet(f"{counters}/batch={batch_id}")
        batch.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_counters(spark: SparkSession, counters: str) -> DataFrame:
    """Totals of the increments."""
    rows = spark.read.parquet(counters)
    return rows.groupBy("target_id").agg(F.sum("reads").alias("reads"), F.sum("opens").alias("opens"), F.max("last_read_at").alias("last_read_at"))


def strike_increments(strikes: DataFrame) -> DataFrame:
    """strikes: ip, ts, permanent. The latest strike of each ip and whether any is permanent."""
    return strikes.groupBy("ip").agg(F.max("ts").alias("ts"), F.max(F.coalesce("permanent", F.lit(False))).alias("permanent"))


def bans(increments: DataFrame, hours: int = 24) -> DataFrame:
    """ip, expires_at: the latest strike and 24 hours, null for permanent ones."""
    until = F.col("ts") + F.make_dt_interval(hours=F.lit(hours))
    return strike_increments(increments).select("ip", F.when(F.col("permanent"), None).otherwise(until).alias("expires_at"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", increments=None) -> DataFrame:
    """Runs a stream over what there is, into Parquet files under path, and reads them with the batch of each row. No row passes
    through the driver. Each micro-batch, or what `increments` makes of it, has its own folder, so one that runs again
    replaces itself. In update mode a key's row of the latest batch counts (latest)."""
    spark = stream.sparkSession
    make = increments or (lambda batch: batch)
    schema = make(spark.createDataFrame([], stream.schema)).schema
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/batch=0")  # in case no batch runs

    def each(batch: DataFrame, batch_id: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(StructType([*schema.fields, StructField("batch", IntegerType())])).parquet(path)


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row of its latest batch."""
    rest = [c for c in table.columns if c not in keys and c != "batch"]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
