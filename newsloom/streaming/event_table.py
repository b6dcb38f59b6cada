"""The event log as a table of days: idempotent appends, days made ahead and dropped by listing, a side table for late rows.

`days/day=D/batch=B` holds the rows of a micro-batch for a day. A batch that runs again overwrites its own partitions alone
(dynamic partition overwrite), so appending twice changes nothing. Days before the retention limit are whole folders, dropped
without reading a row; rows that arrive for such a day go to `late/batch=B` instead of bringing the day back.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, StructField, StructType

from newsloom.sources import store

AHEAD_DAYS, RETENTION_DAYS = 7, 180


class EventTable:
    """Events under `root`. schema: of the rows, with a timestamp column `ts`."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType):
        self.spark, self.root, self.schema = spark, root, schema
        self.days_path, self.late_path = f"{root}/days", f"{root}/late"

    def append(self, rows: DataFrame, batch: int, today: date, retention_days: int = RETENTION_DAYS) -> None:
        """Write a batch's rows, those older than the retention or without a time to the side table. Running it again with the
        same number replaces what it wrote."""
        oldest = today - timedelta(days=retention_days)
        dealt = rows.select(*self.schema.fieldNames()).withColumns({"day": F.to_date("ts"), "batch": F.lit(batch)})
        kept = F.coalesce(F.col("day") >= F.lit(oldest), F.lit(False))
        dealt.where(kept).repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(self.days_path)
        dealt.where(~kept).drop("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.late_path)

    def days(self) -> list[date]:
        """The days that have a folder, ascending."""
        return [date.fromisoformat(n.removeprefix("day=")) for n in store.children(self.spark, self.days_path) if n.startswith("day=") and n[4].isdigit()]

    def create_ahead(self, today: date, days: int = AHEAD_DAYS) -> list[date]:
        """Make the folders of today and so many days after it that are not there; those made."""
        new = sorted({today + timedelta(days=i) for i in range(days + 1)} - set(self.days()))
        for day in new:
            store.make(self.spark, f"{self.days_path}/day={day}")
        return new

    def drop_old(self, today: date, retention_days: int = RETENTION_DAYS) -> list[date]:
        """Delete the folders of days before the retention; those deleted. No file is read."""
        old = [d for d in self.days() if d < today - timedelta(days=retention_days)]
        for day in old:
            store.delete(self.spark, f"{self.days_path}/day={day}")
        return old

    def read(self, first: date | None = None, last: date | None = None) -> DataFrame:
        """Rows of the days from first to last; only their folders are opened."""
        schema = StructType([*self.schema.fields, StructField("day", DateType()), StructField("batch", IntegerType())])
        rows = self._table(self.days_path, schema)
        rows = rows if first is None else rows.where(F.col("day") >= F.lit(first))
        return rows if last is None else rows.where(F.col("day") <= F.lit(last))

    def late(self) -> DataFrame:
        return self._table(self.late_path, StructType([*self.schema.fields, StructField("batch", IntegerType())]))

    def _table(self, path: str, schema: StructType) -> DataFrame:
        if not store.children(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", path).parquet(path)


def stream_to_table(events: DataFrame, table: EventTable, checkpoint: str, today: date, retention_days: int = RETENTION_DAYS):
    """Append a stream's micro-batches to the table, over what there is."""
    query = events.writeStream.foreachBatch(lambda rows, batch: table.append(rows, batch, today, retention_days)).option("checkpointLocation", checkpoint)
    return query.trigger(availableNow=True).start()
