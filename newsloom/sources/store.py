"""Folders that driver and executors share, and the commits of tables that are written in steps."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def work_folder(spark: SparkSession, kind: str) -> str:
    """A new folder in spark.checkpoint.dir; where that is unset, a temporary one if there are no other machines, else an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{top or 'file:///tmp/newsloom'}/{kind}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, in order; none where there is no folder."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def once(df: DataFrame, path: str) -> DataFrame:
    """df written to a folder and read back: cuts the lineage and outlives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def make(spark: SparkSession, path: str) -> None:
    """An empty folder, with those above it."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


#: Bytes of one Arrow batch of texts, about, and rows that a Python worker turns into objects at once.
BATCH_BYTES, DEFAULT_BYTES, SLICE_ROWS = 4 << 20, f"{64 << 20}b", 64


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bytes for an Arrow batch from the default to BATCH_BYTES, since texts are long and both sides hold a
    batch several times; another setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == DEFAULT_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[dict]]]:
    """A few rows at a time: as a batch, and as dictionaries."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            yield part, part.to_pylist()


def listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a table of the plan itself: no Python worker is asked for them."""
    own = StructType.fromDDL(schema)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(own)
    arrow = to_arrow_schema(own)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow), own)
