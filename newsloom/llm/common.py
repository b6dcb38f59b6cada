"""Helpers that several operators of this folder use."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local folder if there are no
    other machines (tests); else an error, since executors would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{found or 'file:///tmp/checkpoints'}/newsloom-{spark.sparkContext.applicationId}"


#: Bytes of one Arrow batch between Spark and its Python workers, about. Texts are long: by default a batch may take 64 MB,
#: which both sides hold several times for every task that runs.
BATCH_BYTES, DEFAULT_BYTES = 4 << 20, f"{64 << 20}b"


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bytes for an Arrow batch from the default to BATCH_BYTES; another setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == DEFAULT_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def materialize(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage and outlives a lost executor. Bounds the
    session's Arrow batches (bound_batches)."""
    return write_table(df)[0]


def write_table(df: DataFrame) -> tuple[DataFrame, str]:
    """As materialize, with the table's folder, for a caller that deletes it by drop_folder when it is done."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store. What was made from it cannot be read any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_tables(spark: SparkSession) -> None:
    """Delete all that materialize has written in this application."""
    drop_folder(spark, shared_dir(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's folder. Bounds the session's Arrow batches (bound_batches)."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


#: A list of ids goes to every task up to this many (about 32 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


def join_ids(df: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """left_semi or left_anti join with a column of ids, without a shuffle of df where the ids are counted to be few."""
    return df.join(small(ids), column, how)


def small(df: DataFrame) -> DataFrame:
    """A table of a few ids or numbers a row, marked for broadcast where it is counted to have BROADCAST_IDS rows at most."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def most_frequent(df: DataFrame, key: str, count: str, limit: int) -> tuple[DataFrame, bool]:
    """The rows with the highest counts, about `limit` at most, and whether these are all.

    Counts are binned on a log scale (sixteen bins an octave, so at most some 1,000 rows come here); of the bin that does
    not fit whole, a share of its keys by their hash goes along. The rest is the caller's to join.
    """
    binned = F.floor(F.log2(F.greatest(F.col(count).cast("double"), F.lit(0.5))) * 16).cast("int")
    bins = df.groupBy(binned.alias("bin")).agg(F.count("*").alias("rows")).collect()
    rows = 0
    for r in sorted(bins, key=lambda r: -r["bin"]):
        if rows + r["rows"] > limit:
            share = int((limit - rows) / r["rows"] * 0.99 * (1 << 20))
            return df.where((binned > r["bin"]) | (binned == r["bin"]) & (F.pmod(F.xxhash64(key), F.lit(1 << 20)) < share)), False
        rows += r["rows"]
    return df, True


def give_back() -> None:
    """Return memory that a Python worker no longer needs to the system: workers live on after their tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def number_rows(df: DataFrame, group: str, order: list[str], out: str, rows: int) -> DataFrame:
    """Gapless numbers from 0 within each group, also where one group holds most rows.

    A group is cut into hash buckets of its rows; a bucket's rows are numbered by a window, and the counts of the
    buckets before it (a small aggregate) are added. rows: about how many rows df has. df is read twice.
    """
    n = max(16, min(8192, rows // 128))
    salted = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    w = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        salted.groupBy(group, "__bucket").agg(F.count("*").alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    )
    inside = F.row_number().over(Window.partitionBy(group, "__bucket").orderBy(*order)) - 1
    return (
        salted.withColumn("__inside", inside).join(before, [group, "__bucket"])
        .withColumn(out, (F.col("__inside") + F.col("__before")).cast("long"))
        .drop("__bucket", "__inside", "__before")
    )
