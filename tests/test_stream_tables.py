"""Results of streams are files, not rows of the driver."""

import pytest
from pyspark.sql import functions as F

from newsloom.streaming import events as stream
from newsloom.streaming import queries, state


@pytest.mark.parametrize("mode", ["append", "update"])
def test_run_to_table(spark, tmp_path, mode):
    def run():
        rows = spark.readStream.schema("k long, v long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        rows = rows.groupBy("k").agg(F.sum("v").alias("v")) if mode == "update" else rows
        out = stream.run_to_table(rows, f"{tmp_path}/out", f"{tmp_path}/state", mode)
        files = out.inputFiles()
        assert files and all(f"{tmp_path}/out/" in f for f in files)
        return sorted(map(tuple, (stream.latest(out, ["k"]) if mode == "update" else out.drop("batch")).collect()))

    def add(*rows):
        spark.createDataFrame(rows, "k long, v long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    spark.createDataFrame([], "k long, v long").write.parquet(f"{tmp_path}/in")
    assert run() == []
    add((1, 1), (2, 5))
    add((1, 2))
    assert run() == ([(1, 3), (2, 5)] if mode == "update" else [(1, 1), (1, 2), (2, 5)])
    assert run() == ([(1, 3), (2, 5)] if mode == "update" else [(1, 1), (1, 2), (2, 5)])
    add((3, 7))
    assert run() == ([(1, 3), (2, 5), (3, 7)] if mode == "update" else [(1, 1), (1, 2), (2, 5), (3, 7)])


def test_slices_are_written_by_all_tasks(spark, tmp_path):
    """Every slice has as many files as there are tasks, however few rows it has; rows without a time come first; a micro-batch is a slice."""
    rows = spark.range(1000).select("id", F.when(F.col("id") > 9, F.timestamp_seconds(F.col("id") * 60)).alias("ts"))
    rows = rows.withColumn("__at", F.unix_micros("ts").cast("double"))
    for name, some in (("all", rows), ("few", rows.where("id < 12")), ("none", rows.where("id < 0"))):
        stream_ = queries._ordered_stream(some, f"{tmp_path}/{name}")
        n = spark.sparkContext.defaultParallelism
        assert [len(list((tmp_path / name / "in" / f"slice={i}").glob("*.parquet"))) for i in range(queries.SLICES)] == [n] * queries.SLICES
        found = stream.run_to_table(stream_, f"{tmp_path}/{name}/out", f"{tmp_path}/{name}/state").groupBy("batch").agg(F.min("id"), F.max("id"), F.count("*")).orderBy("batch").collect()
        assert sum(r[3] for r in found) == some.count() and all(a[2] < b[1] for a, b in zip(found, found[1:], strict=False))
        if name == "all":
            assert len(found) == queries.SLICES and found[0][1] == 0 and max(r[3] for r in found) < 400


def test_health_in_frames_equals_a_loop():
    import random
    import types

    import pandas as pd

    rng = random.Random(3)
    for _ in range(60):
        kept, health = [None], state.Health()
        health.state = types.SimpleNamespace(get=lambda kept=kept: kept[0], exists=lambda kept=kept: kept[0] is not None, update=lambda v, kept=kept: kept.__setitem__(0, v))
        failures, status, success, seen = 0, "pending", None, None
        for _ in range(3):
            rows = [(pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=rng.randint(0, 20)), i, rng.random() < 0.3) for i in range(rng.randint(1, 12))]
            start = seen
            for ts, _, ok in sorted(rows):
                if start is None or ts >= start:
                    seen = ts
                    failures, success = (0, ts) if ok else (failures + 1, success)
                    status = "active" if ok else "broken" if failures >= state.FAILURES else status
            rng.shuffle(rows)
            frames = [pd.DataFrame(rows[i : i + 4], columns=["ts", "event_id", "ok"]) for i in range(0, len(rows), 4)]
            out = next(health.handleInputRows((1,), iter(frames), None)).iloc[0]
            assert (out["failures"], out["status"], None if pd.isna(out["last_success_at"]) else out["last_success_at"]) == (failures, status, success)
