"""The event table by day: reruns, late rows, days made ahead and dropped; streams with state against their rules."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from newsloom.sources import store
from newsloom.streaming import events as stream
from newsloom.streaming import state
from newsloom.streaming.event_table import EventTable

TODAY = date(2024, 3, 10)


def rows(spark, *days):
    data = [(i, datetime(2024, 3, d, 5) if d else None) for i, d in enumerate(days)]
    return spark.createDataFrame(data, "id int, ts timestamp")


def test_days(spark):
    first = rows(spark, 9, 9, 10, 1, None)
    table = EventTable(spark, store.work_folder(spark, "test-days"), first.schema)
    assert table.days() == [] and table.read().count() == table.late().count() == 0
    table.append(first, 0, TODAY, 5)
    table.append(rows(spark, 9, 8), 1, TODAY, 5)
    count = lambda: sorted((r.day.day, r.n) for r in table.read().groupBy("day").agg(F.count("*").alias("n")).collect())
    before = count()
    assert before == [(8, 1), (9, 3), (10, 1)] and table.late().count() == 2
    table.append(first, 0, TODAY, 5)  # a batch that runs again
    assert count() == before and table.late().count() == 2
    assert table.create_ahead(TODAY, 2) == [date(2024, 3, 11), date(2024, 3, 12)] and table.create_ahead(TODAY, 2) == []
    assert [d.day for d in table.days()] == [8, 9, 10, 11, 12] and count() == before
    assert table.drop_old(date(2024, 3, 12), 3) == [date(2024, 3, 8)] and count() == before[1:]
    assert table.drop_old(date(2024, 3, 12), 3) == []
    files = table.read(date(2024, 3, 10), date(2024, 3, 10))
    assert files.count() == 1 and "PartitionFilters: [isnotnull(day" in files._jdf.queryExecution().executedPlan().toString()


def run(spark, make, batches, schema, keys):
    """Rows of a stateful stream after micro-batches of these rows, one file each; the last of each key."""
    state.use_rocksdb(spark)
    folder = store.work_folder(spark, "test-state")
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{folder}/in/b={i}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in").withWatermark("ts", "1 hour")
    return stream.latest(stream.run_to_table(make(source), f"{folder}/out", f"{folder}/state", "update"), keys).collect()


def at(hour, minute=0):
    return datetime(2024, 3, 1) + timedelta(hours=hour, minutes=minute)


def test_health_over_batches(spark):
    batches = [
        [(1, at(0), 1, False), (1, at(1), 2, False), (2, at(0), 3, True), (3, at(0), 4, False), (None, at(0), 5, True)],
        [(1, at(4), 8, False), (1, at(3), 7, False), (1, at(2), 6, False), (2, at(5), 9, False)],
        [(3, at(6), 12, True), (3, at(6), 10, False), (2, at(1), 11, True)],  # in order: failure, success; the last one is too old
    ]
    found = {r.source_id: (r.failures, r.status, r.last_success_at) for r in run(spark, state.source_health, batches, "source_id long, ts timestamp, event_id long, ok boolean", ["source_id"])}
    assert found == {1: (5, "broken", None), 2: (1, "active", at(0)), 3: (0, "active", at(6))}
    batches.append([(1, at(9), 13, True)])
    found = {r.source_id: (r.failures, r.status) for r in run(spark, state.source_health, batches, "source_id long, ts timestamp, event_id long, ok boolean", ["source_id"])}
    assert found[1] == (0, "active")


def test_bans_end_and_come_again(spark):
    batches = [
        [(1, at(0), False), (2, at(0), True), (3, at(0), None), (4, at(0), False)],
        [(1, at(20), False), (9, at(30), False)],  # 1 is extended to hour 44; 3 and 4 end at 24, when the watermark passes
        [(9, at(40), False)],
        [(4, at(60), False), (9, at(61), False)],
    ]
    found = {r.ip: (r.expires_at, r.active) for r in run(spark, state.ending_bans, batches, "ip long, ts timestamp, permanent boolean", ["ip"])}
    assert found == {1: (at(44), False), 2: (None, True), 3: (at(24), False), 4: (at(84), True), 9: (at(85), True)}
