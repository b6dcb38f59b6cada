"""State that lives between micro-batches: health of sources, bans that end by themselves, limits of two tiers.

Each key's state is a row of a state store (RocksDB), changed by a processor. Events of a key count in the order of their
times within a micro-batch; one that is older than what its key has seen changes nothing. Null keys and times are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Failures in a row that break a source; hours that a ban lasts.
FAILURES, BAN_HOURS = 5, 24
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that processors need, unless the session names one of its own."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in spark.conf.get(key, "HDFSBacked"):
        spark.conf.set(key, PROVIDER)


class Health(StatefulProcessor):
    """source_id, ts, event_id, ok -> failures in a row, status and last success after the micro-batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("health", "failures int, status string, success timestamp, seen timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        failures, status, success, seen = self.state.get() if self.state.exists() else (0, "pending", None, None)
        tail = None  # the last success so far and the failures after it
        for frame in rows:
            frame = frame if seen is None else frame[frame["ts"] >= seen]
            tail = (frame if tail is None else pd.concat([tail, frame])).sort_values(["ts", "event_id"], kind="stable")
            ok = tail["ok"].to_numpy(dtype=bool)
            tail = tail.iloc[len(ok) - 1 - ok[::-1].argmax() :] if ok.any() else tail
        if len(tail):
            if tail["ok"].iloc[0]:
                failures, status, success = -1, "active", tail["ts"].iloc[0]
            failures += len(tail)
            status = "broken" if failures >= FAILURES else status
            seen = tail["ts"].iloc[-1]
        self.state.update((failures, status, success, seen))
        yield pd.DataFrame({"source_id": [key[0]], "failures": [failures], "status": [status], "last_success_at": [pd.Timestamp(success) if success is not None else pd.NaT]})

    def close(self) -> None:
        pass


def source_health(events: DataFrame) -> DataFrame:
    """A stream of fetches (source_id, ts, event_id, ok): of every source that a micro-batch has fetches of, its failures in a
    row, its status (pending; active from a success on; broken from FAILURES failures in a row until the next success) and
    its last success."""
    rows = events.where("source_id IS NOT NULL AND ts IS NOT NULL").select(F.col("source_id").cast("long").alias("source_id"), "ts", "event_id", "ok")
    return rows.groupBy("source_id").transformWithStateInPandas(
        Health(), "source_id long, failures int, status string, last_success_at timestamp", outputMode="Update", timeMode="None")


class Bans(StatefulProcessor):
    """ip, at (microseconds), permanent -> the ban that holds after the micro-batch; a timer ends it. A ban that is not permanent
    has one timer, which is not moved with every strike: where it finds that the ban holds longer, it is set anew."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("ban", "expires long, permanent boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self.state.get()
        expires, permanent = old or (None, False)
        for row in rows:
            permanent = permanent or bool(row.permanent)
            until = row.at + BAN_HOURS * 3_600_000_000
            expires = until if expires is None else max(expires, until)
        if old is None and not permanent:
            self.handle.registerTimer(expires // 1000)
        if old is None or tuple(old) != (expires, permanent):
            self.state.update((expires, permanent))
        yield self._row(key, expires, permanent, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        expires, permanent = self.state.get()
        if permanent:
            return
        if expires // 1000 > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(expires // 1000)
            return
        self.state.clear()
        yield self._row(key, expires, permanent, False)

    @staticmethod
    def _row(key, expires: int, permanent: bool, active: bool) -> Row:
        return Row(ip=key[0], expires=None if permanent else expires, active=active)

    def close(self) -> None:
        pass


def ending_bans(strikes: DataFrame) -> DataFrame:
    """A stream of strikes (ip, ts with a watermark, permanent): the ban of every ip with new strikes, BAN_HOURS from the last
    one (null: permanent, which stays), and a row with active = false when the watermark passes its end."""
    rows = strikes.where("ip IS NOT NULL AND ts IS NOT NULL").select(F.col("ip").cast("long").alias("ip"), "ts", F.unix_micros("ts").alias("at"), "permanent")
    held = rows.groupBy("ip").transformWithState(Bans(), "ip long, expires long, active boolean", outputMode="Update", timeMode="EventTime")
    return held.select("ip", F.timestamp_micros("expires").alias("expires_at"), "active")


def tier_limits(events: DataFrame, limits: dict[str, int], window: str = "60 seconds") -> DataFrame:
    """Callers over the limit of their tier in a tumbling window: tier user by session_id, else anon by ip ('unknown' without
    one); tier, caller, window_start, n."""
    tier = F.when(F.col("session_id").isNotNull(), "user").otherwise("anon")
    caller = F.coalesce(F.col("session_id").cast("string"), F.col("ip").cast("string"), F.lit("unknown"))
    most = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    counts = events.groupBy(tier.alias("tier"), caller.alias("caller"), F.window("ts", window).alias("w")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > F.element_at(most, F.col("tier"))).select("tier", "caller", F.col("w.start").alias("window_start"), "n")
