"""Streams with state of their own: usage alerts and retention.

State is kept by RocksDB; a session that runs these needs that provider (``with_state`` sets it for one query).
Both use event time: nothing depends on how micro-batches or Arrow chunks cut the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR, DAY = 3_600_000, 86_400_000


@contextmanager
def with_state(spark: SparkSession) -> Iterator[None]:
    """The session's state store is RocksDB inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def millis(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[ms]").astype(np.int64)


class UsageAlerts(StatefulProcessor):
    """Of one (tenant, resource): the sum of the month so far and the last alert. A timer clears both when the
    month is over and the last alert can silence nothing any more."""

    OUT = "tenant long, resource string, hour timestamp, used double, `limit` double, percent double"

    def __init__(self, share: float, quiet: int):
        self.share, self.quiet = share, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("usage", "month int, hundredths long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # a row an hour: what a micro-batch closes of one key is bounded by its hours
        hours = pd.concat(rows).sort_values("hour")
        at, amount = millis(hours["hour"]), hours["hundredths"].to_numpy(np.int64)
        limit = hours["limit"].to_numpy(np.float64)
        month = hours["hour"].to_numpy("datetime64[M]").astype(np.int64)
        old, base, last = self.state.get() if self.state.exists() else (-1, 0, -self.quiet)
        running = np.cumsum(amount)
        first = np.searchsorted(month, month)  # of each hour's month
        used = running - (running[first] - amount[first]) + np.where(month == old, base, 0)
        over = np.flatnonzero((limit > 0) & (used >= self.share * 100 * limit))
        told = []
        while True:
            k = int(np.searchsorted(at[over], last + self.quiet))
            if k == len(over):
                break
            told.append(over[k])
            last = int(at[over[k]])
        self.state.update((int(month[-1]), int(used[-1]), last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        after = int((np.datetime64(int(month[-1]) + 1, "M")).astype("datetime64[ms]").astype(np.int64))
        self.handle.registerTimer(max(after, last + self.quiet) + HOUR)
        if told:
            some = hours.iloc[told]
            yield pd.DataFrame({"tenant": key[0], "resource": key[1], "hour": some["hour"], "used": used[told] / 100, "limit": some["limit"], "percent": used[told] / 100 * 100 / some["limit"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def usage_alerts(usage: DataFrame, limits: DataFrame, share: float = 0.8, quiet_hours: int = 24, late: str = "10 minutes") -> DataFrame:
    """(tenant, resource, hour, used, limit, percent) when a tenant's use of a resource in a month reaches the share
    of its limit, once in the quiet hours. usage: tenant, resource, quantity, ts (a stream); limits: tenant, resource,
    limit (a table); no limit or one of 0 gives no alert.

    Use is summed by hour first (pre-aggregated before the shuffle, late rows dropped by the watermark), so that a
    tenant with a third of all events sends one row an hour to its state.
    """
    by = F.window("ts", "1 hour")
    hourly = usage.withWatermark("ts", late).groupBy(by, "tenant", "resource").agg(F.sum((F.col("quantity") * 100).cast("long")).alias("hundredths"))
    hourly = hourly.select("tenant", "resource", F.window_time("window").alias("ts"), F.col("window.start").alias("hour"), "hundredths")
    hourly = hourly.join(limits.select("tenant", "resource", F.col("limit").cast("double").alias("limit")).where("`limit` > 0"), ["tenant", "resource"])
    return hourly.groupBy("tenant", "resource").transformWithStateInPandas(UsageAlerts(share, quiet_hours * HOUR), UsageAlerts.OUT, "append", "eventTime")


class Retention(StatefulProcessor):
    """Of one key: its newest rows, at most ``cap``, none older than ``keep`` before the watermark. Gives the rows
    that go, each with its reason."""

    def __init__(self, cap: int, keep: int, name: str):
        self.cap, self.keep, self.name = cap, keep, name

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "at long, id long")

    def held(self) -> pd.DataFrame:
        return pd.DataFrame([tuple(x) for x in self.rows.get()], columns=["at", "id"], dtype=np.int64)

    def keeps(self, rows: pd.DataFrame) -> None:
        """Newest first, with one timer: when the oldest will go."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if len(rows):
            self.rows.put(list(rows.itertuples(index=False, name=None)))
            self.handle.registerTimer(int(rows["at"].iloc[-1]) + self.keep + 1)
        else:
            self.rows.clear()

    def gone(self, key, rows: pd.DataFrame, reason: str) -> Iterator[pd.DataFrame]:
        if len(rows):
            yield pd.DataFrame({self.name: key[0], "id": rows["id"], "ts": pd.to_datetime(rows["at"], unit="ms"), "reason": reason})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.held()
        for part in rows:
            held = pd.concat([held, pd.DataFrame({"at": millis(part["ts"]), "id": part["id"].to_numpy(np.int64)})])
            held = held.sort_values(["at", "id"], ascending=False)
            yield from self.gone(key, held.iloc[self.cap :], "cap")
            held = held.iloc[: self.cap]
        self.keeps(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.held()
        old = held["at"] + self.keep < timerValues.getCurrentWatermarkInMs()
        yield from self.gone(key, held[old], "age")
        self.keeps(held[~old])

    def close(self) -> None:
        pass


def retention(rows: DataFrame, key: str, cap: int = 10_000, keep_days: float = 7, late: str = "10 minutes") -> DataFrame:
    """(key, id, ts, reason) of rows that are no longer kept: beyond the newest ``cap`` of their key, or older than
    ``keep_days`` before the watermark. What is left is the state (``retained``), at most ``cap`` rows a key."""
    out = f"{key} {rows.schema[key].dataType.simpleString()}, id long, ts timestamp, reason string"
    known = rows.select(key, F.col("id").cast("long").alias("id"), "ts").withWatermark("ts", late)
    return known.groupBy(key).transformWithStateInPandas(Retention(cap, int(keep_days * DAY), key), out, "append", "eventTime")


def retained(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """(key, id, ts) that a ``retention`` stream holds, read from its state."""
    state = spark.read.format("statestore").option("stateVarName", "rows").load(checkpoint)
    value = F.col("list_element")
    return state.select(F.col(f"key.{key}").alias(key), value["id"].alias("id"), F.timestamp_millis(value["at"]).alias("ts"))


def hadoop(spark: SparkSession, path: str):
    """(file system, path) as the session's Hadoop client sees them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_days(part: DataFrame, path: str, epoch: int, keep_days: int) -> None:
    """A micro-batch under day=/batch= of its event times, again in place if the batch is repeated; days older than
    ``keep_days`` before the newest are dropped as folders, unread."""
    spark = part.sparkSession
    rows = part.withColumns({"day": F.to_date("ts"), "batch": F.lit(epoch)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)
    fs, at = hadoop(spark, path)
    days = sorted(f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName().startswith("day="))
    if days:
        newest = np.datetime64(days[-1].removeprefix("day="))
        for name in days:
            if np.datetime64(name.removeprefix("day=")) < newest - keep_days:
                fs.delete(hadoop(spark, f"{path}/{name}")[1], True)
