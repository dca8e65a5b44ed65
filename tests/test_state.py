"""Streams with state: alerts, retention and completed jobs, over several micro-batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.storage import new_folder
from docquarry.streaming import state, streams

BASE = 1_704_067_200  # 2024-01-01


def batches(spark, path, parts, columns):
    """A stream whose micro-batches are the given lists of rows; ``ts`` in seconds after 2024-01-01."""
    for k, rows in enumerate(parts):
        df = spark.createDataFrame(rows, columns).withColumn("ts", F.timestamp_seconds(F.col("ts") + BASE))
        df.coalesce(1).write.mode("append").parquet(f"{path}/{k:03}")
        schema = df.schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    return reader.parquet(path)


def limits_of(spark, rows):
    return spark.createDataFrame(rows, "tenant long, resource string, limit double")


COLUMNS = "tenant long, resource string, quantity double, ts long"
HOUR, DAY = 3600, 86400


def alerts(spark, path, parts, limits, name):
    stream = batches(spark, path, parts, COLUMNS)
    with state.with_state(spark):
        out = streams.run(state.usage_alerts(stream, limits_of(spark, limits)), name)
    return sorted((r.tenant, r.resource, (int(r.at) - BASE) / HOUR, r.used, r.limit, r.percent) for r in out.withColumn("at", F.unix_timestamp("hour")).collect())


def test_alerts_once_a_day_and_by_month(spark, tmp_path):
    flush = [(9, "x", 0.0, 62 * DAY)]
    parts = [
        [(1, "docs", 50.0, 10), (1, "docs", 25.0, HOUR + 5), (2, "docs", 500.0, 20), (1, "api", 999.0, 30)],
        [(1, "docs", 10.0, 2 * HOUR), (1, "docs", 1.0, 5 * HOUR), (1, "docs", 1.0, 30 * HOUR), (1, "docs", 1.0, 31 * HOUR)],
        # February begins again; what is left of the day's silence is over
        [(1, "docs", 79.0, 31 * DAY + HOUR), (1, "docs", 2.0, 31 * DAY + 2 * HOUR)], flush,
    ]
    got = alerts(spark, str(tmp_path), parts, [(1, "docs", 100.0), (2, "docs", 0.0)], "alerts_a")
    assert got == [(1, "docs", 2, 85.0, 100.0, 85.0), (1, "docs", 30, 87.0, 100.0, 87.0), (1, "docs", 31 * 24 + 2, 81.0, 100.0, 81.0)]


def test_alerts_do_not_depend_on_batches_or_chunks(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 3)), "docs", float(rng.integers(1, 100)) / 4, int(t)) for t in np.sort(rng.integers(0, 20 * DAY, 900))]
    flush = [(9, "x", 0.0, 40 * DAY)]
    limits = [(k, "docs", 300.0 * (k + 1)) for k in range(3)]
    one = alerts(spark, str(tmp_path / "one"), [[*rows[::-1], *flush]], limits, "alerts_b")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        many = alerts(spark, str(tmp_path / "many"), [rows[:300], rows[300:310], rows[310:], flush], limits, "alerts_c")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert one == many and len(one) > 10


def test_idle_state_is_gone(spark, tmp_path):
    stream = batches(spark, str(tmp_path), [[(k, "docs", 90.0, k * 60) for k in range(20)], [(99, "docs", 1.0, 60 * DAY)], [(99, "docs", 1.0, 61 * DAY)]], COLUMNS)
    path = new_folder(spark, "idle")
    with state.with_state(spark):
        streams.to_parquet(state.usage_alerts(stream, limits_of(spark, [(k, "docs", 100.0) for k in range(100)])), f"{path}/rows", f"{path}/log").awaitTermination()
        # the last operator of the plan is operator 0
        held = spark.read.format("statestore").option("stateVarName", "usage").option("operatorId", 0).load(f"{path}/log")
        assert [r.tenant for r in held.select("key.tenant").collect()] == [99]
    assert spark.read.parquet(f"{path}/rows").count() == 20


@pytest.mark.parametrize("cut", [1, 4])
def test_retention_by_age_and_number(spark, tmp_path, cut):
    rng = np.random.default_rng(4)
    rows = [("ab"[int(rng.integers(0, 2))], k, int(t)) for k, t in enumerate(np.sort(rng.integers(0, 12 * DAY, 400)))] + [("a", 900, 12 * DAY), ("b", 901, 12 * DAY), ("c", 902, 30 * HOUR)]
    rows.sort(key=lambda r: r[2])
    parts = [rows[len(rows) * k // cut : len(rows) * (k + 1) // cut] for k in range(cut)]
    stream = batches(spark, str(tmp_path), parts, "key string, id long, ts long")
    path = new_folder(spark, "kept")
    with state.with_state(spark):
        streams.to_parquet(state.retention(stream, "key", 50, 3), f"{path}/gone", f"{path}/log").awaitTermination()
        kept = {(r.key, r.id) for r in state.retained(spark, f"{path}/log", "key").collect()}
    last = 12 * DAY - 600
    newest = {k: sorted((t, i) for key, i, t in rows if key == k)[-50:] for k in "abc"}
    want = {(k, i) for k, own in newest.items() for t, i in own if t + 3 * DAY >= last}
    gone = {(r.key, r.id): r.reason for r in spark.read.parquet(f"{path}/gone").collect()}
    assert kept == want and set(gone) == {(k, i) for k, i, _ in rows} - want and gone["c", 902] == "age" and "cap" in gone.values()


def test_completed_jobs_with_repeats_and_late_rows(spark, tmp_path):
    parts = [
        [("j1", 1, 0), ("j1", 2, 60), ("j2", 1, 30)],
        [("j1", 1, 0), ("j1", 3, 120), ("j2", 1, 30), ("j3", 1, 20 * HOUR)],
        [("j3", 1, 20 * HOUR)],
        # too late for the watermark, and what closes the rest
        [("j1", 9, 180), ("j3", 1, 20 * HOUR), ("j3", 2, 20 * HOUR + 60), ("j4", 1, 50 * HOUR)],
    ]
    stream = batches(spark, str(tmp_path), parts, "job string, region long, ts long")
    out = streams.run(streams.completed_jobs(stream, "job", "region"), "jobs")
    assert sorted((r.job, r.regions) for r in out.collect()) == [("j1", 3), ("j2", 1), ("j3", 2)]


def test_days_are_dropped_and_batches_may_repeat(spark, tmp_path):
    df = spark.createDataFrame([(k, k * DAY) for k in range(12)], "id long, ts long").withColumn("ts", F.timestamp_seconds(F.col("ts") + BASE))
    path = new_folder(spark, "days")
    for epoch, part in ((0, df.where("id < 6")), (0, df.where("id < 6")), (1, df.where("id >= 4"))):
        state.write_days(part, path, epoch, 5)
    got = spark.read.parquet(path)
    assert sorted(r.id for r in got.collect()) == [6, 7, 8, 9, 10, 11]
    plan = got.where("day = date '2024-01-08'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
