"""Queries: streams over the event files, run to their end; each equals its batch twin."""

import os
import uuid

from pyspark.sql import functions as F

from docquarry.plans import views as W
from docquarry.registry import query
from docquarry.storage import new_folder
from docquarry.streaming import state as A
from docquarry.streaming import streams as S


def _name(label: str) -> str:
    return f"{label}_{uuid.uuid4().hex[:12]}"


def events(spark, d):
    """The events file (or folder of files) as a stream."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        out = reader.parquet(path)
    else:
        folder, name = os.path.split(path)
        out = reader.option("pathGlobFilter", name).parquet(folder)
    return out.withColumn("ts", F.col("ts").cast("timestamp"))


def usage(spark, d):
    resource = F.when(F.col("event_type") == "click", "api_requests").when(F.col("event_type") == "purchase", "documents").otherwise("storage_gb")
    return events(spark, d).select("event_id", F.col("user_id").alias("tenant"), resource.alias("resource"), F.col("value").cast("decimal(18,2)").alias("quantity"), "ts")


def metrics(spark, d):
    return events(spark, d).select(F.col("event_id").alias("document_id"), F.col("event_type").alias("stage"), F.col("value").alias("ms"), (F.col("event_type") != "error").alias("success"), "ts", F.col("user_id").alias("tenant"))


def text(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("st1_once_each", "select event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') ts from events")
def _(spark, d):
    twice = events(spark, d).unionAll(events(spark, d))
    out = S.run(S.once_each(twice, "event_id", late="60 days"), _name("st1"))
    return out.select("event_id", "user_id", text("ts"))


#: The watermark at the end of a stream of all events, and a time in whole milliseconds.
LAST = "(select epoch_ms(max(ts)) - 600000 from events)"


@query("st1_completed_jobs", f"""with g as (select user_id, ts, coalesce(cast(ts - lag(ts) over (partition by user_id order by ts) >= interval 6 hours as int), 1) n from events), s as (select user_id, ts, sum(n) over (partition by user_id order by ts rows unbounded preceding) k from g),
j as (select user_id, min(ts) a, max(ts) + interval 6 hours b, count(*) regions from s group by user_id, k) select user_id, strftime(a, '%Y-%m-%d %H:%M:%S') as start, strftime(b, '%Y-%m-%d %H:%M:%S') as "end", regions from j where epoch_ms(b) <= {LAST}""")
def _(spark, d):
    # every region is delivered twice
    twice = events(spark, d).unionAll(events(spark, d)).select("user_id", "event_id", "ts")
    out = S.run(S.completed_jobs(twice, "user_id", "event_id", "6 hours"), _name("st1"))
    return out.select("user_id", text("start"), text("end"), "regions")


for _width, _unit in (("1 hour", "hour"), ("1 day", "day")):

    @query(f"st2_usage_by_{_unit}", f"select strftime(date_trunc('{_unit}', ts), '%Y-%m-%d %H:%M:%S') as start, tenant, resource, cast(sum(quantity) as double) quantity, count(*) events from usage group by 1, 2, 3")
    def _(spark, d, width=_width):
        out = S.run(S.usage_windows(usage(spark, d), width), _name("st2"), "update")
        last = out.groupBy("start", "tenant", "resource").agg(F.max_by("quantity", "events").alias("quantity"), F.max("events").alias("events"))
        return last.select(text("start"), "tenant", "resource", F.col("quantity").cast("double").alias("quantity"), "events")


def limits(spark, d):
    """What a tenant may use of a resource in a month; storage without a limit."""
    tenant = W.table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("tenant"))
    of = F.array(F.struct(F.lit("documents").alias("resource"), (F.col("tenant") % 4 * 150.0).alias("limit")), F.struct(F.lit("api_requests").alias("resource"), (F.lit(200.0) + F.col("tenant") % 3 * 200.0).alias("limit")))
    return tenant.select("tenant", F.inline(of))


@query("st3_usage_alerts", f"""with recursive limits as (select c_custkey tenant, 'documents' resource, c_custkey % 4 * 150.0::double lim from customer union all select c_custkey, 'api_requests', 200.0::double + c_custkey % 3 * 200.0::double from customer),
hours as (select tenant, resource, date_trunc('hour', ts) h, sum(quantity) q from usage group by 1, 2, 3),
used as (select *, sum(q) over (partition by tenant, resource, date_trunc('month', h) order by h rows unbounded preceding) u from hours where epoch_ms(h + interval 1 hour) <= {LAST}),
over_ as (select tenant, resource, h, cast(u as double) used, lim from used join limits using (tenant, resource) where lim > 0 and u >= 0.8 * lim),
told as (select tenant, resource, min(h) h from over_ group by 1, 2 union all select * from (select t.tenant, t.resource, (select min(o.h) from over_ o where o.tenant = t.tenant and o.resource = t.resource and o.h >= t.h + interval 24 hours) h from told t) n where h is not null)
select tenant, resource, strftime(h, '%Y-%m-%d %H:%M:%S') as "hour", used, lim as "limit", used * 100 / lim percent from told join over_ using (tenant, resource, h)""")
def _(spark, d):
    with A.with_state(spark):
        out = S.run(A.usage_alerts(usage(spark, d), limits(spark, d)), _name("st3"))
    return out.select("tenant", "resource", text("hour"), "used", "limit", "percent")


def retained(spark, d, key, keep_days, cap=10_000):
    rows = events(spark, d).select(key.alias("key"), F.col("event_id").alias("id"), "ts")
    path = new_folder(spark, "st9")
    with A.with_state(spark):
        S.to_parquet(A.retention(rows, "key", cap, keep_days), f"{path}/gone", f"{path}/log").awaitTermination()
        return A.retained(spark, f"{path}/log", "key")


#: What is kept: (what, days).
KEPT = (("usage", 90), ("performance", 7), ("alert", 1))


@query("st9_retention", f"select event_type as \"key\", event_id id, what from (select *, row_number() over (partition by event_type order by epoch_ms(ts) desc, event_id desc) n from events), (values {', '.join(map(str, KEPT))}) v(what, days) where n <= 10000 and epoch_ms(ts) + cast(days as bigint) * 86400000 >= {LAST}")
def _(spark, d):
    out = None
    for what, days in KEPT:
        rows = retained(spark, d, F.col("event_type"), days).select("key", "id", F.lit(what).alias("what"))
        out = rows if out is None else out.unionAll(rows)
    return out


@query("st9_event_log", "select event_id id from (select *, row_number() over (order by epoch_ms(ts) desc, event_id desc) n from events) where n <= 10000")
def _(spark, d):
    # one log of the newest 10,000 of all: every shard keeps as many, the newest of theirs are the log
    shards = retained(spark, d, F.pmod("event_id", F.lit(16)), 365)
    return shards.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(10_000).select("id")


@query("st9_day_partitions", "select event_id, strftime(ts, '%Y-%m-%d') as \"day\" from events where cast(ts as date) >= (select cast(max(ts) as date) from events) - 7")
def _(spark, d):
    path = new_folder(spark, "days")
    S.to_targets(events(spark, d).select("event_id", "ts"), lambda part, epoch: A.write_days(part, f"{path}/rows", epoch, 7), f"{path}/log").awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("event_id", F.col("day").cast("string").alias("day"))


@query("st4_pipeline_windows", "select strftime(s, '%Y-%m-%d %H:%M:%S') as start, count(*) total, count(*) filter (not success) failed, cast(sum(cast(ms as decimal(18,2))) as double) / count(*) avg_ms from (select *, unnest([time_bucket(interval 5 minutes, ts) - to_minutes(5 * k) for k in range(12)]) s from pipeline_metrics) group by 1")
def _(spark, d):
    out = S.run(S.pipeline_windows(metrics(spark, d)), _name("st4"), "update")
    last = out.groupBy("start").agg(F.max_by(F.struct("total", "failed", "avg_ms"), "total").alias("x"))
    return last.select(text("start"), "x.total", "x.failed", "x.avg_ms")


@query("st5_hourly_requests", "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) n from events group by 1, 2")
def _(spark, d):
    df = events(spark, d).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
    out = S.run(df, _name("st5"), "update").groupBy("start", "event_type").agg(F.max("n").alias("n"))
    return out.select(text("start"), "event_type", "n")


@query("st7_job_progress", "select tenant, arg_max(stage, (ts, document_id)) stage, count(*) events from pipeline_metrics group by 1")
def _(spark, d):
    out = S.run(S.job_progress(metrics(spark, d), "tenant"), _name("st7"), "complete")
    return out


@query("st_sessions", """with g as (select tenant, ts, coalesce(cast(ts - lag(ts) over (partition by tenant order by ts) >= interval 30 minutes as int), 1) n from pipeline_metrics), s as (select tenant, ts, sum(n) over (partition by tenant order by ts rows unbounded preceding) k from g)
select strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, tenant, count(*) events from s group by tenant, k""")
def _(spark, d):
    batch = W.pipeline_metrics(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return S.sessions(batch, "tenant").select(text("start"), "tenant", "events")
