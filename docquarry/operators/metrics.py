"""Pipeline, quality and job metrics over event rows (document_id, stage, ms, success, ts, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_sum(c: str | Column) -> Column:
    """Sum of money-like doubles without order effects."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")).cast("double")


def trailing(df: DataFrame, as_of: str, minutes: int) -> DataFrame:
    """Rows of the window that ends at ``as_of``; with ``now`` as a value the result can be repeated."""
    return df.where(F.col("ts") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {minutes} minutes"))


def summary(df: DataFrame, *by: str) -> DataFrame:
    """total, successful, failed and rates; averages of confidence over positive values, validation over
    known ones (null without any)."""
    hundredths = F.sum(F.when(F.col("confidence") > 0, F.round(F.col("confidence") * 100))).cast("double")
    known = F.count("validation_passed")
    return df.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"), (F.count_if("success") / F.count("*")).alias("success_rate"),
        (exact_sum("ms") / F.count("*")).alias("avg_ms"), F.when(known > 0, F.count_if("validation_passed") / known).alias("validation_rate"),
        (hundredths / 100 / F.greatest(F.lit(1), F.count_if(F.col("confidence") > 0))).alias("avg_confidence"), (F.sum("field_count").cast("double") / F.count("*")).alias("avg_fields"),
    )


def stage_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("stage").agg(F.count("*").alias("n"), (exact_sum("ms") / F.count("*")).alias("avg_ms"))


def last_rows(df: DataFrame, n: int, *by: str) -> DataFrame:
    """The latest n rows, of each group if any is named. A whole-table limit is a top-k, not a sort; a group's
    rows are ranked within the group."""
    if not by:
        return df.orderBy(F.col("ts").desc(), F.col("document_id").desc()).limit(n)
    order = Window.partitionBy(*by).orderBy(F.col("ts").desc(), F.col("document_id").desc())
    return df.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= n).drop("__rank")


def quality(df: DataFrame) -> DataFrame:
    positive = F.count_if(F.col("confidence") > 0)
    known = F.count("validation_passed")
    fields = F.count_if(F.col("field_count") > 0)
    return df.agg(
        F.count("*").alias("samples"), F.when(fields > 0, F.sum("field_count") / fields).otherwise(F.lit(0.0)).alias("avg_fields"),
        F.when(positive > 0, F.sum(F.when(F.col("confidence") > 0, F.round(F.col("confidence") * 100))).cast("double") / 100 / positive).otherwise(F.lit(0.0)).alias("avg_confidence"),
        F.when(known > 0, F.count_if("validation_passed") / known).alias("validation_rate"), F.when(positive > 0, F.count_if(F.col("confidence") >= 0.8) / positive).otherwise(F.lit(0.0)).alias("high_confidence_rate"),
    )


def percentiles(df: DataFrame, value: str, points: tuple[int, ...] = (50, 95, 99), by: tuple[str, ...] = (), cuts: int = 64) -> DataFrame:
    """For each group: n, mean, least, most and the value at 0-based place floor(n * p / 100), n - 1 at most.

    Exact without one task for a group: values are counted, then cut into about ``cuts`` ranges at approximate
    quantiles; sums of ranges say which range holds each place, and only values of those are ranked. The
    quantiles steer the size of ranges, never the result. Null groups count as a group."""
    group = F.struct(*(by or (F.lit(1).alias("one"),))).alias("__g")
    rows = df.where(F.col(value).isNotNull()).select(group, F.col(value).alias("__v"))
    counted = rows.groupBy("__g", "__v").agg(F.count("*").alias("__c"))
    at = F.percentile_approx("__v", [k / cuts for k in range(1, cuts)], 10_000)
    range_of = F.size(F.filter("__s", lambda x: x < F.col("__v")))
    binned = counted.join(rows.groupBy("__g").agg(at.alias("__s")), "__g").withColumn("__b", range_of).drop("__s")

    whole = Window.partitionBy("__g")
    ranges = binned.groupBy("__g", "__b").agg(F.sum("__c").alias("__r"))
    ranges = ranges.withColumn("__upto", F.sum("__r").over(whole.orderBy("__b"))).withColumn("__n", F.sum("__r").over(whole))
    place = lambda p: F.least(F.floor(F.col("__n") * p / 100) + 1, F.col("__n"))
    holds = {p: (place(p) > F.col("__upto") - F.col("__r")) & (place(p) <= F.col("__upto")) for p in points}
    ranges = ranges.select("__g", "__b", (F.col("__upto") - F.col("__r")).alias("__before"), *(F.when(x, place(p)).alias(f"__p{p}") for p, x in holds.items()))
    ranked = binned.join(ranges.where(F.coalesce(*(f"__p{p}" for p in points)).isNotNull()), ["__g", "__b"])
    ranked = ranked.withColumn("__k", F.col("__before") + F.sum("__c").over(Window.partitionBy("__g", "__b").orderBy("__v")))
    found = ranked.groupBy("__g").agg(*(F.min(F.when(F.col("__k") >= F.col(f"__p{p}"), F.col("__v"))).alias(f"p{p}") for p in points))

    total = F.sum((F.col("__v").cast("decimal(18,2)") * F.col("__c")).cast("decimal(38,2)")).cast("double")
    facts = F.sum("__c").alias("n"), (total / F.sum("__c")).alias("mean"), F.min("__v").alias("least"), F.max("__v").alias("most")
    if not by:
        return counted.agg(*facts).withColumn("__g", F.struct(F.lit(1).alias("one"))).join(found, "__g", "left").drop("__g")
    return counted.groupBy("__g").agg(*facts).join(found, "__g").select("__g.*", "n", "mean", "least", "most", *(f"p{p}" for p in points))


def error_breakdown(df: DataFrame) -> DataFrame:
    return df.where(~F.col("success") & F.col("error_type").isNotNull()).groupBy("error_type").agg(F.count("*").alias("n"))


def counters(df: DataFrame, edges: tuple[float, ...] = (10, 50, 100, 250)) -> DataFrame:
    """Counts by stage and success, and of a duration histogram: bucket i holds values over i edges."""
    bucket = sum(((F.col("ms") > e).cast("int") for e in edges), F.lit(0))
    return df.groupBy("stage", "success", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, change, percent) of two long metric tables; percent is 0 for a base of 0 or less."""
    b, a = before.withColumnRenamed("value", "before"), after.withColumnRenamed("value", "after")
    percent = F.when(F.col("before") > 0, (F.col("after") - F.col("before")) / F.col("before") * 100).otherwise(F.lit(0.0))
    return b.join(a, "metric", "full").select("metric", "before", "after", (F.col("after") - F.col("before")).alias("change"), percent.alias("percent"))


def batch_metrics(df: DataFrame) -> DataFrame:
    """Pass rate, confidences, value and last currency of a batch of validated invoices."""
    percent = lambda f: f(F.round(F.col("confidence") * 100)).cast("double") / 100
    return df.agg(
        F.count("*").alias("documents"), F.count_if("math_ok").alias("passed"), (F.count_if("math_ok") / F.count("*")).alias("pass_rate"), (F.sum(F.round(F.col("confidence") * 100)).cast("double") / 100 / F.count("confidence")).alias("avg_confidence"),
        percent(F.min).alias("min_confidence"), percent(F.max).alias("max_confidence"), F.sum("total").cast("double").alias("total_value"), F.max_by("currency", "invoice_id").alias("currency"),
    )


def error_types(df: DataFrame, errors: str = "errors") -> DataFrame:
    """Counts of the part of each message before its first colon."""
    return df.select(F.explode(errors).alias("e")).groupBy(F.split_part("e", F.lit(":"), F.lit(1)).alias("error")).agg(F.count("*").alias("n"))


def stage_durations(df: DataFrame, key: str = "tenant") -> DataFrame:
    """Seconds to the next event of the same key; null for the last."""
    order = Window.partitionBy(key).orderBy("ts", "document_id")
    end = F.lead("ts").over(order)
    seconds = F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return df.withColumn("seconds", seconds / 1e6)


def illegal_transitions(df: DataFrame, legal: DataFrame, key: str = "tenant") -> DataFrame:
    """Events whose (previous stage, stage) is not among the legal pairs; a small table."""
    order = Window.partitionBy(key).orderBy("ts", "document_id")
    moves = df.withColumn("previous", F.lag("stage").over(order)).where("previous IS NOT NULL")
    return moves.join(legal, (F.col("previous") == F.col("from")) & (F.col("stage") == F.col("to")), "left_anti")


def latest(df: DataFrame, *key: str) -> DataFrame:
    """The latest row of each key, as an aggregate (which combines before the shuffle)."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("ts", "document_id")).alias("__row")).select(*key, "__row.*")


def queue_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.min("ts").cast("string").alias("oldest"), F.max("ts").cast("string").alias("newest"))


def reconcile(processed: DataFrame, incoming: DataFrame, text: str = "text") -> DataFrame:
    """Incoming rows whose content hash has not been processed."""
    digest = F.sha2(F.col(text).cast("binary"), 256)
    return incoming.withColumn("sha256", digest).join(processed.select(digest.alias("sha256")).distinct(), "sha256", "left_anti")
