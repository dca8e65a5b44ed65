"""Streaming twins of the batch operators. Event time throughout; rows later than the watermark are dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docquarry.storage import new_folder


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A growing folder of Parquet files as a stream, event time as a timestamp (UTC session)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def once_each(df: DataFrame, *keys: str, late: str = "10 minutes") -> DataFrame:
    """Each key's first row only."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def usage_windows(df: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """Sums and counts by tenant, resource and tumbling window."""
    out = df.withWatermark("ts", late).groupBy(F.window("ts", width), "tenant", "resource").agg(F.sum("quantity").alias("quantity"), F.count("*").alias("events"))
    return out.select(F.col("window.start").alias("start"), "tenant", "resource", "quantity", "events")


def pipeline_windows(df: DataFrame, width: str = "60 minutes", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts, failures and mean duration by sliding window."""
    out = df.withWatermark("ts", late).groupBy(F.window("ts", width, slide)).agg(F.count("*").alias("total"), F.count_if(~F.col("success")).alias("failed"), F.sum(F.col("ms").cast("decimal(18,2)")).alias("ms"))
    return out.select(F.col("window.start").alias("start"), "total", "failed", (F.col("ms").cast("double") / F.col("total")).alias("avg_ms"))


def sessions(df: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A key's events until nothing comes for the gap."""
    out = df.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("events"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "events")


def job_progress(df: DataFrame, key: str) -> DataFrame:
    """The latest stage of each key; in update mode."""
    return df.groupBy(key).agg(F.max_by("stage", F.struct("ts", "document_id")).alias("stage"), F.count("*").alias("events"))


def completed_jobs(df: DataFrame, job: str, region: str, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(job, start, end, regions) of jobs that are complete: each region counts once however often it comes, and a
    job is over when nothing of it has come for the gap. Two stateful operators in one append stream."""
    once = df.withWatermark("ts", late).dropDuplicatesWithinWatermark([job, region])
    out = once.groupBy(F.session_window("ts", gap), job).agg(F.count("*").alias("regions"))
    return out.select(job, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "regions")


def run(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there now through the stream into Parquet files of the shared folder, read back. In
    update mode every version of a row, in complete mode the last table."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    rows = spark.createDataFrame([], df.schema)
    if mode == "append":
        to_parquet(df, f"{path}/rows", f"{path}/log").awaitTermination()
        return spark.read.schema(rows.schema).parquet(f"{path}/rows")

    def write(part: DataFrame, epoch: int) -> None:
        part.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={epoch}")

    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    rows.write.mode("append").parquet(f"{path}/rows")
    return spark.read.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{path}/rows")


def to_targets(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Every micro-batch to ``write``, which may have several targets; exactly once where it is idempotent."""
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Finished windows or rows appended to Parquet, exactly once."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
