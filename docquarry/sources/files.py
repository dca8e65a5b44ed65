"""Sources and sinks of documents: folders, JSON lines, manifests, layouts of OCR output, stage stores."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import quote, unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Sizes of a document that is read whole: a small one is no document, a large one no row.
LEAST, MOST = 100, 50 << 20
_FILE = "path string, modificationTime timestamp, length bigint, content binary"


@contextmanager
def bundles(spark: SparkSession, partition_bytes: int = 128 << 20, open_cost: int = 64 << 10) -> Iterator[None]:
    """Reads that are planned inside put many small files into one task, by their sizes; files that are named one by one, as those of
    a micro-batch are, get a few tasks for their listing and not one each."""
    names = {"spark.sql.files.maxPartitionBytes": partition_bytes, "spark.sql.files.openCostInBytes": open_cost, "spark.sql.sources.parallelPartitionDiscovery.parallelism": spark.sparkContext.defaultParallelism * 4}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def described(raw: DataFrame, content: bool) -> DataFrame:
    out = raw.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), "content")
    return out if content else out.drop("content")


def prefixed(path: str, prefix: str) -> str:
    """What a listing of ``path`` by the beginning of a key reads."""
    return f"{path.rstrip('/')}/{prefix}*" if prefix else path


def folder(spark: SparkSession, path: str, glob: str = "*", recursive: bool = False, content: bool = True, prefix: str = "", after: str | None = None, least: int = 0, most: int = (1 << 31) - 1) -> DataFrame:
    """path, name, size, modified, sha256 (and content) of the files of a folder or object-store prefix, a row each.

    ``prefix``: beginning of the keys below ``path`` (not only whole folder names); ``after``: modified since, as
    yyyy-MM-ddTHH:mm:ss; sizes between ``least`` and ``most`` bytes. Name, time and size are decided on the
    listing: no other file is opened."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    reader = reader if after is None else reader.option("modifiedAfter", after)
    return described(reader.load(prefixed(path, prefix)).where(F.col("length").between(least, most)), content)


def bundled(files: DataFrame, per_core: int = 8) -> DataFrame:
    """``files`` in at most so many tasks a core: a scan gives one to each 32 small files, however many there are (see ``bundles`` for
    reads that are planned at once)."""
    return files.coalesce(files.sparkSession.sparkContext.defaultParallelism * per_core)


def listing(spark: SparkSession, path: str, glob: str = "*", prefix: str = "") -> DataFrame:
    """path, name, size and modified of the files, none of which is opened."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(prefixed(path, prefix))
    return raw.select("path", "_metadata.file_name", "_metadata.file_size", "_metadata.file_modification_time").toDF("path", "name", "size", "modified")


def folder_stream(spark: SparkSession, path: str, glob: str = "*", prefix: str = "", content: bool = False, files: int = 1000) -> DataFrame:
    """``folder`` as a stream: each new file once, at most ``files`` of them in a micro-batch."""
    reader = spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files)
    return described(reader.load(prefixed(path, prefix)), content)


def write_files(df: DataFrame, path: str, text: str, by: str | None = None) -> None:
    """One file for each row: its text and a line end, in folders of ``by``.

    In a folder of the file system the rows' tasks write the files themselves: Hadoop's local file system starts two processes
    for each file (``chmod`` of it and of its checksum), and its committer moves them one by one. Elsewhere Spark writes them."""
    rows = df.select(*filter(None, [by]), F.col(text).alias("value"))
    if urlparse(path).scheme not in ("", "file"):
        out = rows.write.mode("append").option("maxRecordsPerFile", 1)
        (out.partitionBy(by) if by else out).text(path)
        return
    run, root = uuid.uuid4().hex, unquote(urlparse(path).path) if path.startswith("file:") else path
    names = F.monotonically_increasing_id().cast("string") if by is None else F.concat_ws("/", F.coalesce(F.col(by).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")), F.monotonically_increasing_id().cast("string"))
    os.makedirs(root, exist_ok=True)

    def write(part: Iterator) -> None:
        known = set()
        for name, value in part:
            shelf, _, n = name.rpartition("/")
            where = os.path.join(root, f"{by}={quote(shelf, ' ')}") if by else root
            if where not in known:
                os.makedirs(where, exist_ok=True)
                known.add(where)
            # seen by readers when it is whole; a task that is run again writes the same names
            hidden = os.path.join(where, f".{run}-{n}.{uuid.uuid4().hex}")
            with open(hidden, "wb") as f:
                f.write((value or b"") + b"\n")
            os.replace(hidden, os.path.join(where, f"part-{n}-{run}.txt"))

    rows.select(names, F.col("value").cast("binary")).foreachPartition(write)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """Records of JSON lines; blank and malformed lines are passed over, or fail the read if ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def malformed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The lines that do not fit the schema."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    read = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.select(read["_corrupt_record"].alias("line")).where("line IS NOT NULL")


def manifest(rows: DataFrame, files: DataFrame, name: str = "truth_path", depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rows with truth and sha256 of their file, rows without one) of a manifest (id, ``name``). files: path,
    content, sha256; ``name`` is the last ``depth`` parts of a path."""
    named = files.select(F.substring_index("path", "/", -depth).alias(name), F.col("content").cast("string").alias("truth"), "sha256")
    return rows.join(named, name), rows.join(named, name, "left_anti")


_BOX = "array<double>"
#: The four shapes in which OCR output comes.
LAYOUTS = {
    "pages": f"pages array<struct<elements array<struct<text string, bbox {_BOX}, confidence double>>>>",
    "text_regions": f"text_regions array<struct<text string, bbox {_BOX}, confidence double>>",
    "tokens": f"tokens array<string>, bboxes array<{_BOX}>, confidences array<double>",
    "text_blocks": f"text_blocks array<struct<text string, bbox {_BOX}, confidence double>>",
}


def regions_of(df: DataFrame, key: str, layout: str, least: float = 0.7) -> DataFrame:
    """(key, region_id, text, x, y, w, h, confidence) of one shape, confidence at least ``least`` (1 if unknown)."""
    return df.select(key, F.inline(cells_of(layout, least)))


def cells_of(layout: str, least: float = 0.7) -> Column:
    """``regions_of`` as an array in the row of the document, so that several shapes are read in one pass."""
    if layout == "pages":
        cells = F.flatten(F.transform("pages", lambda p: p["elements"]))
    elif layout == "tokens":
        zipped = F.arrays_zip("tokens", "bboxes", "confidences")
        cells = F.transform(zipped, lambda z: F.struct(z["tokens"].alias("text"), z["bboxes"].alias("bbox"), z["confidences"].alias("confidence")))
    else:
        cells = F.col(layout)
    at = lambda c, i: F.try_element_at(c["bbox"], F.lit(i))
    region = lambda c, i: F.struct(i.alias("region_id"), c["text"].alias("text"), *(at(c, k).alias(n) for k, n in enumerate("xywh", 1)), F.coalesce(c["confidence"], F.lit(1.0)).alias("confidence"))
    return F.filter(F.transform(cells, region), lambda r: r["confidence"] >= least)


def write_stage(df: DataFrame, path: str, stage: str = "stage") -> None:
    """One folder a stage; a reader that filters on the stage reads that folder only."""
    df.write.mode("append").partitionBy(stage).parquet(path)


def write_by_day(df: DataFrame, path: str, day: str) -> None:
    """Under year=/month=/day= of a date column. Days that ``df`` has replace those that are there; the others
    stay as they are."""
    parts = {"year": F.year(day), "month": F.date_format(day, "MM"), "day": F.date_format(day, "dd")}
    rows = df.withColumns(parts).repartition(*parts)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def write_parent_and_child(parent: DataFrame, child: DataFrame, path: str) -> None:
    """Two tables, the child keyed by the parent's id."""
    parent.write.mode("overwrite").parquet(f"{path}/invoices")
    child.write.mode("overwrite").parquet(f"{path}/line_items")


def write_targets(df: DataFrame, targets: dict[str, Callable[[DataFrame], None]]) -> list[tuple[str, bool, str]]:
    """Write to every target; one that fails does not stop the others. (target, whether it went, error)."""
    df.persist()
    try:
        out = []
        for name, write in targets.items():
            try:
                write(df)
                out.append((name, True, ""))
            except Exception as e:  # the record of a failed target is the result
                out.append((name, False, str(e).splitlines()[0]))
        return out
    finally:
        df.unpersist()


LEDGER = "batch long, target string, attempt int, went boolean, error string"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """What was tried: a row for each (batch, target, attempt)."""
    return spark.read.schema(LEDGER).json(path)


def load(df: DataFrame, targets: dict[str, Callable[[DataFrame], None]], path: str, batch: int) -> DataFrame:
    """``write_targets`` with a ledger at ``path``: a rerun of a batch writes to those targets only that it has not
    reached yet, so that each gets it once. The status rows of the batch so far."""
    spark = df.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("append").json(path)
    before = {r.target: (r.went, r.attempts) for r in ledger(spark, path).where(F.col("batch") == batch).groupBy("target").agg(F.bool_or("went").alias("went"), F.max("attempt").alias("attempts")).collect()}
    open_ = {name: write for name, write in targets.items() if not before.get(name, (False, 0))[0]}
    rows = [(batch, name, before.get(name, (False, 0))[1] + 1, went, error) for name, went, error in write_targets(df, open_)] if open_ else []
    spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("append").json(path)
    return ledger(spark, path).where(F.col("batch") == batch)


def write_error_log(errors: DataFrame, path: str) -> None:
    errors.write.mode("append").partitionBy("error").json(path)


def replay(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Logged errors back as rows."""
    return spark.read.schema(schema).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
