"""What the corpus operators share: folds, shared storage, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Edges that a task turns into stars at a time.
TASK_EDGES = 1 << 18


def fold(mod: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(mod))


def in_fold(mod: int, value: int, id_col: str = "doc_id") -> Column:
    """Whether the row lies in fold ``value``; false for a null id."""
    return F.coalesce(fold(mod, id_col) == value, F.lit(False))


def trainable(mod: int, held: int, id_col: str = "doc_id") -> Column:
    """Rows that may be learned from: a known id outside the held-out fold."""
    return F.coalesce(fold(mod, id_col) != held, F.lit(False))


def whole_id(df: DataFrame, name: str) -> Column:
    """An id column of ``df``: whole numbers as long, any other type as it is."""
    return F.col(name).cast("long") if isinstance(df.schema[name].dataType, T.IntegralType) else F.col(name)


def free(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores after it until it clashes with no column of ``taken``."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local session gets a temporary one;
    a cluster is refused, since its executors could not read it."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at durable files."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links between ``u`` and ``v`` as stars: each node that is linked, and the lowest it reaches."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, low = ends[: len(u)], ends[len(u) :], np.arange(len(nodes))
    while True:
        new, least = low.copy(), np.minimum(low[a], low[b])
        np.minimum.at(new, low[a], least)
        np.minimum.at(new, low[b], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == low).all():
            break
        low = new
    at = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[at], nodes[low[at]]


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) as stars, ``TASK_EDGES`` at a time."""

    def flush() -> pa.RecordBatch:
        found = contracted(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in "uv"))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["u", "v"])

    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= TASK_EDGES:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()


def settled(edge: DataFrame) -> bool:
    """Whether the edges (u, v) are stars: no u twice, and none that is a v too."""
    ends = edge.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionAll(edge.select("v", F.lit(0), F.lit(1)))
    node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not node.agg(F.max(F.expr("up > 1 OR up = 1 AND down = 1"))).first()[0]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component is the smallest
    node that links reach.

    Tasks of at most about ``TASK_EDGES`` edges each first turn their own into stars. Alternating large-star and
    small-star rounds follow until all edges are stars: each is two aggregations and two equi-joins on
    plain edge rows, so a hub of any degree is pre-aggregated or split by the skew join and never
    gathered in one task. Self-loops and null ends are ignored; an empty input gives no rows.
    """
    edge = materialize(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges"
    )
    tasks = max(1, -(-edge.count() // TASK_EDGES))
    edge = materialize(edge.coalesce(tasks).mapInArrow(stars, "u long, v long"), "edges")
    for _ in range(max_rounds):
        if settled(edge):
            break
        both = edge.unionAll(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u")
            .where("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(low2.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edge = materialize(small, "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edge.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edge.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
