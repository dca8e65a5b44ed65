"""Blocks of documents that ask shards for what only the whole corpus knows.

``pack`` puts documents into durable rows of about ``BLOCK_BYTES`` of text each, without a shuffle. A
block then sends each shard of a hash space the distinct values it holds (so a value that is hot in the
corpus crosses the shuffle once for each block, however often it stands there); shards answer, and the
answers meet the block again. Shards and blocks keep their size as the corpus grows; their numbers grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import materialize
from docquarry.llm.text import batches_of, texts_of

BLOCK_BYTES, SHARD_BYTES = 12 << 20, 24 << 20


def total_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def shards_for(size: int, most: int = 1 << 16) -> int:
    """Number of shards for ``size`` bytes of text."""
    return min(max(1, -(-size // SHARD_BYTES)), most)


def pack(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block long, doc_ids, offsets, body): whole texts (null as empty), compressed, in durable files.

    Block numbers hold the number of the task and are fixed once written; a task that is run again
    writes its own blocks anew and only one attempt is kept."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, number, own = TaskContext.get().partitionId() << 32, 0, None
        ids: list = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def row() -> pa.RecordBatch:
            offsets = np.append(0, np.cumsum(np.concatenate(sizes)))
            body = zstandard.compress(np.concatenate(parts).tobytes(), 3)
            return pa.RecordBatch.from_arrays(
                [pa.array([base + number], pa.int64()), pa.array([ids], pa.list_(own)), pa.array([offsets.tolist()], pa.list_(pa.int64())), pa.array([body], pa.binary())],
                ["block", "doc_ids", "offsets", "body"],
            )

        for batch in batches:
            own = batch.schema.field("doc_id").type
            batch_ids = batch.column("doc_id").to_pylist()
            data, offsets = texts_of(batch.column("text"))
            for a, b in batches_of(data, offsets, 1 << 20):
                size = int(offsets[b] - offsets[a])
                if held and held + size > block_bytes:
                    yield row()
                    ids, parts, sizes, held, number = [], [], [], 0, number + 1
                ids = ids + batch_ids[a:b]
                parts.append(data[offsets[a] : offsets[b]].copy())
                sizes.append(np.diff(offsets[a : b + 1]))
                held += size
        if ids:
            yield row()

    rows = docs.select("doc_id", "text").mapInArrow(scan, f"block long, doc_ids array<{kind}>, offsets array<long>, body binary")
    return materialize(rows, "blocks")


def unpacked(row: dict) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, bytes, offsets) of a packed row."""
    offsets = np.array(row["offsets"], np.int64)
    body = zstandard.decompress(row["body"], max_output_size=int(offsets[-1])) if offsets[-1] else b""
    return row["doc_ids"], np.frombuffer(body, np.uint8), offsets


def squeeze(values: np.ndarray) -> bytes:
    """Ascending 64-bit values by their differences, byte planes apart, compressed."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1) if len(values) else b""


def unsqueeze(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(zstandard.decompress(data, max_output_size=8 * n), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct values, how often each stands)"""
    if not len(values):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    values = np.sort(values)
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[first], np.diff(np.append(first, len(values)))


def in_sorted(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is among the ascending keys."""
    if not len(keys):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return keys[at] == values


def parted(keys: np.ndarray, shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions in keys, ascending) for each shard that has any."""
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        if edges[s] < edges[s + 1]:
            yield s, order[edges[s] : edges[s + 1]]
