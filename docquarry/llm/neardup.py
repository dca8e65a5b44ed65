"""SimHash near-duplicates found by the generalised pigeonhole principle.

Fingerprints: XXH64 (seed 42) of 3-word shingles, majority vote for each of 64 bits. Equal fingerprints
are one class. Correlated bits are put together into partitions; every fingerprint gets thresholds for
its partitions by dynamic programming over estimated candidate counts, whose sum makes a miss
impossible: with m partitions and t differing bits in all, thresholds t_i >= -1 with sum(t_i + 1) = t + 1
leave no room for a pair that exceeds each of them. Fingerprints probe all values within their
threshold of a partition and pairs that meet are verified.

The order of bits and the counts come from a bounded sample of classes (``SAMPLE`` of them, lowest
hash first) and steer cost only, never what is found. A value that more than ``HOT`` classes share is
not joined pair by pair: its classes are cut into blocks of ``BLOCK``, pairs of blocks are compared in
numpy, and each gives a spanning forest of the links it holds, at most one row for each class.

Defined cases: null and empty texts have fingerprint zero and link like any other; repeated rows and
ties fall to the smallest doc_id; an empty table gives an empty result; other columns are ignored.
A null doc_id is kept and counts as a document of its own id null when it is alone in its class.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import connected_components, materialize, whole_id
from docquarry.llm.text import LOWER, Words, batches_of, texts_of

SHINGLE, SEED, BITS = 3, 42, 64
#: Bits that linked fingerprints differ in at most, partitions, bound of the sample.
DISTANCE, PARTITIONS, SAMPLE = 2, 3, 20_000
#: Classes on one probed value that are still joined as rows; classes in a block beyond that.
HOT, BLOCK = 48, 2048


def fingerprints_of(column) -> np.ndarray:
    """The 64-bit fingerprint of each text of an Arrow column."""
    data, offsets = texts_of(column)
    out = np.zeros(len(offsets) - 1, np.uint64)
    for a, b in batches_of(data, offsets, 1 << 20):
        out[a:b] = _fingerprints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
    return out


def _fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    words = Words(LOWER[data], offsets)
    n = words.counts
    out = np.zeros(len(n), np.uint64)
    if not len(words):
        return out
    # words of a document with one space between them
    length = words.end - words.start
    final = np.zeros(len(words), bool)
    final[words.first[1:][n > 0] - 1] = True
    size = length + ~final
    start = np.cumsum(size) - size
    source = np.arange(size.sum()) + np.repeat(words.start - start, size)
    line = words.data[np.minimum(source, len(data) - 1)]
    line[(start + length)[~final]] = 0x20
    end = start + length
    # shingles: the first word of each, and its last
    several = np.maximum(n - SHINGLE + 1, n > 0)
    of = np.repeat(np.arange(len(n)), several)
    first = np.arange(len(of)) - np.repeat(np.cumsum(several) - several, several) + words.first[of]
    last = np.minimum(first + SHINGLE, words.first[of + 1]) - 1
    view, digest = memoryview(line.tobytes()), xxhash.xxh64_intdigest
    h = np.fromiter((digest(view[x:y], SEED) for x, y in zip(start[first].tolist(), end[last].tolist(), strict=True)), np.uint64, len(first))
    at = np.cumsum(several) - several
    for d in np.flatnonzero(several):
        out[d] = majority(h[at[d] : at[d] + several[d]])
    return out


def majority(h: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes; zero without any."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 14):
        part = h[k : k + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]


def with_fingerprints(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The ``keep`` columns and __fp, the fingerprint as a signed long."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array(fingerprints_of(batch.column("text")).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), fp], [*keep, "__fp"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(scan, f"{schema}, __fp long")


def bits_of(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def partitions_of(sample: np.ndarray, m: int = PARTITIONS) -> list[list[int]]:
    """The 64 bits in m groups of nearly equal size, each grown from a bit by the largest mean
    correlation with those already in it."""
    bits = bits_of(sample).astype(float) if len(sample) else np.zeros((1, BITS))
    bits -= bits.mean(axis=0)
    scale = np.sqrt((bits**2).sum(axis=0)) + 1e-12
    near = np.abs(bits.T @ bits) / np.outer(scale, scale)
    np.fill_diagonal(near, 0)
    left, groups = list(range(BITS)), []
    for k in range(m):
        size = (BITS - sum(map(len, groups))) // (m - k)
        group = [max(left, key=lambda b: (near[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (near[b, group].mean(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def value_of(fp: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of ``group`` as one number."""
    fp, out = fp.astype(np.int64).view(np.uint64), np.zeros(len(fp), np.uint64)
    for k, b in enumerate(group):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


class Plan:
    """Partitions, and how often the sample has each value of them."""

    def __init__(self, sample: np.ndarray, total: int, distance: int = DISTANCE, m: int = PARTITIONS):
        self.distance, self.groups = distance, partitions_of(sample, m)
        self.scale = max(1.0, total / max(1, len(sample)))
        self.seen = [np.unique(value_of(sample, g), return_counts=True) for g in self.groups]

    def count(self, i: int, values: np.ndarray) -> np.ndarray:
        keys, n = self.seen[i]
        if not len(keys):
            return np.zeros(len(values))
        at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
        return np.where(keys[at] == values, n[at], 0) * self.scale

    def thresholds(self, fp: np.ndarray) -> np.ndarray:
        """(fingerprints, partitions): the allocation of least estimated cost with sum(t + 1) = distance + 1.

        cost[i][u]: candidates and probes of partition i at threshold u - 1; beyond one flipped bit the
        count of one flip is carried on by the number of probes."""
        top, costs = self.distance + 1, []
        for i, group in enumerate(self.groups):
            v, w = value_of(fp, group), len(group)
            own = self.count(i, v)
            one = own + sum(self.count(i, v ^ np.uint64(1 << k)) for k in range(w))
            probes, cost = [1], [np.zeros(len(fp)), own + 1, one + 1 + w]
            for u in range(1, top + 1):
                probes.append(probes[-1] + comb(w, u))
            cost += [one * probes[u - 1] / probes[1] + probes[u - 1] for u in range(3, top + 1)]
            costs.append(cost[: top + 1])
        best = np.full((len(fp), top + 1), np.inf)
        best[:, 0], choice = 0, []
        for cost in costs:
            new, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int64)
            for u, c in enumerate(cost):
                for s in range(u, top + 1):
                    x = best[:, s - u] + c
                    less = x < new[:, s]
                    new[less, s], pick[less, s] = x[less], u
            best = new
            choice.append(pick)
        left, out = np.full(len(fp), top), np.zeros((len(fp), len(costs)), np.int64)
        for i in reversed(range(len(costs))):
            out[:, i] = choice[i][np.arange(len(fp)), left]
            left = left - out[:, i]
        return out - 1

    def probes(self, fp: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
        """(partition, rows of fp, values, whether it is their own)."""
        t = self.thresholds(fp)
        for i, group in enumerate(self.groups):
            v, w = value_of(fp, group), len(group)
            yield i, np.arange(len(fp)), v, True
            for u in range(1, int(t[:, i].max(initial=0)) + 1):
                some = np.flatnonzero(t[:, i] >= u)
                for flips in combinations(range(w), u):
                    yield i, some, v[some] ^ np.uint64(sum(1 << k for k in flips)), False


def forest(near: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each row of a boolean square matrix."""
    label = np.arange(len(near))
    while True:
        low = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def links(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): enough links between the classes (__fp, __rep) that what they join is joined."""
    spark = classes.sparkSession
    total = classes.count()
    sample = classes.select("__fp").orderBy(F.xxhash64("__fp"), "__fp").limit(SAMPLE).toPandas()["__fp"].to_numpy(np.int64)
    plan = spark.sparkContext.broadcast(Plan(sample, total, distance))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, rep = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__fp", "__rep"))
            t = plan.value.thresholds(fp)
            for i, rows, values, own in plan.value.probes(fp):
                n = len(rows)
                asks = t[rows, i] >= 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, i, np.int32)), pa.array(values.view(np.int64)), pa.array(fp[rows]), pa.array(rep[rows]), pa.array(np.full(n, own)), pa.array(asks)],
                    ["part", "value", "fp", "rep", "held", "asks"],
                )

    rows = materialize(classes.select("__fp", "__rep").mapInArrow(probe, "part int, value long, fp long, rep long, held boolean, asks boolean"), "probes")
    sizes = rows.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    rows = rows.join(sizes, ["part", "value"])
    cold = rows.where(F.col("n") <= HOT)
    asks = cold.where("asks").select("part", "value", F.col("fp").alias("fp1"), F.col("rep").alias("rep1"))
    held = cold.where("held").select("part", "value", F.col("fp").alias("fp2"), F.col("rep").alias("rep2"))
    near = F.bit_count(F.col("fp1").bitwiseXOR(F.col("fp2"))) <= distance
    same = (asks["part"] == held["part"]) & (asks["value"] == held["value"])
    few = asks.join(held, same & (F.col("fp1") != F.col("fp2")) & near).select(F.col("rep1").alias("a"), F.col("rep2").alias("b"))

    cuts = F.ceil(F.col("n") / BLOCK).cast("int")
    hot = rows.where(F.col("n") > HOT).withColumn("cuts", cuts).withColumn("cut", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
    hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    hot = hot.withColumn("x", F.least("cut", "other")).withColumn("y", F.greatest("cut", "other"))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, rep = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["rep"].to_numpy(np.int64)
        asks, held = pdf["asks"].to_numpy(bool), pdf["held"].to_numpy(bool)
        close = np.zeros((len(fp), len(fp)), bool)
        for k in range(0, len(fp), 256):
            close[k : k + 256] = (popcount(fp[k : k + 256, None] ^ fp[None, :]) <= distance) & asks[k : k + 256, None] & held[None, :]
        close |= close.T
        label = forest(close)
        low = np.full(len(fp), np.iinfo(np.int64).max)
        np.minimum.at(low, label, rep)
        out = pd.DataFrame({"a": rep, "b": low[label]})
        return out[out.a != out.b].drop_duplicates()

    many = hot.groupBy("part", "value", "x", "y").applyInPandas(verify, "a long, b long")
    return few.unionAll(many)


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (of the type of doc_id, whole numbers as long) of
    each document."""
    prints = materialize(with_fingerprints(docs, ("doc_id",)), "prints")
    known = prints.where("doc_id IS NOT NULL").groupBy("__fp").agg(F.min(whole_id(docs, "doc_id")).alias("__id"))
    classes = materialize(known.withColumn("__rep", F.col("__fp")), "classes")
    parts = connected_components(links(classes, distance))
    where = classes.join(parts, F.col("__rep") == F.col("node"), "left").select("__fp", "__id", F.coalesce("component", "__rep").alias("__component"))
    least = where.groupBy("__component").agg(F.min("__id").alias("component_id"))
    whole = prints.join(where.join(least, "__component").select("__fp", "component_id"), "__fp", "left")
    return whole.select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")
