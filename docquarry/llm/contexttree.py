"""Code lengths by context-tree weighting over bytes.

A text is read as its words (A-Z lower-cased) with one space between them and one end byte. Each byte is
eight binary decisions; each decision has its own tree over the last 0..DEPTH bytes. A node (context,
bits so far) holds counts a, b of its decision over all training texts; its Krichevsky-Trofimov
probability follows from the counts alone, and the weighted probability is half of that and half of the
product over the contexts one byte longer. The tree is then fixed: a decision's probability mixes the
estimates of all depths by the posterior weight of stopping at each; a longer context that was never
seen has no say. Code length is -log2 of the product.

Where the work is: a block counts its distinct (context, byte) pairs; pairs go to the shard of their two
nearest context bytes, which holds the whole tree below that context. Depths 0 and 1 span shards and are
two tables of fixed size (256 x 256 nodes), summed in Spark and broadcast. Blocks ask shards for the
log-probability of each distinct pair and add up over their texts. Nothing is sampled or capped, and what
is gathered grows with the corpus.

Word counts for the unigram base go the same way, by word hash.

Defined cases: null and empty texts are the end alone; without training texts every decision is even and
the base is that of no counts; repeated rows count and are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
import zlib
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.blocks import distinct, pack, parted, shards_for, squeeze, total_bytes, unpacked, unsqueeze
from docquarry.llm.common import in_fold, materialize, trainable
from docquarry.llm.text import LOWER, Words, batches_of, joined, mixed

#: Context bytes at most; the nearest SPLIT of them choose the shard.
DEPTH, SPLIT = 5, 2
END_BYTE = 0x0A
LOG10_2 = np.log10(2.0)

_LGAMMA: list[np.ndarray] = []


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the KT probability of a zeros and b ones, from exact gamma values or Stirling's series."""

    def lg(x: np.ndarray) -> np.ndarray:
        if not _LGAMMA:
            _LGAMMA.append(np.array([lgamma(0.5 * k) if k else 0.0 for k in range(1 << 14)]))
        small = x < (1 << 13) - 1
        out = np.empty(len(x))
        out[small] = _LGAMMA[0][np.rint(2 * x[small]).astype(np.int64)]
        y = x[~small]
        out[~small] = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3)
        return out

    a, b = a.astype(float), b.astype(float)
    return lg(a + 0.5) + lg(b + 0.5) - 2 * lgamma(0.5) - lg(a + b + 1)


# ------------------------------------------------------------------------------------------- streams


def streams(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, starts of documents): for each byte to code, its DEPTH context bytes, nearest first, then
    itself, as one number; contexts before a text are zero bytes."""
    line, ends, _ = joined(words)
    n = np.diff(ends)
    size = n + DEPTH + 1
    first = np.cumsum(size) - size
    stream = np.zeros(int(size.sum()), np.uint8)
    of = np.repeat(np.arange(len(n)), n)
    stream[np.arange(len(line)) - ends[of] + first[of] + DEPTH] = line
    stream[first + size - 1] = END_BYTE
    code = np.ones(len(stream), bool)
    for k in range(DEPTH):
        code[first + k] = False
    at = np.flatnonzero(code)
    pair = stream[at].astype(np.uint64)
    for k in range(1, DEPTH + 1):
        pair |= stream[at - k].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - k))
    return pair, np.cumsum(n + 1) - (n + 1)


def shard_of(pair: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(pair >> np.uint64(8 * (DEPTH + 1 - SPLIT))) % np.uint64(shards)).astype(np.int64)


# ---------------------------------------------------------------------------------------------- tree


class Level:
    """Nodes of one depth: ascending keys (context << 8 | bits so far with a leading 1), counts, and the
    log of the weighted probability."""

    def __init__(self, pairs: np.ndarray, n: np.ndarray):
        context, byte = pairs >> np.uint64(8), (pairs & np.uint64(0xFF)).astype(np.int64)
        keys, ones, counts = [], [], []
        for j in range(8):
            keys.append((context << np.uint64(8)) | ((1 << j) | (byte >> (8 - j))).astype(np.uint64))
            ones.append((byte >> (7 - j)) & 1)
            counts.append(n)
        keys, ones, counts = map(np.concatenate, (keys, ones, counts))
        self.keys, back = np.unique(keys, return_inverse=True)
        self.b = np.bincount(back, ones * counts, len(self.keys))
        self.a = np.bincount(back, counts, len(self.keys)) - self.b
        self.kt = log_kt(self.a, self.b)
        self.weighted = self.kt

    def above(self, pairs: np.ndarray, n: np.ndarray) -> Level:
        """The level one byte shorter, from its (context, byte) counts; this level is below it."""
        level = Level(pairs, n)
        level.weigh(np.bincount(np.searchsorted(level.keys, self.parents()), self.weighted, len(level.keys)))
        return level

    def parents(self) -> np.ndarray:
        return ((self.keys >> np.uint64(16)) << np.uint64(8)) | (self.keys & np.uint64(0xFF))

    def weigh(self, below: np.ndarray) -> None:
        self.weighted = np.logaddexp(self.kt, below) - np.log(2)


def shorter(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) counts with the farthest context byte dropped."""
    keys, back = np.unique(((pairs >> np.uint64(16)) << np.uint64(8)) | (pairs & np.uint64(0xFF)), return_inverse=True)
    return keys, np.bincount(back, n, len(keys))


def shard_levels(pairs: np.ndarray, n: np.ndarray) -> list[Level]:
    """Levels of depth DEPTH, DEPTH - 1, ..., SPLIT under the contexts of a shard."""
    levels = [Level(pairs, n)]
    for _ in range(DEPTH - SPLIT):
        pairs, n = shorter(pairs, n)
        levels.append(levels[-1].above(pairs, n))
    return levels


class Top:
    """Depths 0 and 1: for each node the estimate of a one, the weight of stopping, and whether it was seen."""

    def __init__(self, table: pd.DataFrame):
        """``table``: node (of depth 1), a, b, and the summed log weights of its children."""
        one = self._level(table["node"].to_numpy(np.int64), table[["a", "b", "below"]].to_numpy(float), 1 << 16)
        bits = table["node"].to_numpy(np.int64) & 0xFF
        zero_below = np.column_stack([table["a"], table["b"], one[3][table["node"].to_numpy(np.int64)]]) if len(table) else np.zeros((0, 3))
        zero = self._level(bits, zero_below, 256)
        self.depths = [zero[:3], one[:3]]

    @staticmethod
    def _level(node: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
        a, b, below = (np.bincount(node, values[:, k], size) for k in range(3))
        kt = log_kt(a, b)
        weighted = np.logaddexp(kt, below) - np.log(2)
        return (b + 0.5) / (a + b + 1), np.exp(np.minimum(kt - np.log(2) - weighted, 0)), a + b > 0, weighted


def log_probabilities(pairs: np.ndarray, levels: list[Level], top: Top) -> np.ndarray:
    """log2 of the probability of each pair's byte in its context."""
    out, byte = np.zeros(len(pairs)), (pairs & np.uint64(0xFF)).astype(np.int64)
    for j in range(8):
        bits = ((1 << j) | (byte >> (8 - j))).astype(np.uint64)
        p, seen = np.full(len(pairs), 0.5), np.zeros(len(pairs), bool)
        for depth in range(DEPTH, -1, -1):
            node = ((pairs >> np.uint64(8 * (DEPTH + 1 - depth))) << np.uint64(8)) | bits
            if depth >= SPLIT:
                level = levels[DEPTH - depth]
                if not len(level.keys):
                    continue
                at = np.minimum(np.searchsorted(level.keys, node), len(level.keys) - 1)
                held = level.keys[at] == node
                a, b = level.a[at], level.b[at]
                one, stop = (b + 0.5) / (a + b + 1), np.exp(level.kt[at] - np.log(2) - level.weighted[at]) if depth < DEPTH else np.ones(len(at))
                held &= a + b > 0
            else:
                node = node.astype(np.int64)
                one, stop, held = (x[node] for x in top.depths[depth])
            mix = np.where(seen, stop * one + (1 - stop) * p, one)
            p = np.where(held, mix, p)
            seen |= held
        bit = (byte >> (7 - j)) & 1
        out += np.log2(np.where(bit == 1, p, 1 - p))
    return out


# --------------------------------------------------------------------------------------------- Spark


def _parts(row: dict) -> Iterator[tuple[Words, np.ndarray]]:
    ids, data, offsets = unpacked(row)
    trains = np.array([x["trains"] for x in ids], bool)
    for a, b in batches_of(data, offsets, 2 << 20):
        yield Words(LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]), trains[a:b]


def _counted(values: list[np.ndarray], trained: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct values, how often each stands in training texts)"""
    keys = distinct(np.concatenate([np.zeros(0, np.uint64), *values]))[0]
    known, n = distinct(np.concatenate([np.zeros(0, np.uint64), *trained]))
    out = np.zeros(len(keys), np.int64)
    out[np.searchsorted(keys, known)] = n
    return keys, out


def _block_pairs(row: dict, counted: bool = True):
    pairs, trained, starts, base = [], [], [], 0
    for words, trains in _parts(row):
        pair, first = streams(words)
        pairs.append(pair)
        starts.append(first + base)
        base += len(pair)
        if counted:
            trained.append(pair[np.repeat(trains, np.diff(np.append(first, len(pair))))])
    return pairs, trained, np.concatenate(starts) if starts else np.zeros(0, np.int64)


def _block_words(row: dict):
    hashes, trained, counts = [], [], []
    for words, trains in _parts(row):
        h = words.hashes()
        hashes.append(h)
        counts.append(words.counts)
        trained.append(h[np.repeat(trains, words.counts)])
    return hashes, trained, np.concatenate(counts) if counts else np.zeros(0, np.int64)


ASKS = "kind string, shard int, block long, n int, keys binary, counts binary"


def asks(packed: DataFrame, shards: int) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for kind, made, place in (("pair", _block_pairs, shard_of), ("word", _block_words, lambda x, s: (x % np.uint64(s)).astype(np.int64))):
                    values, trained, _ = made(row)
                    keys, n = _counted(values, trained)
                    del values, trained
                    for s, at in parted(keys, place(keys, shards), shards):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([kind]), pa.array([s], pa.int32()), pa.array([row["block"]], pa.int64()), pa.array([len(at)], pa.int32()), pa.array([squeeze(keys[at])], pa.binary()), pa.array([squeeze_counts(n[at])], pa.binary())],
                            ["kind", "shard", "block", "n", "keys", "counts"],
                        )

    return materialize(packed.mapInArrow(ask, ASKS), "asks")


def squeeze_counts(n: np.ndarray) -> bytes:
    return zlib.compress(n.astype("<u8").tobytes(), 1)


def unsqueeze_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<u8").astype(np.int64)


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a shard's asks and their counts over all blocks."""
    columns = [table.column(c).to_pylist() for c in ("keys", "n", "counts")]
    every = [unsqueeze(k, n) for k, n in zip(*columns[:2], strict=True)]
    keys = distinct(np.concatenate(every))[0]
    total = np.zeros(len(keys), np.int64)
    for k, c in zip(every, columns[2], strict=True):
        total[np.searchsorted(keys, k)] += unsqueeze_counts(c)
    return keys, total


def pair_model(pairs: DataFrame) -> DataFrame:
    """(shard, keys, counts) of the trained pairs of each shard, and its part of depth 1 as ``top``."""

    def build(table: pa.Table) -> pa.Table:
        keys, n = _merged(table)
        keys, n = keys[n > 0], n[n > 0]
        top = pa.array([[]], pa.list_(TOP_ROW))
        if len(keys):
            low = shard_levels(keys, n)[-1]
            node = low.parents()
            names, back = np.unique(node, return_inverse=True)
            a, b, below = (np.bincount(back, x, len(names)) for x in (low.a, low.b, low.weighted))
            top = pa.array([[{"node": int(x), "a": p, "b": q, "below": w} for x, p, q, w in zip(names, a, b, below, strict=True)]], pa.list_(TOP_ROW))
        return pa.table({"shard": table.column("shard").slice(0, 1), "n": pa.array([len(keys)], pa.int32()), "keys": pa.array([squeeze(keys)], pa.binary()), "counts": pa.array([squeeze_counts(n)], pa.binary()), "top": top})

    return materialize(pairs.groupBy("shard").applyInArrow(build, "shard int, n int, keys binary, counts binary, top array<struct<node:long,a:double,b:double,below:double>>"), "model")


TOP_ROW = pa.struct([("node", pa.int64()), ("a", pa.float64()), ("b", pa.float64()), ("below", pa.float64())])


def pair_answers(pairs: DataFrame, model: DataFrame) -> DataFrame:
    """(block, kind, shard, values): log2 probabilities of a block's pairs, in their order."""
    rows = model.select(F.explode("top").alias("t")).select("t.*").groupBy("node").agg(*(F.sum(c).alias(c) for c in ("a", "b", "below")))
    top = pairs.sparkSession.sparkContext.broadcast(Top(rows.orderBy("node").toPandas()))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        levels = [Level(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * (DEPTH - SPLIT + 1)
        for r in left.to_pylist():
            if r["n"]:
                levels = shard_levels(unsqueeze(r["keys"], r["n"]), unsqueeze_counts(r["counts"]))
        asked = [unsqueeze(k, n) for k, n in zip(right.column("keys").to_pylist(), right.column("n").to_pylist(), strict=True)]
        keys = distinct(np.concatenate([np.zeros(0, np.uint64), *asked]))[0]
        logs = np.zeros(len(keys), np.float32)
        for k in range(0, len(keys), 1 << 18):
            logs[k : k + (1 << 18)] = log_probabilities(keys[k : k + (1 << 18)], levels, top.value)
        values = [logs[np.searchsorted(keys, k)].tobytes() for k in asked]
        return pa.table({"block": right.column("block"), "kind": right.column("kind"), "shard": right.column("shard"), "values": pa.array(values, pa.binary())})

    both = model.select("shard", "n", "keys", "counts").groupBy("shard").cogroup(pairs.groupBy("shard"))
    return both.applyInArrow(answer, "block long, kind string, shard int, values binary")


def word_answers(words: DataFrame) -> DataFrame:
    """(block, kind, shard, values): training counts of a block's words, in their order; and for each
    shard a row of block -1 with its tokens and distinct words."""

    def answer(table: pa.Table) -> pa.Table:
        keys, total = _merged(table)
        shard = table.column("shard")[0].as_py()
        asked = [unsqueeze(k, n) for k, n in zip(table.column("keys").to_pylist(), table.column("n").to_pylist(), strict=True)]
        values = [squeeze_counts(total[np.searchsorted(keys, k)]) for k in asked]
        sums = np.array([total.sum(), (total > 0).sum()], np.int64).tobytes()
        return pa.table({"block": pa.array([*table.column("block").to_pylist(), -1], pa.int64()), "kind": pa.array(["word"] * (len(asked) + 1)), "shard": pa.array([shard] * (len(asked) + 1), pa.int32()), "values": pa.array([*values, sums], pa.binary())})

    return materialize(words.groupBy("shard").applyInArrow(answer, "block long, kind string, shard int, values binary"), "counts")


def _lined_up(keys: np.ndarray, place: np.ndarray, shards: int, values: dict[int, np.ndarray], kind: type) -> np.ndarray:
    out = np.zeros(len(keys), kind)
    for s, at in parted(keys, place, shards):
        out[at] = values[s]
    return out


def scores(docs: DataFrame, mod: int = 10, held: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and code_length (bits for a
    byte of the coded text) of each document."""
    shards = shards_for(total_bytes(docs))
    # what a document is called, and whether it is learned from, travel as one
    packed = pack(docs.select(F.struct("doc_id", trainable(mod, held).alias("trains")).alias("doc_id"), "text"))
    asked = asks(packed, shards)
    pairs = asked.where("kind = 'pair'").drop("kind").withColumn("kind", F.lit("pair"))
    words = asked.where("kind = 'word'")
    counted = word_answers(words)
    ends = docs.where(trainable(mod, held)).count()
    sums = [np.frombuffer(r[0], np.int64) for r in counted.where("block = -1").select("values").collect()]
    n_all = int(sum(x[0] for x in sums)) + ends
    distinct_all = int(sum(x[1] for x in sums)) + (ends > 0)
    answers = counted.where("block >= 0").unionAll(pair_answers(pairs, pair_model(pairs)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        got: dict[str, dict[int, bytes]] = {"word": {}, "pair": {}}
        for k, s, v in zip(*(right.column(c).to_pylist() for c in ("kind", "shard", "values")), strict=True):
            got[k][s] = v
        own = left.schema.field("doc_ids").type.value_type.field("doc_id").type
        base_unit = np.log10(n_all + 0.1 * (distinct_all + 1)) if n_all or distinct_all else np.log10(0.1)
        out = []
        for row in left.to_pylist():
            hashes, _, counts = _block_words(row)
            keys = distinct(np.concatenate([np.zeros(0, np.uint64), *hashes]))[0]
            known = _lined_up(keys, (keys % np.uint64(shards)).astype(np.int64), shards, {s: unsqueeze_counts(v) for s, v in got["word"].items()}, np.int64)
            n = len(counts)
            of = np.repeat(np.arange(n), counts)
            c = known[np.searchsorted(keys, np.concatenate([np.zeros(0, np.uint64), *hashes]))]
            base = np.bincount(of, np.log10(c + 0.1) - base_unit, n) + np.log10(ends + 0.1) - base_unit
            n_known = np.bincount(of, c > 0, n).astype(np.int64) + (ends > 0)
            del hashes, c, of
            parts, _, starts = _block_pairs(row, counted=False)
            keys = distinct(np.concatenate([np.zeros(0, np.uint64), *parts]))[0]
            logs = _lined_up(keys, shard_of(keys, shards), shards, {s: np.frombuffer(v, np.float32) for s, v in got["pair"].items()}, np.float64)
            bits = np.concatenate([logs[np.searchsorted(keys, p)] for p in parts]) if parts else np.zeros(0)
            total = np.add.reduceat(bits, starts) if n else np.zeros(0)
            size = np.diff(np.append(starts, len(bits)))
            out.append(pa.table({"doc_id": pa.array([x["doc_id"] for x in row["doc_ids"]], own), "n_tokens": counts + 1, "n_known": n_known, "base_score": base, "score": total * LOG10_2, "code_length": -total / size}))
        return pa.concat_tables(out)

    both = packed.groupBy("block").cogroup(answers.groupBy("block"))
    out = both.applyInArrow(score, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, code_length double")
    return out.select("doc_id", in_fold(mod, held).alias("held_out"), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score", "code_length")
