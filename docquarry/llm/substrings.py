"""Removal of repeated token windows.

Every run of ``WINDOW`` words gets a Rabin-Karp hash (a rolling polynomial over 64-bit word hashes, modulo
2**64, then mixed) and ``CHECK_BITS`` bits of a second one over other word hashes. Hashes are counted over the whole corpus: a block sends each of its distinct hashes
once, marked if it holds it twice, to the shard of the hash; a shard names those that stand more than
once. Words that a repeated window covers are removed; windows that overlap or touch merge into maximal
intervals.

Defined cases: null, empty and short texts have no window and stay as they are, words joined by one space;
repeated rows are copies of each other, so their windows repeat; all copies are removed, none is
preferred; an empty table gives an empty result; other columns are ignored. Two different windows are
taken for equal with probability 2**-88 a pair: in 10**13 windows (about 100 TB) some 0.2 such pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.blocks import distinct, in_sorted, pack, parted, shards_for, squeeze, total_bytes, unpacked, unsqueeze
from docquarry.llm.text import Words, batches_of, joined, mixed

WINDOW, CHECK_BITS = 35, 24
SPAN = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def window_hashes(data: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[int, Words, np.ndarray, np.ndarray]]:
    """(first document, words, first word of each window, its hash) by parts of the block."""
    for a, b in batches_of(data, offsets, 4 << 20):
        words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, words, *words.windows(window, words.hashes())


def checks(words: Words, window: int) -> np.ndarray:
    """Bits of a second hash of each window."""
    return (words.windows(window, mixed(words.hashes() ^ np.uint64(0xA5A5A5A5A5A5A5A5)))[1] >> np.uint64(64 - CHECK_BITS)).astype("<u4")


def grouped(keys: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal (key, check) together, keys ascending, and where each begins in it."""
    order = np.argsort(keys, kind="stable")
    same, other = keys[order[1:]] == keys[order[:-1]], check[order[1:]] != check[order[:-1]]
    if (same & other).any():
        order = np.lexsort((check, keys))
        same, other = keys[order[1:]] == keys[order[:-1]], check[order[1:]] != check[order[:-1]]
    return order, np.flatnonzero(np.append(np.ones(min(len(keys), 1), bool), ~same | other))


def repeated_hashes(packed: DataFrame, window: int, shards: int) -> DataFrame:
    """(block, hashes): for each block the hashes of its windows that stand more than once anywhere."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, data, offsets = unpacked(row)
                found = [(h, checks(words, window)) for _, words, _, h in window_hashes(data, offsets, window)]
                keys, check = (np.concatenate([np.zeros(0, t), *x]) for t, x in zip((np.uint64, "<u4"), zip(*found, strict=True), strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, "<u4"))
                order, first = grouped(keys, check)
                n, keys, check = np.diff(np.append(first, len(keys))), keys[order][first], check[order][first]
                shard = (keys >> np.uint64(40)) % np.uint64(shards)
                for s, at in parted(keys, shard, shards):
                    planes = np.ascontiguousarray(check[at].view(np.uint8).reshape(-1, 4)[:, : CHECK_BITS // 8])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s], pa.int32()), pa.array([row["block"]], pa.int64()), pa.array([len(at)], pa.int32()), pa.array([squeeze(keys[at])], pa.binary()), pa.array([planes.tobytes()], pa.binary()), pa.array([np.packbits(n[at] > 1).tobytes()], pa.binary())],
                        ["shard", "block", "n", "keys", "checks", "twice"],
                    )

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [unsqueeze(r["keys"], r["n"]) for r in rows]
        keys, check = np.concatenate(parts), np.zeros((sum(map(len, parts)), 4), np.uint8)
        check[:, : CHECK_BITS // 8] = np.frombuffer(b"".join(r["checks"] for r in rows), np.uint8).reshape(len(check), -1)
        twice = np.concatenate([np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=r["n"]).astype(bool) for r in rows])
        order, first = grouped(keys, check.view("<u4").ravel())
        n = np.diff(np.append(first, len(keys)))
        again = np.zeros(len(keys), bool)
        again[order] = np.repeat((n > 1) | np.logical_or.reduceat(twice[order], first), n)
        ends = np.cumsum([r["n"] for r in rows])
        found = [k[again[e - len(k) : e]].tobytes() for k, e in zip(parts, ends, strict=True)]
        return pa.table({"block": pa.array([r["block"] for r in rows], pa.int64()), "hashes": pa.array(found, pa.binary())})

    asks = packed.mapInArrow(ask, "shard int, block long, n int, keys binary, checks binary, twice binary")
    return asks.groupBy("shard").applyInArrow(answer, "block long, hashes binary").where(F.length("hashes") > 0)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, removed (spans of words, maximal) and kept (the words that stay, joined by one
    space) of each document."""
    packed = pack(docs)
    answers = repeated_hashes(packed, window, shards_for(total_bytes(docs)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        again = distinct(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in right.column("hashes").to_pylist())]))[0]
        own = left.schema.field("doc_ids").type.value_type
        ids, counts, spans, kept = [], [], [], []
        for row in left.to_pylist():
            doc_ids, data, offsets = unpacked(row)
            ids += doc_ids
            for _, words, at, hashes in window_hashes(data, offsets, window):
                hit = at[in_sorted(again, hashes)]
                cover = np.bincount(hit, minlength=len(words) + 1) - np.bincount(hit + window, minlength=len(words) + 1)[: len(words) + 1]
                gone = np.cumsum(cover)[:-1] > 0
                edge = np.zeros(len(words) + 1, bool)
                edge[words.first] = True
                first = np.flatnonzero(gone & (edge[:-1] | ~np.append(False, gone[:-1])[: len(gone)]))
                last = np.flatnonzero(gone & (edge[1:] | ~np.append(gone[1:], False)[: len(gone)])) + 1
                here: list[list] = [[] for _ in words.counts]
                of = np.searchsorted(words.first, first, "right") - 1
                base = words.first[of]
                for d, x, y in zip(of.tolist(), (first - base).tolist(), (last - base).tolist(), strict=True):
                    here[d].append({"a": x, "b": y})
                line, ends, _ = joined(words, ~gone)
                counts.append(words.counts)
                spans += here
                kept.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(line)]).cast(pa.large_string()).cast(pa.string()))
        return pa.table({"doc_id": pa.array(ids, own), "n_words": pa.array(np.concatenate(counts), pa.int64()), "removed": pa.array(spans, SPAN), "kept": pa.chunked_array(kept, pa.string())})

    both = packed.groupBy("block").cogroup(answers.groupBy("block"))
    return both.applyInArrow(cut, f"doc_id {kind}, n_words long, removed array<struct<a:long,b:long>>, kept string")
