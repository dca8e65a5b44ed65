"""Benchmark decontamination by winnowing.

Of the k-gram hashes in every sliding window the smallest is kept (the rightmost of equals), on both
sides. With k-grams of 5 words and 6 of them to a window, any 10 words that a document shares with an
item have a kept fingerprint in common, so no shared window is missed. Fingerprints that meet are then
extended: the windows around them are compared whole. Items shorter than a window are windows of
their own length and keep every fingerprint.

Defined cases: null and empty texts have no words and hit nothing; items without words are ignored;
repeated item rows count once by id, a null item id reads as the empty string; repeated documents are
separate rows; an empty table on either side gives no hits. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import free, materialize
from docquarry.llm.text import LOWER, NOT_ALNUM, Words, batches_of, mixed, powers, texts_of

#: Words of a window, of a k-gram, and k-grams to a winnowing window.
WINDOW, GRAM = 10, 5
SPREAD = WINDOW - GRAM + 1
#: Bytes of benchmark text that a broadcast index covers; a larger benchmark is joined by a shuffle.
INDEX_BYTES = 16 << 20


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hash of each run of n words, document borders disregarded."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    m = len(hashes) - n + 1
    return mixed((sums[n:] - sums[:m]) * down[:m])


def winnowed(grams: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Positions kept from ``grams``; ``valid``: windows (by first gram) that lie in one text."""
    m = len(valid)
    low, at = grams[:m].copy(), np.arange(m)
    for s in range(1, SPREAD):
        next_ = grams[s : s + m]
        better = next_ <= low
        low[better] = next_[better]
        at[better] = np.flatnonzero(better) + s
    keep = np.zeros(len(grams), bool)
    keep[at[valid]] = True
    return np.flatnonzero(keep)


class Lookup:
    """Sorted hashes, each with the items it belongs to; a bit table turns most misses away."""

    def __init__(self, hashes: np.ndarray, items: np.ndarray):
        order = np.lexsort((items, hashes))
        hashes, items = hashes[order], items[order]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, int)
        self.keys, self.items, self.first = hashes[first], items, np.append(first, len(hashes))
        self.mask = np.uint64((1 << max(16, int(len(self.keys)).bit_length() + 4)) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[self.keys & self.mask] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``hashes`` that are keys, their key numbers)"""
        some = np.flatnonzero(self.bits[hashes & self.mask])
        at = np.searchsorted(self.keys, hashes[some])
        ok = at < len(self.keys)
        some, at = some[ok], at[ok]
        ok = self.keys[at] == hashes[some]
        return some[ok], at[ok]


class Index:
    def __init__(self, ids: Sequence[str], texts: Sequence[str | None]):
        self.ids = sorted(set(ids))
        number = {x: i for i, x in enumerate(self.ids)}
        data, offsets = texts_of(pa.array(texts, pa.string()))
        words = Words(LOWER[data], offsets, NOT_ALNUM)
        hashes, of, n = words.hashes(), np.array([number[x] for x in ids], np.int64), words.counts
        marks, windows, short = [], ([], []), {}
        for i in range(len(ids)):
            own = hashes[words.first[i] : words.first[i + 1]]
            if n[i] >= WINDOW:
                whole, grams = rolling(own, WINDOW), rolling(own, GRAM)
                windows[0].append(whole)
                windows[1].append(np.full(len(whole), of[i]))
                marks.append(grams[winnowed(grams, np.ones(len(whole), bool))])
            elif n[i]:
                short.setdefault(int(n[i]), ([], []))
                short[int(n[i])][0].append(rolling(own, int(n[i])))
                short[int(n[i])][1].append(of[i : i + 1])
        none = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        marks = np.unique(np.concatenate(marks or none[0]))
        self.marks = Lookup(marks, np.zeros(len(marks), np.int64))
        self.windows = Lookup(*(np.concatenate(x or y) for x, y in zip(windows, none, strict=True)))
        self.short = {k: Lookup(*(np.concatenate(x) for x in v)) for k, v in sorted(short.items())}

    def found(self, words: Words) -> list[tuple[int, np.ndarray, Lookup, np.ndarray]]:
        """(length, first words, table, key numbers) of the windows that occur."""
        out, hashes = [], words.hashes()
        last = np.repeat(words.first[1:], words.counts)
        if len(hashes) >= WINDOW and len(self.windows.keys):
            grams, m = rolling(hashes, GRAM), len(hashes) - WINDOW + 1
            valid = np.arange(m) + WINDOW <= last[:m]
            kept = winnowed(grams, valid)
            hit = kept[self.marks.find(grams[kept])[0]]
            near = np.zeros(m, bool)
            for back in range(SPREAD):
                s = hit - back
                near[s[(s >= 0) & (s < m)]] = True
            s = np.flatnonzero(near & valid)
            if len(s):
                up, down = powers(len(hashes))
                sums = np.zeros(len(hashes) + 1, np.uint64)
                np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
                at, key = self.windows.find(mixed((sums[s + WINDOW] - sums[s]) * down[s]))
                out.append((WINDOW, s[at], self.windows, key))
        for n, table in self.short.items():
            whole = rolling(hashes, n)
            at, key = table.find(whole)
            ok = at + n <= last[at]
            out.append((n, at[ok], table, key[ok]))
        return out


def hits(index: Index, column) -> tuple[np.ndarray, list, list]:
    """For each text: number of words, spans (first word, end) that are hit, items met."""
    data, offsets = texts_of(column)
    counts, spans, items = [], [], []
    for a, b in batches_of(data, offsets, 1 << 20):
        part = data[offsets[a] : offsets[b]]
        words = Words(LOWER[part], offsets[a : b + 1] - offsets[a], NOT_ALNUM)
        counts.append(words.counts)
        here, met = [[] for _ in range(a, b)], [set() for _ in range(a, b)]
        of = np.repeat(np.arange(b - a), words.counts)
        cover = np.zeros(len(words) + 1, np.int64)
        for n, at, table, key in index.found(words):
            np.add.at(cover, at, 1)
            np.add.at(cover, at + n, -1)
            for d, k in set(zip(of[at].tolist(), key.tolist(), strict=True)):
                met[d].update(table.items[table.first[k] : table.first[k + 1]].tolist())
        on = np.append(np.cumsum(cover)[:-1] > 0, False)
        first = words.first
        turn = on[:-1] & ~np.append(False, on[:-1])[: len(words)]
        turn |= on[:-1] & np.isin(np.arange(len(words)), first)
        stop = on[:-1] & (~on[1:] | np.isin(np.arange(1, len(words) + 1), first))
        for s, e in zip(np.flatnonzero(turn).tolist(), (np.flatnonzero(stop) + 1).tolist(), strict=True):
            d = int(of[s])
            here[d].append((s - int(first[d]), e - int(first[d])))
        spans += here
        items += [[index.ids[i] for i in sorted(x)] for x in met]
    return np.concatenate(counts) if counts else np.zeros(0, np.int64), spans, items


FOUND = "`{}` long, `{}` array<struct<a:long,b:long>>, `{}` array<string>"
_SPAN = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def contamination(docs: DataFrame, benchmark: DataFrame, keep: Sequence[str] = ("doc_id",), index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The ``keep`` columns of each document with n_words, spans (merged spans of hit words) and items (ids
    met, sorted as strings), under names that are ``free`` beside ``keep`` and text.

    The benchmark's size (distinct texts with their ids) is read first. Up to ``index_bytes`` of it make one
    broadcast index; a larger one is joined by a shuffle of fingerprints.
    """
    keep = list(keep)
    made = [free(c, [*keep, "text"]) for c in ("n_words", "spans", "items")]
    item_id = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    items = benchmark.where("text is not null").select(item_id.alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("item_id"))).first()[0] or 0
    if total > index_bytes:
        return joined_contamination(docs, items, keep, made)
    rows = items.collect()
    shared = docs.sparkSession.sparkContext.broadcast(Index([r[0] for r in rows], [r[1] for r in rows]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, spans, met = hits(shared.value, batch.column("text"))
            spans = [[{"a": a, "b": b} for a, b in x] for x in spans]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(spans, _SPAN), pa.array(met, pa.list_(pa.string()))], [*keep, *made])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    need = list(dict.fromkeys([*keep, "text"]))
    return docs.select(*(F.col(f"`{c}`") for c in need)).mapInArrow(scan, f"{schema}, {FOUND.format(*made)}")


# ------------------------------------------------------------------------- a benchmark of any size, by joins


def signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64), pa.int64())


def fingerprints(words: Words, shorter: Sequence[int], whole: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, first words, hashes): the winnowed k-grams of every text (``GRAM``) and all runs of the lengths
    in ``shorter``; of texts of that very length only where ``whole``."""
    hashes = words.hashes()
    last = np.repeat(words.first[1:], words.counts)
    if len(hashes) >= WINDOW:
        grams, m = rolling(hashes, GRAM), len(hashes) - WINDOW + 1
        kept = winnowed(grams, np.arange(m) + WINDOW <= last[:m])
        yield 0, kept, grams[kept]
    for n in shorter:
        runs = rolling(hashes, n)
        at = np.arange(len(runs))
        at = at[at + n <= last[: len(at)]]
        if whole:
            at = np.intersect1d(at, words.first[:-1][words.counts == n])
        yield n, at, runs[at]


def windows_at(words: Words, first: np.ndarray) -> np.ndarray:
    """Hashes of the windows that begin at the words ``first``."""
    return rolling(words.hashes(), WINDOW)[first]


def joined_contamination(docs: DataFrame, items: DataFrame, keep: Sequence[str], made: Sequence[str]) -> DataFrame:
    """``contamination`` for a benchmark that no task could hold: fingerprints of both sides meet in a shuffle, and
    where they meet the windows around them do, by their whole hashes."""
    rid = free("rid", [*keep, "text"])
    need = list(dict.fromkeys([*keep, "text"]))
    own_spans, own_names = free("found_spans", need), free("found_names", need)
    source = materialize(docs.select(*(F.col(f"`{c}`") for c in need)).withColumn(rid, F.monotonically_increasing_id()), "documents")
    slim = source.select(F.col(rid).alias("rid"), "text")
    texts = materialize(items.select("text").distinct().select(F.xxhash64("text").alias("tid"), "text"), "texts")
    long_, short = pa.int64(), pa.int32()

    def cut(batch: pa.RecordBatch) -> Iterator[tuple[int, Words]]:
        data, offsets = texts_of(batch.column("text"))
        for a, b in batches_of(data, offsets, 1 << 20):
            yield a, Words(LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], NOT_ALNUM)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words in cut(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(words.counts), short)], ["n"])

    found = [r.n for r in texts.select("text").mapInArrow(lengths, "n int").where(f"n between 1 and {WINDOW - 1}").distinct().collect()]
    shorter = sorted(found)

    def marks(name: str, whole: bool):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(name).to_numpy()
                for a, words in cut(batch):
                    of = np.repeat(np.arange(len(words.counts)), words.counts)
                    for n, at, hashes in fingerprints(words, shorter, whole):
                        d = of[at]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n), short), signed(hashes), pa.array(own[a + d], long_), pa.array(at - words.first[d], long_)], ["n", "hash", name, "at"])

        return scan

    theirs = materialize(texts.mapInArrow(marks("tid", True), "n int, hash long, tid long, at long"), "item_marks")
    ours = slim.mapInArrow(marks("rid", False), "n int, hash long, rid long, at long")
    met = materialize(ours.join(theirs.select("n", "hash").distinct(), ["n", "hash"], "left_semi"), "marks")

    # windows of items, and of documents around the marks that met
    def all_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("tid").to_numpy()
            for a, words in cut(batch):
                first = np.arange(max(len(words) - WINDOW + 1, 0))
                first = first[first + WINDOW <= np.repeat(words.first[1:], words.counts)[: len(first)]]
                of = np.repeat(np.arange(len(words.counts)), words.counts)[first]
                yield pa.RecordBatch.from_arrays([signed(windows_at(words, first)), pa.array(own[a + of], long_)], ["hash", "tid"])

    def near_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, places = batch.column("rid").to_numpy(), batch.column("places")
            for a, words in cut(batch):
                near = np.zeros(len(words) + 1, bool)
                for k, base in enumerate(words.first[:-1].tolist()):
                    at = base + places[a + k].values.to_numpy()
                    for back in range(SPREAD):
                        near[at[at - back >= base] - back] = True
                first = np.flatnonzero(near[: max(len(words) - WINDOW + 1, 0)])
                first = first[first + WINDOW <= np.repeat(words.first[1:], words.counts)[first]]
                of = np.repeat(np.arange(len(words.counts)), words.counts)[first]
                yield pa.RecordBatch.from_arrays([signed(windows_at(words, first)), pa.array(own[a + of], long_), pa.array(first - words.first[of], long_)], ["hash", "rid", "at"])

    whole = materialize(texts.mapInArrow(all_windows, "hash long, tid long").distinct(), "item_windows")
    marked = met.where("n = 0").groupBy("rid").agg(F.collect_list("at").alias("places"))
    asked = slim.join(marked, "rid").mapInArrow(near_windows, "hash long, rid long, at long")
    hit = asked.join(whole.select("hash").distinct(), "hash", "left_semi").select(F.lit(0).alias("n"), "hash", "rid", "at")
    hit = materialize(hit.unionByName(met.where("n > 0").select("n", "hash", "rid", "at")), "hits")
    # spans, and the texts whose windows occur
    length = F.when(F.col("n") == 0, WINDOW).otherwise(F.col("n"))
    pieces = F.sort_array(F.collect_set(F.struct(F.col("at").alias("a"), (F.col("at") + length).alias("b"))))
    spans = hit.groupBy("rid").agg(pieces.alias(own_spans))
    known = whole.select(F.lit(0).alias("n"), "hash", "tid").unionAll(theirs.where("n > 0").select("n", "hash", "tid").distinct())
    ids = items.select(F.xxhash64("text").alias("tid"), "item_id")
    names = hit.select("rid", "n", "hash").distinct().join(known, ["n", "hash"]).select("rid", "tid").distinct().join(ids, "tid").groupBy("rid").agg(F.sort_array(F.collect_set("item_id")).alias(own_names))
    both = source.join(spans.join(names, "rid").withColumnRenamed("rid", rid), rid, "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.concatenate([np.zeros(0, np.int64), *(words.counts for _, words in cut(batch))])
            spans = [[{"a": a, "b": b} for a, b in merged([(y["a"], y["b"]) for y in x or []])] for x in batch.column(own_spans).to_pylist()]
            items = [x or [] for x in batch.column(own_names).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(spans, _SPAN), pa.array(items, pa.list_(pa.string()))], [*keep, *made])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return both.select(*(F.col(f"`{c}`") for c in need), own_spans, own_names).mapInArrow(finish, f"{schema}, {FOUND.format(*made)}")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    found = contamination(docs.select("doc_id", "text"), benchmark, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans", "items")


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without those that hold a window of any item; same columns."""
    found = contamination(docs, benchmark, keep=docs.columns, **options)
    return found.where(F.size(free("spans", [*docs.columns, "text"])) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
