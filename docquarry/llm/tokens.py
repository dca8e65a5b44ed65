"""Token ids in fixed-width bit packing.

Format: a Parquet table ``blocks`` of one row for each block of whole documents, with
  shard, block   its place (documents ascend by id through shards and blocks),
  bits           width of an id: the least that holds the vocabulary,
  doc_ids        ids of its documents, in order,
  offsets        position of each document's first id in the block, and the block's total,
  payload        the ids, ``bits`` bits each, lowest bit first, padded to whole bytes.
A document is found by its doc_id range of a block (Parquet statistics on ``first_id``, ``last_id``) and
read by its offsets alone; ids are unpacked in numpy.

Ids are those that the tokenizers library gives the whole text. Where the vocabulary file lower-cases and
pre-tokenises as ``UNIT_RULES`` says, a text is encoded unit by unit: A-Z lower-cased, cut at white space
and between letters and ASCII punctuation other than the apostrophe. That pre-tokenisation cuts there too,
so the ids are the same, and a unit that returns is encoded once. Words that hold ``<|`` (a special token,
perhaps) stay whole and in their own case. Under any other file whole texts go to the library.

Defined cases: null and empty texts give the end id alone; repeated rows are written each, equal ids in
the order of their texts (and dealt over shards by how those begin); a null doc_id comes first; an empty table gives an empty result; other columns
are ignored. A longer document than ``BLOCK`` ids has a block of its own.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.common import new_path
from docquarry.llm.text import LOWER, SPACE, Words, batches_of, texts_of

#: Ids of a block, at least; bytes of text to one shard, about; units kept in a worker's memory.
BLOCK, SHARD_BYTES, REMEMBERED = 1 << 16, 32 << 20, 250_000
END = 1

# ------------------------------------------------------------------------------------------- packing


def width(vocabulary: int) -> int:
    """Bits of the largest id of a vocabulary."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` bits for each id, lowest first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start:stop of a payload, read from the bytes that hold them only."""
    if bits == 16:
        return np.frombuffer(payload, "<u2", stop - start, start * 2).astype(np.uint32)
    lo, hi = start * bits // 8, -(-stop * bits // 8)
    raw = np.unpackbits(np.frombuffer(payload, np.uint8, hi - lo, lo), bitorder="little")[start * bits - lo * 8 :]
    places = np.uint32(1) << np.arange(bits, dtype=np.uint32)
    return (raw[: (stop - start) * bits].reshape(-1, bits) * places).sum(axis=1, dtype=np.uint32)


# ------------------------------------------------------------------------------------------ encoding

_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


#: What a vocabulary file must say for texts to be encoded unit by unit: fixed values of the file format.
UNIT_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    "suffix": "</w>",
}


def by_units(file: dict) -> bool:
    """Whether a vocabulary file (as read from JSON) has the rules that units rely on."""
    steps = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    plain = all("<|" in x["content"] and not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or any(c.isspace() for c in x["content"])) for x in file.get("added_tokens", []))
    return file.get("normalizer") == UNIT_RULES["normalizer"] and steps[0].get("pattern") == {"Regex": UNIT_RULES["pattern"]} and len(steps) == 2 and file["model"].get("end_of_word_suffix") == UNIT_RULES["suffix"] and plain


class Encoder:
    """The ids of texts under a vocabulary file, with a bounded memory of units."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.units = by_units(json.loads(self.tokenizer.to_str()))
        self.size = self.tokenizer.get_vocab_size()
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.closes[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def _alone(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self, units: list[bytes]) -> None:
        """Encode new units. Runs of letters go many to a text: each ends at an id that closes a word."""
        plain = [u for u in units if u.isalpha() or u.decode().isalpha()]
        parts = [plain[k : k + 500] for k in range(0, len(plain), 500)]
        texts = [b" ".join(x).decode() for x in parts]
        for part, text in zip(parts, texts, strict=True):
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(part):
                raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
                self.known.update(zip(part, (raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)), strict=True))
        left = [u for u in units if u not in self.known]
        for k in range(0, len(left), 500):
            found = self.tokenizer.encode_batch_fast([u.decode() for u in left[k : k + 500]], add_special_tokens=False)
            self.known.update((u, np.array(x.ids, np.uint32).tobytes()) for u, x in zip(left[k : k + 500], found, strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int | None = END) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of each document in them), ``end`` after each."""
        ids, where = self._by_units(data, offsets) if self.units else self._whole(data, offsets)
        if end is None:
            return ids, where
        return np.insert(ids, where[1:], end), where + np.arange(len(where))

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        found = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.append(0, np.cumsum([len(x) for x in found], dtype=np.int64)).astype(np.int64)

    def _by_units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, data = data, LOWER[data]
        edges, own_case = self._edges(data, offsets)
        for a, b in own_case:
            data[a:b] = raw[a:b]
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)]) if len(data) else pa.array([], pa.large_binary())
        coded = units.dictionary_encode()
        at, unique = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.learn([u for u in unique if u not in self.known])
        each = [self.known[u] for u in unique]
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        pool = np.frombuffer(b"".join(each), np.uint32)
        begin = np.cumsum(size) - size
        n = size[at]
        total = np.append(0, np.cumsum(n))
        ids = pool[np.arange(total[-1]) + np.repeat(begin[at] - total[:-1], n)]
        return ids, total[np.searchsorted(edges, offsets)] if len(data) else np.zeros(len(offsets), np.int64)

    def _edges(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Where units and the white space between them begin, from 0 to the end of ``data``; and the words
        that stay in their own case."""
        if not len(data):
            return np.zeros(1, np.int64), []
        words = Words(data, offsets, SPACE)
        letter, mark = _LETTER[data], _MARK[data]
        # letters U+00E0-U+00FF but the division sign
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0xA0) & (data[1:] <= 0xBF) & (data[1:] != 0xB7)
        lead = letter | np.append((data[:-1] == 0xC3) & letter[1:], False)
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (letter[:-1] & mark[1:]) | (mark[:-1] & lead[1:])
        special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
        whole = [(int(words.start[w]), int(words.end[w])) for w in np.unique(np.searchsorted(words.start, special, "right") - 1).tolist()]
        for a, b in whole:
            cut[a:b] = False
        cut[words.start] = cut[words.end] = cut[offsets] = True
        return np.flatnonzero(cut).astype(np.int64), whole


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# --------------------------------------------------------------------------------------------- files

BLOCKS = "shard int, block int, bits int, first_id {0}, last_id {0}, doc_ids array<{0}>, offsets array<long>, payload binary"


def write_blocks(docs: DataFrame, path: str, vocabulary_file: str, end: int | None = END, block: int = BLOCK, shard_bytes: int = SHARD_BYTES) -> None:
    """Write all texts of ``docs``, ascending by doc_id, to ``path``."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    kind = docs.schema["doc_id"].dataType.simpleString()
    shards = max(1, -(-total // shard_bytes))
    names = ["shard", "block", "bits", "first_id", "last_id", "doc_ids", "offsets", "payload"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number, use = TaskContext.get().partitionId(), 0, encoder(vocabulary_file)
        bits, own = width(use.size), None
        held: list[tuple[list, np.ndarray]] = []

        def row() -> pa.RecordBatch:
            ids = [i for x, _ in held for i in x]
            sizes = np.concatenate([np.array([len(y) for y in ys], np.int64) for _, ys in held])
            all_ids = np.concatenate([y for _, ys in held for y in ys])
            values = [[shard], [number], [bits], [ids[0]], [ids[-1]], [ids], [np.append(0, np.cumsum(sizes)).tolist()], [pack(all_ids, bits)]]
            types = [pa.int32(), pa.int32(), pa.int32(), own, own, pa.list_(own), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names)

        waiting = 0
        for batch in batches:
            own = batch.schema.field("doc_id").type
            doc_ids = batch.column("doc_id").to_pylist()
            data, offsets = texts_of(batch.column("text"))
            for a, b in batches_of(data, offsets, 1 << 20):
                ids, at = use.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], end)
                i = 0
                while i < b - a:
                    j = int(np.searchsorted(at, at[i] + block - waiting, "left"))
                    j = min(max(j, i + 1), b - a)
                    held.append((doc_ids[a + i : a + j], [ids[at[k] : at[k + 1]] for k in range(i, j)]))
                    waiting += int(at[j] - at[i])
                    i = j
                    if waiting >= block:
                        yield row()
                        held, waiting, number = [], 0, number + 1
        if held:
            yield row()

    placed = docs.select("doc_id", "text").repartitionByRange(shards, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    placed.mapInArrow(scan, BLOCKS.format(kind)).write.option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def token_ids(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of a document (of each row with that id), from the blocks that may hold it."""
    found = read_blocks(spark, path).where((F.col("first_id").isNull() | (F.col("first_id") <= doc_id)) & (F.col("last_id") >= doc_id))
    out = []
    for r in found.orderBy("shard", "block").collect():
        out += [unpack(r.payload, r.bits, r.offsets[k], r.offsets[k + 1]) for k, d in enumerate(r.doc_ids) if d == doc_id]
    return out


def digests(blocks: DataFrame) -> DataFrame:
    """shard, block, place in it, doc_id, start in its block, n_tokens and ids_crc32 of each document."""
    kind = blocks.schema["first_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n, at = len(r["doc_ids"]), r["offsets"]
                ids = unpack(r["payload"], r["bits"], 0, at[-1]).astype("<u4")
                crc = [zlib.crc32(ids[at[k] : at[k + 1]].tobytes()) for k in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["shard"]] * n, pa.int32()), pa.array([r["block"]] * n, pa.int32()), pa.array(r["doc_ids"], batch.schema.field("doc_ids").type.value_type), pa.array(at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())],
                    ["shard", "block", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    read = blocks.select("shard", "block", "bits", "doc_ids", "offsets", "payload")
    return read.mapInArrow(scan, f"shard int, block int, doc_id {kind}, at long, n_tokens long, ids_crc32 long")


def starts(blocks: DataFrame) -> DataFrame:
    """Ids before each block: a sum over shards, of which there are few, then inside each shard."""
    sizes = blocks.select("shard", "block", F.element_at("offsets", -1).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("s"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("b", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return sizes.join(shards, "shard").select("shard", "block", (F.col("s") + F.col("b")).alias("before"))


def tokenized(docs: DataFrame, vocabulary_file: str, path: str | None = None) -> DataFrame:
    """Write ``docs`` as token blocks and give, from the files read back, doc_id, start, n_tokens and
    ids_crc32 of each document."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_blocks(docs, path, vocabulary_file)
    blocks = read_blocks(spark, path)
    out = digests(blocks).join(starts(blocks), ["shard", "block"])
    return out.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
