"""SentencePiece ids by a table of distinct chunks, and the texts that the ids decode to.

The library turns each space (and each U+2581) into the marker U+2581 and puts one before a text. Where no
piece has a marker after another character, no merge crosses the place before a run of markers, so a text
falls into chunks (a run of markers and what follows it up to the next) whose segmentations don't touch.

Each task cuts its documents into blocks. The distinct chunks of a block make a table: each is segmented and
decoded once, by the library, and ids go back to the places of the chunk by position in numpy. What a task's
earlier blocks have segmented it remembers within bounds. Documents stand alone, so nothing crosses a shuffle
and a lost task is run again alone. (A table for the whole corpus was tried first: to bring its rows back to the
blocks took 4.5 times the size of the input in shuffles, to save work that costs less than cutting the texts.)

Decoding is per chunk too: a run of byte pieces ends at a marker, which is always a piece of its own kind;
the marker that the library puts before the text, and takes off again, is that of the first chunk.

A model whose pieces cross markers, or whose normalizer does more than mark spaces, gets whole texts as
chunks: the same results, with nothing shared but equal texts.

Defined cases: a null or empty text has the end id alone and decodes to the empty text; repeated rows are
answered each; doc_id keeps its type and may be null; an empty table gives no rows; other columns are ignored;
bytes that are no UTF-8 are read as the library reads them. A text of any length is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from docquarry.llm.text import batches_of, texts_of

#: Bytes of text to one block, about; chunks remembered from block to block, of at most so many bytes.
BLOCK_BYTES, REMEMBERED, SHORT = 4 << 20, 300_000, 64
MARK, SPACE = "▁", 0x20
#: What a normalizer that only marks spaces leaves as it is.
PROBE = " a\t ﬁ　Bé é  "


class Model:
    """A SentencePiece model file and whether its texts fall into chunks."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.mark = self.library.piece_to_id(MARK)
        marks_only = self.library.normalize(PROBE) == MARK + PROBE.replace(" ", MARK)
        self.apart = marks_only and self.mark != self.library.unk_id() and not any(MARK in p.lstrip(MARK) for p in pieces)
        self.end = self.library.eos_id()
        self.known: dict[bytes, tuple[bytes, bytes]] = {}

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, edges of chunks, first chunk of each document and their number)."""
        full = np.diff(offsets) > 0
        if not self.apart:
            edges = np.append(offsets[:-1][full], offsets[-1:])
            return data, edges, np.append(0, np.cumsum(full))
        data = np.insert(data, offsets[:-1][full], SPACE)
        offsets = offsets + np.append(0, np.cumsum(full))
        space = data == SPACE
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[offsets[:-1][full]] = True
        edges = np.append(np.flatnonzero(start), len(data))
        return data, edges, np.searchsorted(edges[:-1], offsets)

    def segment(self, chunks: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids (as 32-bit values) and decoded bytes of each chunk."""
        texts = [c[1:] for c in chunks] if self.apart else chunks
        ids = self.library.encode(texts, num_threads=1) if texts else []
        surface = [s.encode() for s in self.library.decode(ids, num_threads=1)] if texts else []
        if self.apart:
            ids = [i if t else [self.mark] for i, t in zip(ids, texts, strict=True)]
            surface = [b" " + s for s in surface]
        return [(np.array(i, "<i4").tobytes(), s) for i, s in zip(ids, surface, strict=True)]

    def table(self, chunks: list[bytes]) -> list[tuple[bytes, bytes]]:
        """The rows of distinct chunks, from memory or segmented."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [c for c in chunks if c not in self.known]
        rows = dict(zip(new, self.segment(new), strict=True))
        out = [rows[c] if c in rows else self.known[c] for c in chunks]
        self.known.update((c, r) for c, r in rows.items() if len(c) <= SHORT)
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids with end ids, offsets of documents in them, decoded bytes, offsets of documents in those)"""
        data, edges, first = self.cut(data, offsets)
        edges = np.ascontiguousarray(edges, np.int64)
        if len(edges) < 2:
            n = len(offsets)
            return np.full(n - 1, self.end, np.int32), np.arange(n), np.zeros(0, np.uint8), np.zeros(n, np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        rows, codes = self.table(coded.dictionary.to_pylist()), coded.indices.to_numpy()
        ids, at = gathered([r[0] for r in rows], np.int32, codes)
        text, to = gathered([r[1] for r in rows], np.uint8, codes)
        at, to = at[first], to[first]
        if self.apart:
            full = np.diff(to) > 0
            text, to = np.delete(text, to[:-1][full]), to - np.append(0, np.cumsum(full))
        return np.insert(ids, at[1:], self.end), at + np.arange(len(at)), text, to


def gathered(runs: list[bytes], kind: type, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of values that ``codes`` name, one after another, and where each begins."""
    pool = np.frombuffer(b"".join(runs), kind)
    size = np.fromiter(map(len, runs), np.int64, len(runs)) // pool.itemsize
    begin, n = np.cumsum(size) - size, size[codes]
    at = np.append(0, np.cumsum(n))
    return pool[np.arange(at[-1]) + np.repeat(begin[codes] - at[:-1], n)], at


_MODELS: dict[str, Model] = {}


def model_at(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def encoded(docs: DataFrame, model_file: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, ids array<int> with the end id, decoded string, for each row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = model_at(model_file)
        for batch in batches:
            text = batch.column("text")
            data, offsets = texts_of(pc.replace_substring(text, MARK, " ") if use.apart else text)
            for a, b in batches_of(data, offsets, block_bytes):
                ids, at, text, to = use.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                texts = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(np.ascontiguousarray(to, np.int64)), pa.py_buffer(np.ascontiguousarray(text)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists, texts.cast(pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, ids array<int>, decoded string")
