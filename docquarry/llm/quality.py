"""Quality by compression: one zstandard dictionary from good text and one from bad.

Each text is compressed with either, in pieces of ``PIECE`` bytes so that the dictionaries matter to
the end of a long text. The difference of the two sizes over the text's own size goes through a
logistic curve that is fitted on labelled texts the dictionaries have not seen.

Learning is on a bounded sample: of each class at most ``SAMPLE`` labelled texts of at most ``LONGEST`` bytes
each and ``BYTES`` in all, lowest hash of id and text first. Every other text of it trains the dictionary of
its class, on every k-th piece so that at most ``PIECES`` are used; the others fit the curve. Scoring covers
every whole text.

Defined cases: null and empty texts have difference 0 and get the curve's value there; where a class has fewer
than ``LEAST`` pieces to train on, or the curve lacks a class, every score is the share of good labels
(smoothed by half a label, so 0.5 without any); where zstandard finds too little to train on, the last
``DICTIONARY`` bytes of the pieces serve; repeated rows are scored each, and learned from once; an id that is
labelled both ways and a label row without id, text or value are ignored; other columns are ignored or kept,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import free, in_fold, trainable
from docquarry.llm.text import texts_of

PIECE, DICTIONARY, LEVEL = 2048, 32 << 10, 3
#: Bounds of the sample of a class: texts, bytes of a text, bytes in all; pieces a dictionary is trained on.
SAMPLE, LONGEST, BYTES, PIECES, LEAST = 3000, 64 << 10, 24 << 20, 6000, 1


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, most: int, longest: int, in_all: int) -> list[tuple[int, str, int]]:
    """(hash, text, label) of at most ``most`` training texts of each label, of at most ``in_all`` bytes together,
    in hash order. What is drawn is chosen from ids, hashes and sizes; texts are fetched last."""
    known = labels.where(F.col(label).isin(0, 1) & trainable(mod, held)).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("top")).where("y = top").select("doc_id", "y")
    texts = docs.where(F.octet_length("text") <= longest).select("doc_id", F.xxhash64("text").alias("t"), F.octet_length("text").alias("bytes"), "text")
    found = texts.select("doc_id", "t", "bytes").join(known, "doc_id").distinct().withColumn("h", F.xxhash64("doc_id", "t"))
    order = ("h", "doc_id", "t")
    drawn = found.where("y = 0").orderBy(*order).limit(most).unionAll(found.where("y = 1").orderBy(*order).limit(most))
    drawn = drawn.withColumn("sum", F.sum("bytes").over(Window.partitionBy("y").orderBy(*order))).where(F.col("sum") <= in_all)
    rows = texts.select("doc_id", "t", "text").join(F.broadcast(drawn.select("doc_id", "t", "h", "y")), ["doc_id", "t"]).dropDuplicates(["doc_id", "t"])
    return sorted((r[0], r[1], r[2]) for r in rows.select("h", "text", F.col("y").cast("int")).collect())


def pieces(data: bytes) -> list[bytes]:
    return [data[k : k + PIECE] for k in range(0, len(data), PIECE)]


class CompressionClassifier:
    """Two dictionaries and the curve. Picklable; compressors are made where they are used."""

    def __init__(self, rows: Sequence[tuple[int, str, int]]):
        y = np.array([r[2] for r in rows], float)
        self.dictionaries, self.slope, self.bias = None, 0.0, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0
        by = [[r for r in rows if r[2] == v] for v in (0, 1)]
        fit, check = by[0][::2] + by[1][::2], by[0][1::2] + by[1][1::2]
        parts = [[p for r in fit if r[2] == v for p in pieces(r[1].encode())] for v in (0, 1)]
        if min(map(len, parts)) < LEAST or len({r[2] for r in check}) < 2:
            return
        self.dictionaries = [self._dictionary(x) for x in parts]
        x = self.difference([r[1].encode() for r in check])
        self._curve(x, np.array([r[2] for r in check], float))

    @staticmethod
    def _dictionary(parts: list[bytes]) -> bytes:
        try:
            return zstandard.train_dictionary(DICTIONARY, parts[:: -(-len(parts) // PIECES)]).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: the text itself serves
            return b"".join(parts)[-DICTIONARY:]

    def _curve(self, x: np.ndarray, y: np.ndarray, steps: int = 50) -> None:
        """Newton steps of a logistic fit with a little ridge."""
        z, w = np.c_[x * 100, np.ones(len(x))], np.zeros(2)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag([1e-2, 1e-6]), z.T @ (y - p) - np.array([1e-2, 0]) * w)
            w += step
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.bias = float(w[0] * 100), float(w[1])

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        if "_made" not in self.__dict__:
            plain = dict(write_content_size=False, write_checksum=False, write_dict_id=False)
            made = []
            for d in self.dictionaries:
                own = zstandard.ZstdCompressionDict(d)
                own.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own, **plain))
            self._made = made
        return self._made

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def difference(self, texts: Sequence[bytes]) -> np.ndarray:
        """(size with the bad dictionary - size with the good one) / bytes; 0 for an empty text."""
        if self.dictionaries is None:
            return np.zeros(len(texts))
        bad, good = self._compressors()
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            if len(t):
                out[i] = sum(len(bad.compress(p)) - len(good.compress(p)) for p in pieces(t)) / len(t)
        return out

    def scores(self, column) -> np.ndarray:
        data, offsets = texts_of(column)
        raw = memoryview(data)
        x = self.difference([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.bias, -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1, sample: int = SAMPLE, longest: int = LONGEST, in_all: int = BYTES) -> CompressionClassifier:
    return CompressionClassifier(labelled_sample(docs, labels, "quality", mod, held, sample, longest, in_all))


def scored(docs: DataFrame, model, keep: Sequence[str]) -> DataFrame:
    """The ``keep`` columns and ``free("score", keep)`` by ``model.scores`` of the whole text."""
    shared, keep, name = docs.sparkSession.sparkContext.broadcast(model), tuple(keep), free("score", keep)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(shared.value.scores(batch.column("text")), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), score], [*keep, name])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"]))).mapInArrow(scan, f"{schema}, `{name}` double")


def quality_scores(docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted for each document."""
    out = scored(docs, fit(docs, labels, mod, held), ("doc_id",))
    return out.select("doc_id", in_fold(mod, held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1) -> DataFrame:
    """``docs`` that the classifier accepts; same columns."""
    return scored(docs, fit(docs, labels, mod, held), docs.columns).where(F.col(free("score", docs.columns)) >= 0.5).select(*(F.col(f"`{c}`") for c in docs.columns))
