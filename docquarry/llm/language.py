"""Language by multinomial naive Bayes over hashed character n-grams.

A text is read as code points, A-Z lower-cased and everything but letters made a space; its 2- and
3-grams are hashed into ``BUCKETS``. Every training document is counted in Spark; the matrix of log
probabilities (languages x buckets, so of a size fixed by the languages) is broadcast, and a batch is
scored by gathering and summing matrix rows in numpy.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without training documents
every text is ``und``; ties go to the first language in code point order; a null lang is not learned;
repeated rows count and are scored each; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import in_fold, trainable
from docquarry.llm.text import LOWER, batches_of, texts_of

GRAMS, BUCKETS, SMOOTH = (2, 3), 1 << 16, 0.5
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTERS[0]


def points_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points (0x20 for what is no letter) and offsets in them."""
    points = np.frombuffer(LOWER[data].tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    return np.where(letters()[points], points, 0x20).astype(np.uint32), starts[offsets]


def grams_of(points: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of the n-grams that hold a letter."""
    of = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    for n in GRAMS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        h, some = np.full(m, n, np.uint32), np.zeros(m, bool)
        for k in range(n):
            c = points[k : k + m]
            h = (h ^ c) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            some |= c != 0x20
        keep = np.flatnonzero(some & (of[:m] == of[n - 1 :]))
        yield of[keep], (h[keep] & np.uint32(BUCKETS - 1)).astype(np.int64)


def counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all texts of ``docs``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            data, offsets = texts_of(batch.column("text"))
            for a, b in batches_of(data, offsets, 4 << 20):
                own = points_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                names, number = np.unique(langs[a:b].astype(str), return_inverse=True)
                for of, bucket in grams_of(*own):
                    table = np.bincount(number[of] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                    for k, x in enumerate(names.tolist()):
                        seen[x] = seen.get(x, 0) + table[k]
        for x, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    rows = docs.select("lang", "text").mapInArrow(scan, "lang string, bucket int, n long")
    return rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class NaiveBayes:
    def __init__(self, table, priors: dict[str, int]):
        self.langs = sorted(priors)
        n = np.zeros((len(self.langs), BUCKETS))
        number = {x: i for i, x in enumerate(self.langs)}
        np.add.at(n, (table["lang"].map(number).to_numpy(int), table["bucket"].to_numpy(int)), table["n"].to_numpy(float))
        self.log = np.log((n + SMOOTH) / (n.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)).astype(np.float32)
        p = np.array([priors[x] for x in self.langs], float)
        self.prior = np.log(p / p.sum()) if len(p) else p

    def predict(self, column) -> tuple[list[str], np.ndarray]:
        data, offsets = texts_of(column)
        langs, scores = [], []
        for a, b in batches_of(data, offsets, 2 << 20):
            points, at = points_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            total = np.tile(self.prior, (b - a, 1))
            spelled = np.append(0, np.cumsum(points != 0x20))
            spelled = spelled[at[1:]] - spelled[at[:-1]] > 0
            for of, bucket in grams_of(points, at):
                for k in range(len(self.langs)):
                    total[:, k] += np.bincount(of, self.log[k][bucket], minlength=b - a)
            if not self.langs:
                langs, scores = langs + ["und"] * (b - a), [*scores, np.zeros(b - a)]
                continue
            best = total.argmax(axis=1)
            share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            langs += [self.langs[k] if s else "und" for k, s in zip(best.tolist(), spelled.tolist(), strict=True)]
            scores.append(np.where(spelled, share, 0.0))
        return langs, np.concatenate(scores) if scores else np.zeros(0)


def fit(docs: DataFrame, mod: int = 3, held: int = 1) -> NaiveBayes:
    known = docs.where(trainable(mod, held) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    priors = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    return NaiveBayes(counts(known).toPandas(), priors)


def languages(docs: DataFrame, mod: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, mod, held))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = model.value.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", in_fold(mod, held).alias("held_out"), "lang_pred", "score")
