"""Toxicity by multiple-instance learning: labels are known for documents, scores are given to sentences.

A sentence scores sigmoid(bias + weights of its words); a document is toxic unless every sentence is
clean, 1 - prod(1 - p) (noisy-or). Weights are fitted to document labels through that product, so the
sentences that explain a label are found without being marked.

Learning is on a bounded sample: of each class at most ``SAMPLE`` labelled texts of at most ``LONGEST`` bytes
each and ``BYTES`` in all, lowest hash of id and text first. Words are lower-cased runs of letters and digits; a word and its
beginnings of 4, 5 and 6 bytes (so that inflected forms share evidence) are hashed into ``BUCKETS`` and
count in a sentence's sum each time they stand there. Scoring covers every whole text.

Defined cases: null, empty and wordless texts have no sentence and score 0; without labels of both
classes every score is 0; repeated rows are scored each, and learned from once; an id that is labelled both
ways is ignored; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import in_fold
from docquarry.llm.quality import labelled_sample
from docquarry.llm.text import LOWER, NOT_ALNUM, Words, batches_of, span_hashes, texts_of

BUCKETS = 1 << 18
SAMPLE, LONGEST, BYTES = 2500, 64 << 10, 16 << 20
BEGINNINGS = (4, 5, 6)
#: Sentences end at these bytes.
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?\n"]] = True


class Sentences:
    """Features of a batch, cut into sentences and documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(LOWER[data], offsets, NOT_ALNUM)
        self.words, self.n_docs = words, len(offsets) - 1
        of = np.repeat(np.arange(self.n_docs), words.counts)
        line = np.cumsum(STOP[data])[words.start] if len(data) else np.zeros(0, np.int64)
        new = np.ones(len(words), bool)
        new[1:] = (line[1:] != line[:-1]) | (of[1:] != of[:-1])
        self.first = np.flatnonzero(new)
        self.doc = of[self.first]
        of_word = np.cumsum(new) - 1
        hashes, lines = [words.hashes()], [of_word]
        for n in BEGINNINGS:
            longer = np.flatnonzero(words.end - words.start > n)
            hashes.append(span_hashes(words.data, words.start[longer], words.start[longer] + n))
            lines.append(of_word[longer])
        #: of each feature: its bucket and its sentence
        self.bucket = np.concatenate([(h & np.uint64(BUCKETS - 1)).astype(np.int32) for h in hashes])
        self.line = np.concatenate(lines).astype(np.int32)

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets in its document of each sentence's words."""
        last = np.append(self.first[1:], len(self.words))[: len(self.first)] - 1
        base = self.words.offsets[self.doc]
        return self.words.start[self.first] - base, self.words.end[last] - base


class NoisyOr:
    def __init__(self, rows: Sequence[tuple[int, str, int]], steps: int = 150, rate: float = 0.3, decay: float = 2e-4):
        self.weight, self.bias = None, 0.0
        y = np.array([r[2] for r in rows], float)
        if len(set(y.tolist())) < 2:
            return
        s = Sentences(*texts_of(pa.array([r[1] for r in rows], pa.string())))
        y[np.bincount(s.doc, minlength=len(y)) == 0] = 0
        # words of at least three documents; the others carry no evidence
        pair = s.doc[s.line].astype(np.int64)
        pair *= BUCKETS
        pair += s.bucket
        pair.sort()
        first = np.append(True, pair[1:] != pair[:-1])
        held = np.bincount(pair[first] % BUCKETS, minlength=BUCKETS) >= 3
        del pair, first
        names = np.flatnonzero(held)
        some = held[s.bucket]
        at, line = (np.cumsum(held, dtype=np.int32) - 1)[s.bucket[some]], s.line[some]
        del some
        s.bucket = s.line = None
        n = len(s.first)
        w, bias = np.zeros(len(names)), -4.0
        g2, gb2 = np.full(len(names), 1e-8), 1e-8
        for _ in range(steps):
            a = np.bincount(line, w[at], minlength=n) + bias
            total = np.bincount(s.doc, np.logaddexp(0, a), minlength=len(y))
            pull = np.where(y > 0, -1 / np.maximum(np.expm1(np.minimum(total, 500)), 1e-9), 1.0)
            grad = pull[s.doc] / (1 + np.exp(-np.clip(a, -500, 500)))
            g = np.bincount(at, grad[line], minlength=len(names)) / len(y) + decay * w
            gb = grad.sum() / len(y)
            g2, gb2 = g2 + g * g, gb2 + gb * gb
            w -= rate * g / np.sqrt(g2)
            bias -= rate * gb / np.sqrt(gb2)
        self.weight, self.bias = np.zeros(BUCKETS, np.float32), float(bias)
        self.weight[names] = w.astype(np.float32)

    def sentence_scores(self, column) -> Iterator[tuple[int, Sentences, np.ndarray, np.ndarray]]:
        """(number of the first document, sentences, log-odds of each sentence, document scores)"""
        data, offsets = texts_of(column)
        for a, b in batches_of(data, offsets, 4 << 20):
            s = Sentences(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            if self.weight is None:
                yield a, s, np.full(len(s.first), -np.inf), np.zeros(b - a)
                continue
            odds = np.bincount(s.line, self.weight[s.bucket], minlength=len(s.first)) + self.bias
            yield a, s, odds, -np.expm1(-np.bincount(s.doc, np.logaddexp(0, odds), minlength=b - a))


def fit(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, sample: int = SAMPLE) -> NoisyOr:
    return NoisyOr(labelled_sample(docs, labels, "toxic", mod, held, sample, LONGEST, BYTES))


def toxicity(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted, and ``sentences``: byte spans and scores of the sentences at
    0.5 or more (of a document that is toxic only by many weak sentences: its highest)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, mod, held))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, found = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for a, s, odds, own in model.value.sentence_scores(batch.column("text")):
                score[a : a + len(own)] = own
                best = np.full(len(own), -np.inf)
                np.maximum.at(best, s.doc, odds)
                start, end = s.spans()
                for k in np.flatnonzero((own[s.doc] >= 0.5) & ((odds >= 0) | (odds == best[s.doc]))).tolist():
                    found[a + s.doc[k]].append({"start": int(start[k]), "end": int(end[k]), "score": float(1 / (1 + np.exp(-odds[k])))})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(found, kind)], ["doc_id", "score", "sentences"])

    own = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {own}, score double, sentences array<struct<start:long,end:long,score:double>>")
    return out.select("doc_id", in_fold(mod, held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences")
