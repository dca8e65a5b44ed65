"""Whitening of embeddings along their leading principal components.

Vectors become long vectors x = floor(256 c); the fit list holds each distinct x once. The leading
eigenvectors of its covariance V come from subspace iteration under a Chebyshev filter:

1. V meets a block Q of a few more columns than are asked for in a Spark pass over the fit list: each task
   adds up A'(AQ) of its centred rows A, and Spark adds up the tasks' sums. V itself is never made.
2. Rayleigh-Ritz in the block gives values and vectors, and their residuals |Vq - eq|.
3. A Chebyshev recurrence, one pass a degree, damps all below the block's least Ritz value; QR follows.
4. It ends when the residual of every asked component is at the rounding of double precision; a run that
   does not get there raises an error and gives nothing.

What passes through the driver is a block of dimension x columns, whatever the number of vectors. The sums of
x are exact (split into halves of 32 bits); rows are centred by the whole part and the fraction of the mean.

Defined cases: rows whose vector is null or holds a null or non-finite entry are dropped; no row left gives no
rows. Empty vectors and shorter ones count as zeros after their end. With fewer than 4 dimensions there is a
component for each. A component without variance (at most ``FLAT`` of the largest, as with one distinct
vector) has whitened null and explained 0, and identity_error is over the others (0 without any). Of equal
eigenvalues any orthonormal basis is given. An x beyond a long is the nearest long; a deviation beyond one is
null. Repeated rows are answered each; vec_id keeps its type and may be null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import materialize

#: Components, columns beyond them in the block, degree of the filter at most, rounds at most.
COMPONENTS, GUARD, DEGREE, ROUNDS = 4, 16, 10, 60
#: Residual over the largest eigenvalue: sought; enough when it no longer falls. Share of it that counts as none.
SOUGHT, ENOUGH, FLAT = 2e-15, 1e-12, 1e-13
#: How much more than the least value of the block a filter may enlarge the largest one.
ENLARGED = 1e10
#: Entries of vectors that a task works on at a time.
ENTRIES = 1 << 20


def integral(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<long>) of the vectors that can be used, all of one length."""
    entry = F.col("embedding").cast("array<double>")
    good = F.coalesce(~F.exists(entry, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))
    x = vectors.where(good).select("vec_id", F.transform(entry, lambda c: F.floor(c * 256.0)).alias("x"))
    least, most = x.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    return x if least == most else x.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(most) - F.size("x"))))


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, x of the rows) in parts of about ``ENTRIES``."""
    n = batch.num_rows
    if n:
        x = batch.column("x").flatten().to_numpy().reshape(n, -1)
        step = max(1, ENTRIES // max(1, x.shape[1]))
        for k in range(0, n, step):
            yield k, x[k : k + step]


def summed(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray], kind: str) -> dict[int, list]:
    """The sum over all rows of what ``part`` makes of a matrix of them: rows of numbers, by place."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in matrices(batch):
                total = part(x) if total is None else total + part(x)
        if total is not None:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1) * total.shape[1], pa.int32()), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), lists], ["place", "value"])

    rows = fit.mapInArrow(scan, f"place int, value array<{kind}>").select("place", F.posexplode("value").alias("column", "value"))
    rows = rows.groupBy("place", "column").agg(F.sum("value").alias("value")).groupBy("place").agg(F.sort_array(F.collect_list(F.struct("column", "value"))).alias("value"))
    return {r.place: [v.value for v in r.value] for r in rows.collect()}


@dataclass
class Whitening:
    """Components of a fit list of n x-vectors with ``sums`` by dimension, by falling eigenvalue."""

    n: int
    sums: list[int]
    largest: int
    values: np.ndarray
    components: np.ndarray
    residuals: np.ndarray
    trace: float
    passes: int
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums, self.largest)

    def scales(self) -> np.ndarray:
        """1 / sqrt(eigenvalue), NaN for components without variance."""
        good = self.values > FLAT * max(self.values.max(initial=0), 0)
        return np.where(good, 1 / np.sqrt(np.where(good, self.values, 1)), np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row, exact; null beyond a long."""
        bound = self.n * self.largest + max(map(abs, self.sums), default=0)
        if bound * bound * max(1, len(self.sums)) < 1 << 63:
            d = x * self.n - np.array(self.sums, np.int64)
            return (d * d).sum(axis=1).tolist()
        out = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x]
        return [v if v < 1 << 63 else None for v in out]


def centred(x: np.ndarray, n: int, sums: list[int], largest: int) -> np.ndarray:
    whole = [s // n for s in sums]
    rest = np.array([s % n / n for s in sums])
    x = x - np.array(whole, np.int64) if largest < 1 << 61 else x - np.array(whole, np.float64)
    return x.astype(np.float64) - rest


def sums_of(fit: DataFrame) -> tuple[int, list[int], int]:
    """(number of rows, exact sum of each dimension, largest absolute entry)"""

    def part(x: np.ndarray) -> np.ndarray:
        high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
        return np.vstack([np.append(high, 0), np.append(low, len(x))]).astype(np.int64)

    found = summed(fit, part, "long")
    if not found:
        return 0, [], 0
    top = fit.agg(F.max(F.greatest(F.abs(F.coalesce(F.array_max("x"), F.lit(0)).cast("decimal(20,0)")), F.abs(F.coalesce(F.array_min("x"), F.lit(0)).cast("decimal(20,0)"))))).first()[0]
    return found[1][-1], [(h << 32) + low for h, low in zip(found[0][:-1], found[1][:-1], strict=True)], int(top)


def fitted(fit: DataFrame, components: int = COMPONENTS, guard: int = GUARD) -> Whitening | None:
    """The leading components of the fit list ``fit`` (x array<long>, one length, distinct rows)."""
    n, sums, largest = sums_of(fit)
    d = len(sums)
    if not n:
        return None
    wanted, block, passes, trace = min(components, d), min(components + guard, d), 0, 0.0

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal passes, trace

        def part(x: np.ndarray) -> np.ndarray:
            a = centred(x, n, sums, largest)
            return np.column_stack([a.T @ (a @ q), (a * a).sum(axis=0)])

        found = summed(fit, part, "double")
        out = np.array([found[i] for i in range(d)]) / n
        passes, trace = passes + 1, float(out[:, -1].sum())
        return out[:, :-1]

    q = np.linalg.qr(np.random.default_rng(42).standard_normal((d, block)))[0]
    best = np.inf
    for _ in range(ROUNDS if d else 0):
        vq = times(q)
        values, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        residuals = np.linalg.norm(vq - q * values, axis=0)[:wanted]
        worst = residuals.max() / values[0] if values[0] > 0 else 0.0
        if worst <= SOUGHT or worst <= ENOUGH and worst > best / 4 or block == d and worst <= ENOUGH:
            break
        best = min(best, worst)
        q = np.linalg.qr(filtered(times, q, vq, values))[0]
    else:
        if d:
            raise RuntimeError(f"components were not certified in {ROUNDS} rounds: residual {worst:.3g} of the largest eigenvalue")
        return Whitening(n, sums, largest, np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0, passes)
    vectors = q[:, :wanted] * np.where(q[np.abs(q).argmax(axis=0), np.arange(block)] < 0, -1.0, 1.0)[:wanted]
    model = Whitening(n, sums, largest, np.maximum(values[:wanted], 0), vectors, residuals, trace, passes)
    model.identity_error = identity_error(fit, model)
    return model


def filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The block under a Chebyshev polynomial of V that is small on [0, least value of the block] and 1 at
    the largest; its degree keeps what the small wanted values lose against the largest within bounds."""
    top = values[0]
    half = max(values[-1], FLAT * top) / 2
    degree = int(np.clip(np.log(2 * ENLARGED) / np.arccosh(top / half - 1), 1, DEGREE)) if top > 2 * half else 1
    first = sigma = half / (top - half) if top > half else 1.0
    before, now = q, (vq - half * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (times(now) - half * now) * (2 * after / half) - sigma * after * before
        sigma = after
    return now


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    scales = model.scales()
    good = np.isfinite(scales)
    if not good.any():
        return 0.0
    n, sums, largest, onto = model.n, model.sums, model.largest, model.components[:, good] * scales[good]
    mean = np.array(summed(fit, lambda x: (centred(x, n, sums, largest) @ onto).sum(axis=0)[None], "double")[0]) / n

    def part(x: np.ndarray) -> np.ndarray:
        w = centred(x, n, sums, largest) @ onto - mean
        return w.T @ w

    found = summed(fit, part, "double")
    return float(np.abs(np.array([found[i] for i in range(len(mean))]) / n - np.eye(len(mean))).max())


def projected(x: DataFrame, model: Whitening) -> DataFrame:
    """The rows of (vec_id, x) on each component of the model."""
    kind = x.schema["vec_id"].dataType.simpleString()
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, scales = len(model.values), model.scales()
        explained = np.where(np.isfinite(scales), model.values / (model.trace or 1.0), 0.0)
        for batch in batches:
            for first, part in matrices(batch):
                m = len(part)
                white = ((model.centred(part) @ model.components) * scales).ravel()
                values = [
                    batch.column("vec_id").slice(first, m).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n)),
                    pa.array([v for v in model.deviations(part) for _ in range(k)], pa.int64()), pa.array(white, mask=~np.isfinite(white)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(values, names)

    return x.mapInArrow(scan, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each usable row of ``vectors``
    (vec_id, embedding) and each component."""
    x = integral(vectors)
    fit = materialize(x.select("x").distinct(), "fit")
    model = fitted(fit, components)
    if model is None or not len(model.values):
        kind = x.schema["vec_id"].dataType.simpleString()
        return x.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return projected(x, model)
