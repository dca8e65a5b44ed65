"""Near-duplicate embeddings by an inverted multi-index.

Unit vectors are cut into halves; each half has a codebook of its own, and a pair of codewords is a cell
of the product grid. Equal vectors are one class. A class is stored in the cell of its nearest codewords
and visits cells in ascending order of a lower bound: what its two halves would have to move, at
least, to reach a cell's own region. The multi-sequence traversal of the two sorted lists stops where the
bound passes the one that reaches ``RECALL`` of each kind of neighbour that a sample shows: pairs in it at the
threshold or nearer, and neighbours simulated at the threshold itself in any direction, towards other rows,
towards the nearest ones, and within either half alone. It never goes beyond the bound that no link can pass,
which ``recall=1`` takes at once (exact). Pairs that meet in a cell are verified by cosine in double precision.

The codebooks grow with the largest label, about ``FILL`` classes of it to a cell, and are fitted with the
bound on at most ``SAMPLE`` classes (lowest hash first); every class is indexed. Neighbouring cells of a label
make a bundle of about ``BLOCK`` classes: a vector crosses the shuffle once for each bundle it visits, not for
each cell. A larger bundle is cut into parts that are compared part by part; a task gives the links of each
class summed up and a spanning forest of what it joins, never pairs.

Defined cases: a row whose label is null, or whose vector is null, empty, zero or holds null or
non-finite parts links with nothing; vectors of different length do not link; a repeated row is another
vector (one more link); rows are told apart by their vectors, so rows that share a vec_id need not share a
component; a row without vec_id links and counts like any other, and its component is the smallest vec_id it
reaches (null without any), of the type of vec_id, whole numbers as long; an empty table gives an empty result; other columns are ignored. Vectors are
told apart by two 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import connected_components, materialize, whole_id

THRESHOLD, RECALL = 0.93, 0.999
SAMPLE, BLOCK = 8000, 2048
#: Classes of one label that a cell should hold, about; codewords of a half at least and at most.
FILL, LEAST_WORDS, MOST_WORDS = 512, 4, 256


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Codewords of a half, from seeded k-means++ and Lloyd rounds."""
    rng, k = np.random.default_rng(seed), max(1, min(k, len(points)))
    words = points[rng.integers(len(points))][None]
    far = ((points - words[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        p = far.cumsum()
        at = min(int(np.searchsorted(p, rng.random() * p[-1])), len(points) - 1) if p[-1] > 0 else int(rng.integers(len(points)))
        words = np.vstack([words, points[at]])
        far = np.minimum(far, ((points - points[at]) ** 2).sum(axis=1))
    for _ in range(rounds):
        near = distances(points, words).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(words)
        np.add.at(sums, near, points)
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return words


def distances(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(axis=1)[:, None] - 2 * points @ words.T + (words**2).sum(axis=1)[None], 0)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; scaled by their largest part first."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))


class MultiIndex:
    """Two codebooks and the bound at which a traversal stops."""

    def __init__(self, sample: np.ndarray, words: int, threshold: float, recall: float = RECALL, seed: int = 7):
        self.cut, self.safe = max(1, sample.shape[1] // 2), 2 * (1 - threshold) + 1e-9
        self.books = [along(kmeans(x, words)) for x in self.halves(sample)]
        self.gaps = [np.sqrt(distances(b, b)) for b in self.books]
        self.stop = self.safe
        if recall < 1:
            needs = [np.quantile(self.needed(sample, other), recall) for other in simulated(sample, self.cut, threshold, seed)]
            self.stop = float(min(self.safe, max(self.needed_by_pairs(sample, threshold, recall), *needs) + 1e-9))

    def needed(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The bound at which u visits the home of v."""
        rows, bounds, cells = np.arange(len(u)), self.bounds(u), self.home(v)
        return bounds[0][rows, cells[0]] + bounds[1][rows, cells[1]]

    def needed_by_pairs(self, u: np.ndarray, threshold: float, recall: float, bins: int = 4096) -> float:
        """The bound that reaches the share ``recall`` of the neighbours among the rows (all of few)."""
        counts, home = np.zeros(bins, np.int64), self.home(u)
        for k in range(0, len(u), 256):
            near = u[k : k + 256] @ u.T >= threshold
            near[np.arange(len(near)), np.arange(k, k + len(near))] = False
            if near.any():
                one, two = self.bounds(u[k : k + 256])
                need = (one[:, home[0]] + two[:, home[1]])[near]
                counts += np.bincount(np.minimum(need * (bins / self.safe), bins - 1).astype(np.int64), minlength=bins)
        reached = counts.cumsum()
        return float((np.searchsorted(reached, recall * reached[-1]) + 1) * self.safe / bins) if reached[-1] else 0.0

    def halves(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return u[:, : self.cut], u[:, self.cut :]

    def home(self, u: np.ndarray) -> list[np.ndarray]:
        return [distances(x, b).argmin(axis=1) for x, b in zip(self.halves(u), self.books, strict=True)]

    def bounds(self, u: np.ndarray) -> list[np.ndarray]:
        """For each half and codeword: the square of the way to the plane between it and the nearest one."""
        out = []
        for x, b, gap in zip(self.halves(u), self.books, self.gaps, strict=True):
            d = distances(x, b)
            own = d.argmin(axis=1)
            way = (d - d[np.arange(len(x)), own][:, None]) / np.maximum(2 * gap[own], 1e-12)
            out.append(np.where(np.arange(len(b))[None] == own[:, None], 0, way**2))
        return out

    def visits(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cells): the cells that each row visits, nearest first. For each codeword of the first half a
        pointer walks the sorted second half; the least sum of all pointers is the next cell."""
        one, two = self.bounds(u)
        first, second = np.argsort(one, axis=1, kind="stable"), np.argsort(two, axis=1, kind="stable")
        one, two = np.take_along_axis(one, first, 1), np.take_along_axis(two, second, 1)
        two = np.hstack([two, np.full((len(u), 1), np.inf)])
        at, left = np.zeros(one.shape, np.int64), np.arange(len(u))
        ahead = one + two[:, :1]
        rows, cells, size = [], [], len(self.books[1])
        while len(left):
            p = ahead[left].argmin(axis=1)
            on = ahead[left, p] <= self.stop
            left, p = left[on], p[on]
            rows.append(left)
            cells.append(first[left, p] * size + second[left, at[left, p]])
            at[left, p] += 1
            ahead[left, p] = one[left, p] + two[left, at[left, p]]
        return np.concatenate(rows), np.concatenate(cells)

    def bundles(self, cells: np.ndarray, across: np.ndarray, down: np.ndarray) -> np.ndarray:
        """The bundle of each cell where a label's grid is cut into across x down bundles."""
        one, two = np.divmod(cells, len(self.books[1]))
        return (one * across // len(self.books[0])) * down + two * down // len(self.books[1])

    def meets(self, bounds: list[np.ndarray], cells: np.ndarray) -> np.ndarray:
        """(rows, cells): whether each row visits each cell."""
        one, two = np.divmod(cells, len(self.books[1]))
        return bounds[0][:, one] + bounds[1][:, two] <= self.stop


def simulated(sample: np.ndarray, cut: int, threshold: float, seed: int) -> Iterator[np.ndarray]:
    """A neighbour of each row exactly at the threshold: in any direction, along the data (towards other rows,
    and towards the nearest ones), and along the data or in any direction within one half."""
    rng, n = np.random.default_rng(seed), len(sample)
    near = np.zeros(n, np.int64)
    for k in range(0, n, 1024):
        like = sample[k : k + 1024] @ sample.T
        like[like >= threshold] = -2
        like[np.arange(len(like)), np.arange(k, k + len(like))] = -2
        near[k : k + 1024] = like.argmax(axis=1)
    free = rng.normal(size=sample.shape)
    toward, nearest = sample[rng.integers(0, n, n)] - sample, sample[near] - sample
    for way in (free, toward, nearest):
        for half in (slice(None), slice(0, cut), slice(cut, None)):
            turn = np.zeros_like(sample)
            turn[:, half] = way[:, half]
            # at right angles to the row, and of length 1 where something is left
            own = np.zeros_like(sample)
            own[:, half] = sample[:, half]
            turn -= (turn * sample).sum(axis=1, keepdims=True) / np.maximum((own * own).sum(axis=1, keepdims=True), 1e-12) * own
            size = np.sqrt((turn**2).sum(axis=1, keepdims=True))
            good = size[:, 0] > 1e-6
            other = sample.copy()
            other[good] = threshold * sample[good] + np.sqrt(max(0.0, 1 - threshold**2)) * (turn[good] / size[good])
            yield other


def along(words: np.ndarray) -> np.ndarray:
    """Codewords in the order of their widest direction, so that neighbours share a bundle."""
    middle = words - words.mean(axis=0)
    return words[np.argsort(middle @ np.linalg.svd(middle, full_matrices=False)[2][0], kind="stable")]


def components_of(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of rows and columns of a boolean matrix seen as links between them."""
    rows, columns = np.arange(near.shape[0]), np.full(near.shape[1], near.shape[0], np.int64)
    while True:
        new = np.minimum(columns, np.where(near, rows[:, None], near.shape[0]).min(axis=0))
        low = np.minimum(rows, np.where(near, new[None], near.shape[0]).min(axis=1))
        if (low == rows).all() and (new == columns).all():
            return rows, columns
        rows, columns = low, new


def matrix(column) -> np.ndarray:
    """A list column whose lists have one length, as a matrix."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1)


def usable(df: DataFrame) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return df.where("label IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0").where(~bad & some)


def links(classes: DataFrame, threshold: float, recall: float = RECALL) -> DataFrame:
    """(cid, n, root): of each class and task, the vectors it is linked to and a class it hangs together
    with. classes: cid, m (vectors in it), label, dim, embedding; all of one dim."""
    spark = classes.sparkSession
    labels = materialize(classes.groupBy("label").agg(F.count("*").alias("of_label")), "labels")
    largest = labels.agg(F.max("of_label")).first()[0]
    rows = classes.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).select("embedding").toArrow()
    words = int(np.clip(np.ceil(np.sqrt(largest / FILL)), LEAST_WORDS, MOST_WORDS))
    index = spark.sparkContext.broadcast(MultiIndex(unit(matrix(rows.column("embedding"))), words, threshold, recall))
    names = ["label", "cid", "m", "embedding", "home", "own", "bundles"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            grid, u = index.value, unit(matrix(batch.column("embedding")))
            rows, cells = grid.visits(u)
            home = grid.home(u)
            home = home[0] * len(grid.books[1]) + home[1]
            want = np.ceil(batch.column("of_label").to_numpy() / BLOCK)
            across = np.minimum(np.ceil(np.sqrt(want)), len(grid.books[0])).astype(np.int64)
            down = np.minimum(np.ceil(want / across), len(grid.books[1])).astype(np.int64)
            most = len(grid.books[0]) * len(grid.books[1])
            met = np.unique(rows * most + grid.bundles(cells, across[rows], down[rows]))
            ends = np.searchsorted(met // most, np.arange(batch.num_rows + 1))
            bundles = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(met % most, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:4]), pa.array(home, pa.int32()), pa.array(grid.bundles(home, across, down), pa.int32()), bundles], names)

    kinds = {c: classes.schema[c].dataType.simpleString() for c in ("label", "embedding")}
    placed = classes.join(labels, "label").select(*names[:4], "of_label").mapInArrow(place, f"label {kinds['label']}, cid long, m long, embedding {kinds['embedding']}, home int, own int, bundles array<int>")
    placed = materialize(placed, "placed")
    # a bundle of more than BLOCK visitors is cut into parts; task (h, v): residents of part h, visitors of part v
    cuts = placed.select("label", F.explode("bundles").alias("bundle")).groupBy("label", "bundle").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cuts"))
    rows = placed.select(*names[:5], "own", F.explode("bundles").alias("bundle")).join(materialize(cuts, "cuts"), ["label", "bundle"])
    rows = rows.withColumn("resident", F.col("own") == F.col("bundle")).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("cuts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("cuts") - 1)
    task = lambda h, v: F.struct(h.alias("h"), v.alias("v"))
    asks, holds = F.transform(every, lambda x: task(x, F.col("part"))), F.transform(F.filter(every, lambda x: x != F.col("part")), lambda x: task(F.col("part"), x))
    rows = rows.withColumn("task", F.explode(F.when(F.col("resident"), F.concat(asks, holds)).otherwise(asks)))

    def verify(table: pa.Table) -> pa.Table:
        grid, task = index.value, table.column("task")[0].as_py()
        part, resident, cid, m, home = (table.column(c).to_numpy() for c in ("part", "resident", "cid", "m", "home"))
        q, b = np.flatnonzero(part == task["v"]), np.flatnonzero(resident & (part == task["h"]))
        u = unit(matrix(table.column("embedding")))
        asked, stored = grid.bounds(u[q]), grid.bounds(u[b])
        near = np.zeros((len(q), len(b)), bool)
        for cell in np.unique(home[b]):
            at = np.flatnonzero(home[b] == cell)
            who = np.flatnonzero(grid.meets(asked, np.array([cell]))[:, 0])
            near[np.ix_(who, at)] = u[q[who]] @ u[b[at]].T >= threshold
        near &= cid[q][:, None] != cid[b][None]
        some_q, some_b = near.any(axis=1), near.any(axis=0)
        q, b, near = q[some_q], b[some_b], near[np.ix_(some_q, some_b)]
        forward = near @ m[b].astype(float)
        # a resident counts a visitor only if it does not itself visit that one's home
        back = (near.T & ~grid.meets([x[some_b] for x in stored], home[q])) @ m[q].astype(float)
        if not len(q):
            return pa.table({c: pa.array([], pa.int64()) for c in ("cid", "n", "root")})
        rows_, columns_ = components_of(near)
        least = np.full(near.shape[0] + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, rows_, cid[q])
        np.minimum.at(least, columns_, cid[b])
        return pa.table({"cid": np.concatenate([cid[q], cid[b]]), "n": np.concatenate([forward, back]).astype(np.int64), "root": np.concatenate([least[rows_], least[columns_]])})

    rows = rows.select("label", "bundle", "task", "resident", "part", "cid", "m", "home", "embedding")
    return rows.groupBy("label", "bundle", "task").applyInArrow(verify, "cid long, n long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    known = [F.xxhash64(F.lit(k), "embedding").alias(f"d{k}") for k in (1, 2)]
    whole = vectors.select("vec_id", "label", "embedding").select("*", *known, F.size("embedding").alias("dim"))
    classes = usable(whole).groupBy("label", "dim", "d1", "d2").agg(F.first("embedding").alias("embedding"), F.count("*").alias("m"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    found = None
    for (dim,) in classes.select("dim").distinct().orderBy("dim").collect():
        part = links(classes.where(F.col("dim") == dim), threshold, recall)
        found = part if found is None else found.unionAll(part)
    own = whole_id(vectors, "vec_id")
    if found is None:
        return whole.select("vec_id", F.lit(0).cast("long").alias("n_links"), own.alias("component_id"), F.lit(True).alias("kept"))
    found = materialize(found, "links")
    sums = found.groupBy("cid").agg(F.sum("n").alias("n"))
    parts = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    told = classes.select("label", "dim", "d1", "d2", "cid", "m").join(sums, "cid", "left").join(parts, F.col("cid") == F.col("node"), "left")
    told = told.select("label", "dim", "d1", "d2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    out = materialize(whole.select("vec_id", "label", "dim", "d1", "d2").join(told, ["label", "dim", "d1", "d2"], "left").select("vec_id", "n_links", "component"), "told")
    least = out.where("component IS NOT NULL").groupBy("component").agg(F.min(own).alias("least"))
    out = out.join(least, "component", "left")
    component = F.when(F.col("component").isNull(), own).otherwise(F.col("least"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(own == component, F.lit(False)).alias("kept"))
