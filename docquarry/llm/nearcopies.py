"""Near copies by the Jaccard similarity of their 5-word shingles: SimHash first, prefix filtering for the rest.

A document is the set of its 5-word shingles (64-bit hashes; all words where there are fewer than five),
ASCII case folded. Equal sets are one class. Links come from exact similarity (``SIMILAR`` = 0.8 or more) of
whole texts alone; what differs is where candidates come from, and what is linked needs a spanning forest
only, so each round proposes one partner of a class:

1. SimHash fingerprints of the sets, linked by the generalised pigeonhole of ``neardup``: a class and the
   lowest that its fingerprint is linked to. This joins exact and close copies, but a pair of similarity 0.8 differs in
   about 10 of 64 bits, where random pairs begin to pass too, so it can't be complete.
2. Prefixes. Shingles stand in one order: those that a bounded sample shows to be frequent last, else by hash.
   Of sets x, y that are similar enough at most 0.25 |x| shingles of the union are not shared, so both hold
   a shared one among their first |x| - ceil(0.8 |x|) + 1. Where x has g |x| shingles that are not frequent,
   the first k of the union in hash order are all unshared with a probability of at most (0.25 / g)^k; k that
   brings it to 2^-64 is enough, the error that equal hashes have already. The partner of a class is the one
   that most of its prefix shingles name as their lowest class.
3. Every pair that meets in a prefix and is not joined yet. Where at most ``HOT`` of the classes left share a
   shingle they are joined as rows; more are compared in blocks, which give a spanning forest of what is
   plausible. Classes that hang together so are a cluster: each of its texts is fetched once, and blocks of
   the cluster are compared exactly and give a spanning forest of the links, never pairs.

Candidates whose sketches (``SKETCH`` lowest hashes) share fewer than ``SHARED`` can't be similar enough (a wrong
drop has a probability below 1e-16) and go before any text is fetched.

Defined cases: null, empty and blank texts have the empty set and are one class; repeated rows and ties
fall to the smallest doc_id, of that to the lowest (set, text) hash and then to the lowest row as JSON; an
empty table gives an empty result; rows without an id stay; other columns are kept, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm import neardup
from docquarry.llm.common import connected_components, materialize, whole_id
from docquarry.llm.text import LOWER, Words, batches_of, mixed, texts_of

WIDTH, SIMILAR = 5, (4, 5)
#: Hashes of a sketch, and how many two near copies share at least; bound of the error in nats.
SKETCH, SHARED, ERROR = 128, 60, 64 * math.log(2)
#: Sampled documents, share of them that makes a shingle frequent, frequent shingles at most (cost only).
SAMPLE, OFTEN, FREQUENT = 10_000, 0.002, 100_000
#: Classes on one shingle that are still joined as rows; classes in a block beyond that, and their shingles.
HOT, BLOCK, BLOCK_SHINGLES = 8, 512, 1 << 20
#: Texts that are compared at a time, and their compressed bytes.
PAIRS, PAIR_BYTES = 256, 1 << 20


def sets_of(column) -> list[np.ndarray]:
    """The sorted shingle hashes of each text of an Arrow column."""
    data, offsets = texts_of(column)
    out: list[np.ndarray] = []
    for a, b in batches_of(data, offsets, 1 << 20):
        words = Words(LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a])
        hashes = words.hashes()
        at, h = words.windows(WIDTH, hashes)
        cut = np.searchsorted(at, words.first)
        for i, n in enumerate(words.counts):
            if n >= WIDTH:
                out.append(np.unique(h[cut[i] : cut[i + 1]]))
            elif n:
                own, x = hashes[words.first[i] : words.first[i + 1]], np.array([n], np.uint64)
                for y in own:
                    x = mixed(x * np.uint64(31) + y)
                out.append(x)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_keys(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two 64-bit hashes of each set, as signed longs."""
    with np.errstate(over="ignore"):
        sums = [[mixed(x ^ c).sum(dtype=np.uint64) + np.uint64(len(x)) for x in sets] for c in (np.uint64(0), np.uint64(0x9E3779B97F4A7C15))]
        return [pa.array(mixed(np.array(x, np.uint64)).view(np.int64), pa.int64()) for x in sums]


def prefix_of(x: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set that a near copy must meet."""
    n = len(x)
    if not n:
        return x
    late = np.isin(x, frequent, assume_unique=True)
    rare = n - int(late.sum())
    size = n - -(-SIMILAR[0] * n // SIMILAR[1]) + 1
    if 4 * rare > n:
        size = min(size, math.ceil(ERROR / math.log(4 * rare / n)))
    return np.concatenate([x[~late], x[late]])[:size]


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(x) + len(y) - both)


def frequent_of(docs: DataFrame) -> np.ndarray:
    """The shingles that a bounded sample of documents (equal sets once) shows most often, sorted; they
    steer cost only."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = sets_of(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*set_keys(sets), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["key", "check", "shingles"])

    some = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.join(F.broadcast(some), "doc_id", "left_semi").select("text")
    found = texts.mapInArrow(scan, "key long, check long, shingles array<long>").dropDuplicates(["key", "check"]).select(F.explode("shingles").alias("shingle"))
    most = found.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, OFTEN * SAMPLE))
    top = most.orderBy(F.col("n").desc(), "shingle").limit(FREQUENT).toPandas()
    return np.sort(top["shingle"].to_numpy(np.int64).view(np.uint64))


PRINTS = "doc_id {}, text_hash long, key long, check long, n long, fp long, prefix array<long>, sketch array<int>"


def prints_of(docs: DataFrame) -> DataFrame:
    """What is known of each document, from one pass over the texts: the two keys of its set and its size, SimHash,
    prefix and sketch."""
    late = docs.sparkSession.sparkContext.broadcast(frequent_of(docs))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = sets_of(batch.column("text"))
            columns = [
                *set_keys(sets), pa.array([len(x) for x in sets], pa.int64()), pa.array([int(neardup.majority(x).view(np.int64)) for x in sets], pa.int64()),
                pa.array([prefix_of(x, late.value).view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array([x[:SKETCH].astype(np.uint32).view(np.int32) for x in sets], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *columns], ["doc_id", "text_hash", "key", "check", "n", "fp", "prefix", "sketch"])

    return materialize(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(scan, PRINTS.format(docs.schema["doc_id"].dataType.simpleString())), "prints")


def plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets whose sizes and sketches allow the similarity."""
    side = lambda c: classes.select(F.col("set").alias(c), F.col("sketch").alias(f"s{c}"), F.col("n").alias(f"n{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(fits("na", "nb"))
    least = F.least(F.lit(SHARED), F.floor(3 * F.least("na", "nb") / 5))
    return both.where(F.size(F.array_intersect("sa", "sb")) >= least).select("a", "b")


def fits(a: str, b: str) -> Column:
    """Whether the sizes allow the similarity."""
    return (F.col(a) * SIMILAR[1] >= F.col(b) * SIMILAR[0]) & (F.col(b) * SIMILAR[1] >= F.col(a) * SIMILAR[0])


def texts_for(docs: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(set, body), one compressed text of each class that ``sets`` (one column, set) names."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = pa.array([zstandard.compress((t or "").encode(), 3) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("set"), body], ["set", "body"])

    # by id and text: rows that share an id are fetched for their own text only
    wanted = classes.join(sets, "set", "left_semi").select("set", "rep.doc_id", "rep.text_hash")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    out = keyed.join(wanted, ["doc_id", "text_hash"]).select("set", "text").mapInArrow(scan, "set long, body binary")
    return materialize(out.dropDuplicates(["set"]), "texts")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets whose similarity is high enough, by their whole texts."""
    pairs = materialize(plausible(pairs.select("a", "b").distinct(), classes), "pairs")
    texts = texts_for(docs, pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct(), classes)
    left, right = (texts.select(F.col("set").alias(c), F.col("body").alias(f"t{c}")) for c in "ab")

    def sets_for(keys: list[int], bodies: list[bytes]) -> dict[int, np.ndarray]:
        own = dict(zip(keys, bodies, strict=True))
        return dict(zip(own, sets_of(pa.array([zstandard.decompress(x).decode() for x in own.values()], pa.string())), strict=True))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ta, tb = (batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))
            good, i = np.zeros(len(a), bool), 0
            while i < len(a):
                j, size = i, 0
                while j < len(a) and j - i < PAIRS and (j == i or size + len(ta[j]) + len(tb[j]) <= PAIR_BYTES):
                    size, j = size + len(ta[j]) + len(tb[j]), j + 1
                xs, ys = sets_for(a[i:j], ta[i:j]), sets_for(b[i:j], tb[i:j])
                good[i:j] = [similar(xs[p], ys[q]) for p, q in zip(a[i:j], b[i:j], strict=True)]
                i = j
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good))

    return materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(each, "a long, b long"), "links")


def by_fingerprint(classes: DataFrame) -> DataFrame:
    """(a, b): each set and the lowest that its SimHash fingerprint is linked to."""
    prints = materialize(classes.groupBy(F.col("fp").alias("__fp")).agg(F.min("set").alias("__rep")), "fingerprints")
    both = neardup.links(prints).select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    near = both.groupBy(F.col("a").alias("__rep")).agg(F.min("b").alias("near"))
    low = prints.join(near, "__rep", "left").select(F.col("__fp").alias("fp"), F.least("__rep", "near").alias("b"))
    return classes.select("fp", F.col("set").alias("a")).join(low, "fp").where("a <> b").select("a", "b")


def meeting(classes: DataFrame) -> DataFrame:
    """(shingle, set, n) of the prefixes, for shingles on which at least two classes meet."""
    rows = classes.select(F.explode("prefix").alias("shingle"), "set", "n")
    shared = rows.groupBy("shingle").agg(F.count("*").alias("k")).where("k > 1").select("shingle")
    return materialize(rows.join(shared, "shingle", "left_semi"), "meeting")


def by_prefix(rows: DataFrame) -> DataFrame:
    """(a, b): each set and the partner that most of its shingles name as their lowest in hash order."""
    low = rows.groupBy("shingle").agg(F.min(F.struct(F.xxhash64("set").alias("o"), F.col("set").alias("b"), F.col("n").alias("m"))).alias("low"))
    met = rows.join(low, "shingle").where((F.col("set") != F.col("low.b")) & fits("n", "low.m"))
    named = met.groupBy(F.col("set").alias("a"), F.col("low.b").alias("b")).agg(F.count("*").alias("k"))
    return named.groupBy("a").agg(F.max_by("b", F.struct("k", "b")).alias("b"))


def joined(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the component of their set, of shingles where more than one component is left."""
    parts = connected_components(links).select(F.col("node").alias("set"), "component")
    out = rows.drop("component").join(parts, "set", "left").withColumn("component", F.coalesce("component", "set"))
    left = out.groupBy("shingle").agg((F.min("component") < F.max("component")).alias("more")).where("more").select("shingle")
    return materialize(out.join(left, "shingle", "left_semi"), "left")


def shared_of(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets have in common."""
    values, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    values, who = values[order], who[order]
    edges = np.flatnonzero(np.diff(values)) + 1
    starts, ends = np.append(0, edges), np.append(edges, len(values))
    both = np.zeros((len(sets), len(sets)), np.int32)
    for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
        both[np.ix_(who[a:b], who[a:b])] += 1
    return both


def forest(near: np.ndarray, key: np.ndarray) -> pd.DataFrame:
    """(a, b): each key that is linked and the lowest that its links reach."""
    label = neardup.forest(near)
    low = np.full(len(key), np.iinfo(np.int64).max)
    np.minimum.at(low, label, key)
    out = pd.DataFrame({"a": key, "b": low[label]})
    return out[out.a != out.b].drop_duplicates()


def apart(pdf: pd.DataFrame) -> np.ndarray:
    """Pairs of different components whose sizes allow the similarity."""
    n, part = pdf["n"].to_numpy(np.int64), pdf["component"].to_numpy(np.int64)
    return (part[:, None] != part[None, :]) & (SIMILAR[1] * n[:, None] >= SIMILAR[0] * n[None, :]) & (SIMILAR[1] * n[None, :] >= SIMILAR[0] * n[:, None])


def alike(pdf: pd.DataFrame) -> pd.DataFrame:
    """A forest of the pairs of a block whose sketches allow the similarity."""
    n, both = pdf["n"].to_numpy(np.int64), shared_of([np.asarray(x, np.int32) for x in pdf["sketch"]])
    least = np.minimum(SHARED, 3 * np.minimum(n[:, None], n[None, :]) // 5)
    return forest((both >= least) & apart(pdf), pdf["set"].to_numpy(np.int64))


def linked(pdf: pd.DataFrame) -> pd.DataFrame:
    """A forest of the links between the components of a block, by whole texts."""
    sets = sets_of(pa.array([zstandard.decompress(x).decode() for x in pdf["body"]], pa.string()))
    n, both = np.array([len(x) for x in sets]), shared_of(sets)
    near = SIMILAR[1] * both >= SIMILAR[0] * (n[:, None] + n[None, :] - both)
    return forest(near & apart(pdf), pdf["set"].to_numpy(np.int64))


def in_blocks(rows: DataFrame, cuts: Column) -> DataFrame:
    """``rows`` once for each pair of blocks (x, y) of their group that they take part in; ``cuts``: blocks."""
    rows = rows.withColumn("cuts", cuts.cast("int")).withColumn("cut", F.pmod(F.xxhash64("set"), F.col("cuts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    return rows.withColumn("x", F.least("cut", "other")).withColumn("y", F.greatest("cut", "other")).drop("cuts", "cut", "other")


def rest(rows: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): enough links between the components that are left for what they join to be joined."""
    k = rows.groupBy("shingle").agg(F.count("*").alias("k"))
    rows = materialize(rows.join(k, "shingle"), "rest")
    cold = rows.where(F.col("k") <= HOT)
    a, b = (cold.select("shingle", F.col("set").alias(x), F.col("n").alias(f"n{x}"), F.col("component").alias(f"c{x}")) for x in "ab")
    few = a.join(b, "shingle").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & fits("na", "nb")).select("a", "b").distinct()
    hot = rows.where(F.col("k") > HOT).join(classes.select("set", "sketch"), "set")
    hot = in_blocks(hot, F.ceil(F.col("k") / BLOCK)).select("shingle", "x", "y", "set", "n", "component", "sketch")
    many = hot.groupBy("shingle", "x", "y").applyInPandas(alike, "a long, b long")
    clusters = materialize(connected_components(plausible(few, classes).unionAll(many)).select(F.col("node").alias("set"), F.col("component").alias("cluster")), "clusters")
    texts = texts_for(docs, clusters.select("set"), classes)
    parts = rows.select("set", "n", "component").distinct()
    found = clusters.join(parts, "set").join(texts, "set")
    sizes = materialize(clusters.join(parts, "set").groupBy("cluster").agg(F.count("*").alias("k"), F.sum("n").alias("s")), "sizes")
    cuts = F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES), F.lit(1))
    found = in_blocks(found.join(sizes, "cluster"), cuts).select("cluster", "x", "y", "set", "n", "component", "body")
    return materialize(found.groupBy("cluster", "x", "y").applyInPandas(linked, "a long, b long"), "links")


def numbered(prints: DataFrame) -> DataFrame:
    """One row of each distinct set, under a number of its own (``set``): its first key, or where different sets
    share that a hash of both keys for all but the first."""
    one = lambda c: F.first(c).alias(c)
    rep = F.min(F.struct("doc_id", "text_hash")).alias("rep")
    classes = materialize(prints.groupBy("key", "check").agg(rep, *map(one, ("n", "fp", "prefix", "sketch"))), "sets")
    shared = classes.groupBy("key").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high")
    number = F.when(F.col("check") != F.col("low"), F.xxhash64("key", "check")).otherwise(F.col("key"))
    return classes.join(materialize(shared, "shared").select("key", "low"), "key", "left").withColumn("set", number).drop("low")


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, set and component (a number of its group) of each row that has an id."""
    docs = docs.where("doc_id IS NOT NULL").select(whole_id(docs, "doc_id").alias("doc_id"), "text")
    prints = prints_of(docs)
    classes = materialize(numbered(prints), "classes")
    rows = meeting(classes).withColumn("component", F.col("set"))
    links = verified(by_fingerprint(classes).unionAll(by_prefix(rows)), docs, classes)
    links = links.unionAll(rest(joined(rows, links), docs, classes))
    parts = connected_components(links).select(F.col("node").alias("set"), "component")
    of_keys = classes.select("key", "check", "set").join(parts, "set", "left").withColumn("component", F.coalesce("component", "set"))
    return prints.select("doc_id", "text_hash", "key", "check").join(of_keys, ["key", "check"]).drop("key", "check")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id and component_id, the smallest doc_id of its group, of each row that has an id."""
    found = materialize(grouped(docs), "groups")
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "component").select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group, as the module's defined cases say; same columns. Rows without
    an id stay."""
    own = F.struct("doc_id", "set", "text_hash")
    per = grouped(docs).groupBy("component", "doc_id", "set", "text_hash").agg(F.count("*").alias("rows"))
    kept = per.groupBy("component").agg(F.min_by(F.struct("doc_id", "text_hash", "rows"), own).alias("k")).select(F.col("k.doc_id").alias("id"), F.col("k.text_hash").alias("hash"), F.col("k.rows").alias("rows"))
    kept = materialize(kept, "kept")
    keyed = docs.where("doc_id IS NOT NULL").select(whole_id(docs, "doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    single = keyed.join(kept.where("rows = 1"), ["id", "hash"]).select("row.*")
    several = keyed.join(kept.where("rows > 1"), ["id", "hash"]).groupBy("id", "hash").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return single.unionAll(several).unionAll(docs.where("doc_id IS NULL"))
