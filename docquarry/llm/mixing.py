"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

Words are cut into equal blocks of ``block`` words, or fewer (to one word) where that is over 1/``block`` of
the least target, so that no source is too small for a seat. Seats (blocks) go to sources by highest quotients target/(2s+1),
then inside a source to its shards by size, so every shard has an integer quota and can select on
its own. Neither takes more seats than its words allow under the limit (the last block is cut in words): what it
refuses goes to the next quotients. A source has one shard for about ``SHARD_WORDS`` words. Inside a shard documents
stand in a seeded order on a circle of words; the quota is taken as whole rounds plus one run that
starts at a seeded block.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source of its own,
ranked last; repeated rows and ids are separate documents, placed by a hash of id and row, so that reruns
agree whatever the order of rows; ties in quotients go to the earlier key; an empty table gives an empty
result; other columns are ignored or, by ``mixed_copies``, kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a shard, about; hash buckets of a source that make up its shards.
SHARD_WORDS, BUCKETS = 1 << 17, 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sainte_lague(parts: DataFrame, group: Sequence[str], key: str, votes: str, seats: str, most: str | None = None) -> DataFrame:
    """``parts`` with the column ``quota``: the Sainte-Laguë share of ``seats`` (one number for each
    group) by ``votes``; equal quotients go by ``key``. ``most``: seats a part can have.

    Rounding votes at the common level (that of the parts that stay under ``most``) is off by a few seats;
    only the quotients next to it are listed and ranked. A part may gain at most its share of
    (missing + parts) seats plus two, so the listed quotients are linear in the number of parts.
    """
    own = parts.columns
    w = Window.partitionBy(*group)
    cap = F.col(most).cast("long") if most else F.col(seats).cast("long")
    df = parts.select(*own, cap.alias("__cap"), F.col(votes).cast("double").alias("__v"))
    reach = F.when(F.col("__v") > 0, F.col("__cap") / F.col("__v"))
    order = w.orderBy(reach, F.col(key))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = F.when(F.col("__v") > 0, (F.col(seats) - F.coalesce(F.sum(F.when(F.col("__v") > 0, F.col("__cap"))).over(before), F.lit(0))) / F.sum("__v").over(after))
    df = df.withColumn("__l", level).withColumn("__l", F.greatest(F.max("__l").over(w), F.lit(0.0)))
    df = df.withColumn("__s", F.when(F.col("__v") > 0, F.least(F.col("__cap"), F.floor(F.col("__v") * F.col("__l") + 0.5))).otherwise(0).cast("long"))
    df = df.withColumn("__open", (F.col("__v") > 0) & (F.col("__s") < F.col("__cap"))).withColumn("__n", F.count(F.lit(1)).over(w))
    df = df.withColumn("__d", F.least(F.col(seats), F.sum(F.when(F.col("__v") > 0, F.col("__cap")).otherwise(0)).over(w)) - F.sum("__s").over(w))
    df = df.withColumn("__tot", F.sum(F.when((F.col("__d") < 0) | F.col("__open"), F.col("__v"))).over(w))
    room = F.when(F.col("__tot") > 0, F.floor(F.col("__v") / F.col("__tot") * (F.abs("__d") + F.col("__n"))) + 2).otherwise(0).cast("long")
    more = F.transform(F.sequence(F.lit(0).cast("long"), F.least(room, F.col("__cap") - F.col("__s")) - 1), lambda k: F.col("__v") / (2 * (F.col("__s") + k) + 1))
    less = F.transform(F.sequence(F.lit(0).cast("long"), F.least(room, F.col("__s")) - 1), lambda k: -F.col("__v") / (2 * (F.col("__s") - k) - 1))
    none = F.array().cast("array<double>")
    listed = F.when((F.col("__d") > 0) & F.col("__open"), more).when((F.col("__d") < 0) & (F.col("__s") > 0), less).otherwise(none)
    df = df.select(*own, "__s", "__d", F.posexplode_outer(listed).alias("__k", "__q"))
    first = Window.partitionBy(*group).orderBy(F.col("__q").desc_nulls_last(), F.col(key), F.col("__k"))
    won = ((F.row_number().over(first) <= F.abs("__d")) & F.col("__q").isNotNull()).cast("long")
    return (
        df.withColumn("__won", won)
        .groupBy(*own, "__s", "__d")
        .agg(F.sum("__won").alias("__w"))
        .select(*own, (F.col("__s") + F.signum("__d").cast("long") * F.col("__w")).alias("quota"))
    )


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, limit: float) -> DataFrame:
    """(key, source_size, target) from one row (key, source_size) for each source.

    The common level is the largest root of the linear pieces of sum(min(limit * size, level * weight)),
    which is concave, so excess over a limit is reshared by weight until none is above.
    """
    rank = Window.orderBy("key")
    df = sizes.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(rank) - 1) % len(weights) + 1).cast("double"))
    df = df.withColumn("__cap", F.col("source_size") * F.lit(float(limit)))
    everything = Window.partitionBy(F.lit(1))
    before = Window.orderBy(F.col("__cap") / F.col("__w"), "key").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.col("__cap") / F.col("__w"), "key").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    want = F.sum("source_size").over(everything) * F.lit(float(share))
    df = df.withColumn("__want", want)
    df = df.withColumn("__level", (F.col("__want") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(after))
    df = df.withColumn("__level", F.max("__level").over(everything)).withColumn("__caps", F.sum("__cap").over(everything))
    target = F.when(F.col("__want") >= F.col("__caps"), F.col("__cap")).otherwise(F.least("__cap", F.col("__level") * F.col("__w")))
    return df.select("key", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


def placed(docs: DataFrame, row: Column, seed: int) -> DataFrame:
    """key (of the source), at (place by hash), size and ``row`` of each document."""
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    key = F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1"))
    return docs.select(key.alias("key"), F.xxhash64(*hashed, F.lit(seed)).alias("at"), word_count(F.col("text")).alias("size"), row.alias("row"))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, block: int = 8, shard_words: int = SHARD_WORDS, seed: int = 7) -> DataFrame:
    """``docs`` as ``placed`` gives them with source_size, target and taken."""
    bucket = F.pmod("at", F.lit(BUCKETS)).cast("int")
    by = materialize(docs.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("n")), "mix")
    sources = source_targets(by.groupBy("key").agg(F.sum("n").alias("source_size")), weights, share, limit)
    every = Window.partitionBy("all")
    sources = sources.withColumn("all", F.lit(1)).withColumn("least", F.min(F.when(F.col("target") > 0, F.col("target"))).over(every))
    sources = sources.withColumn("block", F.coalesce(F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("least") / block))), F.lit(block)).cast("long"))
    sources = sources.withColumn("seats", F.round(F.sum("target").over(every) / F.col("block")).cast("long")).withColumn("most", F.ceil(F.col("source_size") * F.lit(float(limit)) / F.col("block")))
    shards = F.least(F.lit(BUCKETS), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("source_size") / shard_words, F.lit(1.0)))))).cast("int")
    sources = materialize(sainte_lague(sources, ["all"], "key", "target", "seats", "most").select("key", "source_size", "target", "block", F.col("quota").alias("blocks"), shards.alias("shards")), "sources")
    parts = by.join(sources, "key").groupBy("key", F.pmod("bucket", F.col("shards")).alias("shard"), "source_size", "target", "block", "blocks").agg(F.sum("n").alias("n"))
    parts = parts.withColumn("words", F.floor(F.col("n") * F.lit(float(limit))).cast("long"))
    parts = parts.withColumn("most", F.ceil(F.col("words") / F.col("block")))
    full = F.col("target") >= F.floor(F.col("source_size") * F.lit(float(limit)))
    parts = parts.withColumn("blocks", F.when(full, F.sum("most").over(Window.partitionBy("key"))).otherwise(F.col("blocks")))
    quota = sainte_lague(parts, ["key"], "shard", "n", "blocks", "most")
    words, n = F.least(F.col("quota") * F.col("block"), F.col("words")), F.col("n")
    quota = quota.select(
        "key", "shard", "source_size", "target", "n",
        F.when(n > 0, F.floor(words / n)).otherwise(0).cast("long").alias("rounds"),
        F.when(n > 0, words % n).otherwise(0).alias("rest"),
        F.when(n > 0, F.pmod(F.xxhash64("key", "shard", F.lit(seed)), F.ceil(n / F.col("block"))) * F.col("block")).otherwise(0).alias("from"),
    )
    quota = materialize(quota, "quota")
    df = docs.join(sources.select("key", "shards"), "key").withColumn("shard", F.pmod("at", F.col("shards").cast("long")).cast("int"))
    lay = Window.partitionBy("key", "shard").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("a", F.coalesce(F.sum("size").over(lay), F.lit(0))).join(quota, ["key", "shard"])
    b, over = F.col("a") + F.col("size"), F.col("from") + F.col("rest") - F.col("n")

    def shared(lo: Column, hi: Column) -> Column:
        return F.greatest(F.least(b, hi) - F.greatest(F.col("a"), lo), F.lit(0))

    run = shared(F.col("from"), F.least(F.col("from") + F.col("rest"), F.col("n"))) + shared(F.lit(0), over)
    return df.select("row", "size", "source_size", "target", (F.col("rounds") * F.col("size") + run).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """One row for each document and what the mix takes of it."""
    sized = materialize(placed(docs.select("doc_id", "source", "text"), F.col("doc_id"), seed), "sizes")
    return mix(sized, seed=seed, **options).withColumnRenamed("row", "doc_id")


def mixed_copies(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, rounded to whole documents (at most twice
    under the default limit); same columns."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    out = mix(placed(docs, whole, seed), seed=seed, **options)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    return out.select("row", F.explode(F.array_repeat(F.lit(1), times)).alias("copy")).select("row.*")
