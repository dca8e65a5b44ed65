"""Predictions against truth: field, number, table and document scores, and what goes wrong.

``pairs`` joins by sample id (full join, so that unmatched samples are reported rather than shifted).
Text is compared as stated by a profile; a wrong answer never counts as right because both sides are
empty, unless the profile says that missing on both sides is agreement.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXTS, NUMBERS = ("vendor", "currency", "date"), ("total",)


def pairs(truth: DataFrame, predicted: DataFrame, key: str = "invoice_id") -> DataFrame:
    """Columns t_* and p_* of each sample; ``matched`` where both sides have it."""
    t = truth.select(key, *(F.col(c).alias(f"t_{c}") for c in truth.columns if c != key), F.lit(True).alias("__t"))
    p = predicted.select(key, *(F.col(c).alias(f"p_{c}") for c in predicted.columns if c != key), F.lit(True).alias("__p"))
    return t.join(p, key, "full").withColumn("matched", F.col("__t").isNotNull() & F.col("__p").isNotNull()).drop("__t", "__p")


@dataclass(frozen=True)
class FieldRule:
    """text: equal, folded (case and outer space aside), contains (either way), inside (truth in prediction),
    tokens (share of truth's words found over .7). number: limit of a difference, which must stay below it (``at_most``: may reach it), ``relative`` to truth or not.
    missing: whether both missing is agreement. every: whether fields without truth count too."""

    text: str = "equal"
    number: float = 0.01
    relative: bool = False
    at_most: bool = False
    missing: bool = False
    every: bool = True


#: Fixed values of the published measures.
FIELD_RULES = {
    "truth_keys": FieldRule("folded", 1e-4, relative=True, every=False),
    "contains": FieldRule("contains", 0.01, at_most=True),
    "blocks": FieldRule("folded", 0.01),
    "regions": FieldRule("tokens", 0.01),
    "three_fields": FieldRule("equal", 0.01, at_most=True),
    "paths_exact": FieldRule("folded", 0.0, at_most=True, missing=True),
    "paths_string": FieldRule("folded", 0.0, at_most=True, missing=True),
    "four_fields": FieldRule("equal", 0.01, relative=True),
    "contained_in": FieldRule("inside", 0.01),
}


def text_match(t: Column, p: Column, how: str) -> Column:
    tl, pl = F.lower(F.trim(t)), F.lower(F.trim(p))
    if how == "equal":
        return t == p
    if how == "folded":
        return tl == pl
    if how == "contains":
        return (F.length(pl) > 0) & (F.length(tl) > 0) & (F.contains(tl, pl) | F.contains(pl, tl))
    if how == "inside":
        return (F.length(tl) > 0) & F.contains(pl, tl)
    words = F.array_distinct(F.split(tl, " "))
    return F.size(F.array_intersect(words, F.split(pl, " "))) / F.size(words) > 0.7


def number_match(t: Column, p: Column, rule: FieldRule) -> Column:
    off = F.abs(t - p).cast("decimal(18,2)").cast("double")
    if rule.relative:
        return F.when(t == 0, p == 0).otherwise(off < F.lit(rule.number) * F.abs(t.cast("double")))
    return off <= rule.number if rule.at_most else off < rule.number


def field_matches(df: DataFrame, rule: FieldRule) -> dict[str, Column]:
    """For each field: right, wrong, or null where it does not count."""
    out = {}
    for c in (*TEXTS, *NUMBERS):
        t, p = F.col(f"t_{c}"), F.col(f"p_{c}")
        right = F.coalesce(number_match(t, p, rule) if c in NUMBERS else text_match(t.cast("string"), p.cast("string"), rule.text), F.lit(False))
        right = F.when(t.isNull() & p.isNull(), F.lit(rule.missing)).otherwise(right)
        out[c] = right if rule.every else F.when(t.isNotNull(), right)
    return out


def field_accuracy(df: DataFrame, profile: str | FieldRule) -> DataFrame:
    """For each pair: each field's match, right, counted and accuracy (0 where nothing counts)."""
    rule = FIELD_RULES[profile] if isinstance(profile, str) else profile
    found = field_matches(df, rule)
    right = sum((F.coalesce(x.cast("int"), F.lit(0)) for x in found.values()), F.lit(0))
    counted = sum((x.isNotNull().cast("int") for x in found.values()), F.lit(0))
    df = df.withColumns({f"{c}_ok": x for c, x in found.items()}).withColumn("right", right).withColumn("counted", counted)
    return df.withColumn("accuracy", F.when(F.col("counted") > 0, F.col("right") / F.col("counted")).otherwise(F.lit(0.0)))


def compare_models(df: DataFrame, profile: str | FieldRule, *keep: str) -> DataFrame:
    """(keep, base, tuned, gain, status): accuracy of two predictions (b_*, p_*) of each truth (t_*), in one pass.
    status: completed where the tuned one is right in all, failed where in nothing, else partial."""
    tuned = field_accuracy(df, profile).withColumn("tuned", F.col("accuracy"))
    base = field_accuracy(tuned.withColumns({f"p_{c[2:]}": F.col(c) for c in df.columns if c.startswith("b_")}), profile).withColumnRenamed("accuracy", "base")
    status = F.when(F.col("tuned") == 1.0, "completed").when(F.col("tuned") > 0, "partial").otherwise("failed")
    return base.select(*keep, "base", "tuned", (F.col("tuned") - F.col("base")).alias("gain"), status.alias("status"))


def field_f1(df: DataFrame) -> DataFrame:
    """tp, fp, fn and f1 of each pair: a wrong value is a miss, a value without truth a false alarm."""
    found = field_matches(df, FieldRule("folded", 1e-4, relative=True))
    one = lambda x: F.when(x, 1).otherwise(0)
    tp = sum((one(F.col(f"t_{c}").isNotNull() & x) for c, x in found.items()), F.lit(0))
    fn = sum((one(F.col(f"t_{c}").isNotNull() & ~x) for c, x in found.items()), F.lit(0))
    fp = sum((one(F.col(f"t_{c}").isNull() & F.col(f"p_{c}").isNotNull()) for c in found), F.lit(0))
    df = df.withColumns({"tp": tp, "fp": fp, "fn": fn})
    return df.withColumn("f1", F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(F.lit(0.0)))


def aligned_items(truth: DataFrame, predicted: DataFrame, key: str = "invoice_id") -> DataFrame:
    """Lines of both sides by (sample, pos); the side that lacks a position is null."""
    t = truth.select(key, "pos", *(F.col(c).alias(f"t_{c}") for c in ("description", "qty", "line_total")))
    p = predicted.select(key, "pos", *(F.col(c).alias(f"p_{c}") for c in ("description", "qty", "line_total")))
    return t.join(p, [key, "pos"], "full")


def jaccard(a: Column, b: Column) -> Column:
    a, b = F.array_distinct(F.split(F.lower(a), " ")), F.array_distinct(F.split(F.lower(b), " "))
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def table_counts(truth: DataFrame, predicted: DataFrame, key: str = "invoice_id") -> DataFrame:
    """For each sample: rows of both sides and what agrees in the rows that both have."""
    both = F.col("t_qty").isNotNull() & F.col("p_qty").isNotNull()
    eq = lambda c: F.count_if(both & (F.col(f"t_{c}") == F.col(f"p_{c}")))
    return (
        aligned_items(truth, predicted, key)
        .groupBy(key)
        .agg(
            F.count("t_qty").alias("truth_rows"), F.count("p_qty").alias("predicted_rows"), F.count_if(both).alias("rows"), eq("description").alias("same_description"), eq("qty").alias("same_qty"), eq("line_total").alias("same_total"),
            F.count_if(both & (jaccard(F.col("t_description"), F.col("p_description")) > 0.7)).alias("like_description"),
        )
    )


def table_score(counts: DataFrame, profile: str) -> DataFrame:
    """``score`` of a table structure under one of five published formulas over counts (a sixth: ``markup_score``)."""
    t, p = F.col("truth_rows"), F.col("predicted_rows")
    most = F.greatest(t, p)
    ratio = F.when(most > 0, F.least(t, p) / most).otherwise(F.lit(1.0))
    same = (t == p).cast("double")
    cells = F.col("same_description") + F.col("same_qty") + F.col("same_total")
    cell = F.when(t > 0, cells / (3 * t)).otherwise(F.lit(0.0))
    like = F.when(F.col("rows") > 0, (F.col("like_description") + F.col("same_qty") + F.col("same_total")) / (3 * F.col("rows"))).otherwise(F.lit(0.0))
    columns = F.when(p > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    score = {
        "halves": same * 0.5 + columns * 0.5,
        "row_cell": same * 0.3 + cell * 0.7,
        "three_parts": ratio * 0.4 + columns * 0.3 + like * 0.3,
        "ratios": (ratio + columns) / 2,
        "items": F.when(t > 0, F.greatest(F.lit(0.0), 1 - F.abs(t - p) / t)).otherwise((p == 0).cast("double")),
    }[profile]
    return counts.withColumn("score", score)


def markup_score(truth: Column, predicted: Column) -> Column:
    """Likeness of two HTML tables by their rows and the cells of their first rows: 1 where both agree (two empty
    ones too), less for rows or cells that are missing and for those too many, below 0 for many too many."""
    rows = lambda x: F.regexp_count(F.coalesce(x, F.lit("")), F.lit("<tr"))
    cells = lambda x: F.regexp_count(F.regexp_extract(F.coalesce(x, F.lit("")), "(?s)<tr[^>]*>(.*?)</tr>", 1), F.lit("<t[dh]"))
    like = lambda f: 1 - F.abs(f(predicted) - f(truth)) / F.greatest(f(truth), F.lit(1))
    return (like(rows) + like(cells)) / 2


def numeric_accuracy(truth: DataFrame, predicted: DataFrame, unmatched: bool, key: str = "invoice_id") -> DataFrame:
    """right, counted and accuracy of quantities and line totals; truth lines without a partner count as
    wrong with ``unmatched`` and not at all otherwise."""
    rows = aligned_items(truth, predicted, key).where(F.col("t_qty").isNotNull())
    rows = rows if unmatched else rows.where(F.col("p_qty").isNotNull())
    near = lambda c: F.count_if(F.abs(F.col(f"t_{c}") - F.col(f"p_{c}")).cast("double") <= 0.01)
    out = rows.groupBy(key).agg((near("qty") + near("line_total")).alias("right"), (2 * F.count("*")).alias("counted"))
    return out.withColumn("accuracy", F.col("right") / F.col("counted"))


#: Weights of the overall scores: field, number, table, validity.
OVERALL = {"even": (0.3, 0.3, 0.2, 0.2), "field": (0.5, 0.3, 0.2, 0.0)}


def document_scores(fields: DataFrame, numbers: DataFrame, tables: DataFrame, weights: str = "even", key: str = "invoice_id") -> DataFrame:
    """field, number, table, valid and overall of each sample; a sample without lines scores 1 on them."""
    a, b, c, d = OVERALL[weights]
    df = fields.select(key, F.col("accuracy").alias("field"), F.col("total_ok").cast("double").alias("valid"))
    df = df.join(numbers.select(key, F.col("accuracy").alias("number")), key, "left").join(tables.select(key, F.col("score").alias("table")), key, "left")
    df = df.withColumns({"number": F.coalesce("number", F.lit(1.0)), "table": F.coalesce("table", F.lit(1.0))})
    return df.withColumn("overall", F.col("field") * a + F.col("number") * b + F.col("table") * c + F.col("valid") * d)


def row_scores(df: DataFrame, weights: str = "even") -> DataFrame:
    """``document_scores`` of rows that hold their lines (t_items, p_items: arrays of qty and line_total) beside the fields
    (t_*, p_*): nothing is aligned by a join. Line totals are best decimals: as doubles, 57095.30 is more than a cent from 57095.29."""
    a, b, c, d = OVERALL[weights]
    size = lambda x: F.coalesce(F.size(x), F.lit(0))
    n, m = F.greatest(size("t_items"), F.lit(0)), F.greatest(size("p_items"), F.lit(0))
    near = lambda x, y: (F.abs(x - y).cast("double") <= 0.01).cast("int")
    both = F.least(n, m)
    hits = F.zip_with(F.slice("t_items", 1, both), F.slice("p_items", 1, both), lambda t, p: near(t["qty"], p["qty"]) + near(t["line_total"], p["line_total"]))
    right = F.aggregate(hits, F.lit(0), lambda s, x: s + x)
    df = field_accuracy(df, "blocks").withColumns({
        "field": F.col("accuracy"), "valid": F.col("total_ok").cast("double"),
        "number": F.when(n > 0, F.coalesce(right, F.lit(0)) / (2 * n)).otherwise(1.0), "table": F.when(F.greatest(n, m) > 0, F.least(n, m) / F.greatest(n, m)).otherwise(1.0),
    })
    return df.withColumn("overall", F.col("field") * a + F.col("number") * b + F.col("table") * c + F.col("valid") * d)


def summary(df: DataFrame, *columns: str, by: tuple[str, ...] = ()) -> DataFrame:
    """mean, population deviation, least and most of each column."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("decimal(38,12)")
        aggs += [F.avg(F.col(c)).alias(f"{c}_mean"), F.stddev_pop(F.col(c)).alias(f"{c}_std"), F.min(x).cast("double").alias(f"{c}_min"), F.max(x).cast("double").alias(f"{c}_max")]
    return df.groupBy(*by).agg(F.count("*").alias("samples"), *aggs)


def flatten(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, path, value) of every non-null leaf of the named columns; nested structs and arrays of structs
    become ``a.b[0].c``. The walk over the schema is done when the plan is made."""
    from pyspark.sql import types as T

    def leaves(kind: T.DataType, at: Column, path: Column) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [x for f in kind for x in leaves(f.dataType, at[f.name], F.concat(path, F.lit(f".{f.name}")))]
        if isinstance(kind, T.ArrayType):
            inner = F.flatten(F.transform(F.coalesce(at, F.array().cast(kind)), lambda x, i: F.array(*leaves_as(kind.elementType, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))))
            return [inner]
        return [F.array(F.struct(path.alias("path"), at.cast("string").alias("value")))]

    def leaves_as(kind: T.DataType, at: Column, path: Column) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [x for f in kind for x in leaves_as(f.dataType, at[f.name], F.concat(path, F.lit(f".{f.name}")))]
        return [F.struct(path.alias("path"), at.cast("string").alias("value"))]

    every = [x for c in columns for x in leaves(df.schema[c].dataType, F.col(c), F.lit(c))]
    return df.select(key, F.inline(F.concat(*every))).where("value IS NOT NULL")


def path_accuracy(truth: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """right, counted and accuracy over the union of all paths of both sides."""
    t, p = truth.withColumnRenamed("value", "t"), predicted.withColumnRenamed("value", "p")
    out = t.join(p, [key, "path"], "full").agg(F.count_if(F.coalesce(F.col("t") == F.col("p"), F.lit(False))).alias("right"), F.count("*").alias("counted"))
    return out.withColumn("accuracy", F.col("right") / F.col("counted"))
