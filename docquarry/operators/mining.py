"""Errors of predictions: one row for each, their kinds, and what to train on next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severity of each kind of document error; fixed values.
SEVERITY = {"TOTAL_MISMATCH": 5, "TABLE_STRUCTURE_ERROR": 4, "CURRENCY_ERROR": 3, "DATE_ERROR": 2, "VENDOR_INFO_ERROR": 2, "OTHER": 1}


def letter_likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of letters, case aside."""
    a, b = F.array_distinct(F.split(F.lower(a), "")), F.array_distinct(F.split(F.lower(b), ""))
    a, b = F.array_remove(a, ""), F.array_remove(b, "")
    return F.when(F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def number_likeness(t: Column, p: Column) -> Column:
    """1 - |difference| / max(|truth|, 1), at least 0."""
    t, p = t.cast("double"), p.cast("double")
    return F.lit(1.0) - F.least(F.abs(p - t) / F.greatest(F.abs(t), F.lit(1.0)), F.lit(1.0))


#: Errors that a roll-up gives in full.
DETAILS = 100


def error_rollup(errors: DataFrame, details: int = DETAILS, key: str = "invoice_id") -> DataFrame:
    """(level, name, n, low, examples): errors in all, by kind, by element and by sample, from one aggregation; low:
    confidence under .5. Level ``all`` has the first ``details`` errors in the order of samples and lines, the others
    none: a top-k that each task keeps within that bound. ``errors`` is read twice: hand over a written table."""
    sets = errors.groupingSets([[], ["error"], ["element"], [key]], "error", "element", key).agg(F.count("*").alias("n"), F.count_if(F.col("confidence") < 0.5).alias("low"), F.grouping_id().alias("__g"))
    level = F.when(F.col("__g") == 7, "all").when(F.col("__g") == 3, "error").when(F.col("__g") == 5, "element").otherwise("sample")
    name = F.coalesce("error", "element", F.col(key).cast("string"), F.lit(""))
    row = F.struct(key, "item_pos", "element", "error", "confidence")
    first = errors.select(row.alias("e")).orderBy("e").limit(details).agg(F.sort_array(F.collect_list("e")).alias("examples"))
    found = sets.select(level.alias("level"), name.alias("name"), "n", "low")
    return found.join(first.withColumn("level", F.lit("all")), "level", "left")


def hard_samples(errors: DataFrame, least: int = 3) -> DataFrame:
    """Samples with that many errors, those of their lines included."""
    return errors.groupBy("invoice_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def classify_errors(df: DataFrame) -> DataFrame:
    """``error_class`` and ``severity`` of each pair: the first kind that applies; t_*/p_* of total, rows,
    currency, date and vendor."""
    total = F.abs(F.coalesce("p_total", F.lit(0)) - F.coalesce("t_total", F.lit(0))).cast("double") > 0.02 * F.greatest(F.abs(F.coalesce("t_total", F.lit(0))).cast("double"), F.lit(1.0))
    differ = lambda c: (F.col(f"p_{c}") != "") & (F.col(f"t_{c}") != "") & (F.lower(f"p_{c}") != F.lower(f"t_{c}"))
    kind = (
        F.when(total, "TOTAL_MISMATCH").when(F.coalesce("p_rows", F.lit(0)) != F.coalesce("t_rows", F.lit(0)), "TABLE_STRUCTURE_ERROR").when(differ("currency"), "CURRENCY_ERROR")
        .when(F.col("p_date") != F.col("t_date"), "DATE_ERROR").when(differ("vendor"), "VENDOR_INFO_ERROR").otherwise("OTHER")
    )
    severity = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    return df.withColumn("error_class", kind).withColumn("severity", severity[F.col("error_class")])


def synthesis_plan(errors: DataFrame, top: int = 5) -> DataFrame:
    """What to synthesise for the most frequent wrong elements: kind and number of samples."""
    kind = F.when(F.contains("element", F.lit("line_items")), "complex_table").when(F.contains("element", F.lit("currency")), "multi_currency").otherwise("unusual_layout")
    most = errors.groupBy("element").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "element").limit(top)
    return most.select("element", "n", kind.alias("kind"), F.least(F.col("n") * 10, F.lit(100)).alias("samples"))


def correction_type(df: DataFrame, before: str, after: str, arithmetic: Column) -> DataFrame:
    """kind and difficulty of a correction of one field."""
    kind = F.when(arithmetic, "arithmetic").when(F.col(before).isNull() & F.col(after).isNotNull(), "field_missing").when(~F.col(before).eqNullSafe(F.col(after)), "field_incorrect").otherwise("other")
    level = F.when(F.col("kind") == "arithmetic", "hard").when(F.col("kind") == "field_incorrect", "easy").otherwise("medium")
    return df.withColumn("kind", kind).withColumn("difficulty", level)


def low_confidence(samples: DataFrame, limit: float) -> DataFrame:
    """Samples whose mean region confidence (0 without regions) is under the limit."""
    return samples.withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).where(F.col("confidence") < limit)
