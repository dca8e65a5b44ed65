"""Confidence of extracted fields: voting between candidates, and what a document adds up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normal_value(value: Column) -> Column:
    """Numbers as doubles in text, anything else trimmed and lower-cased."""
    number = F.regexp_replace(F.trim(value), "[,$]", "").try_cast("double")
    return F.coalesce(number.cast("string"), F.lower(F.trim(value)))


def vote(candidates: DataFrame, *by: str) -> DataFrame:
    """One value for each group of candidates (pos, value, confidence).

    Candidates of one normal form pool their confidence; the largest sum wins, the first seen of equals.
    The result is the sum over the number of all candidates, nulls included, with a bonus of .02 for each
    that agrees (.1 at most) and 1 at most. A single candidate is taken as it is. Sums are exact decimals, so
    neither order nor engine changes a tie."""
    c = candidates.withColumn("__v", normal_value(F.col("value"))).withColumn("__c", F.coalesce("confidence", F.lit(0.5)).cast("decimal(18,6)"))
    forms = c.groupBy(*by, "__v").agg(F.sum("__c").alias("__s"), F.count("*").alias("__k"), F.min("pos").alias("__first"), F.min_by("value", "pos").alias("__value"))
    known = F.when(F.col("__v").isNotNull(), F.struct("__s", (-F.col("__first")).alias("f")))
    forms = forms.groupBy(*by).agg(F.sum("__k").alias("__n"), F.max_by(F.struct("__value", "__s", "__k"), known).alias("__best"))
    n, sums, agreeing = F.col("__n"), F.col("__best.__s").cast("double"), F.col("__best.__k")
    bonus = F.when(agreeing > 1, F.least(F.lit(0.1), agreeing * 0.02)).otherwise(F.lit(0.0))
    score = F.when(sums.isNull(), 0.0).when(n == 1, sums).otherwise(F.least(F.lit(1.0), F.least(F.lit(1.0), sums / n) + bonus))
    return forms.select(*by, F.col("__best.__value").alias("value"), score.alias("confidence"), n.alias("candidates"), F.coalesce(agreeing, F.lit(0)).alias("agreeing"))


TOTAL = r"(?i)(?:total|grand\s+total|amount\s+due|balance\s+due)[\s:]*\$?\s*([\d,]+\.?\d*)"


def vote_total(regions: DataFrame, by: str) -> DataFrame:
    """The total that regions agree on: amounts after a total keyword, or alone in a region, above 0."""
    keyword, alone = F.regexp_extract("text", TOTAL, 1), F.regexp_extract("text", r"^\$?\s*([\d,]+\.?\d*)\s*$", 1)
    amount = F.regexp_replace(F.when(keyword != "", keyword).otherwise(alone), ",", "").try_cast("double")
    found = regions.withColumn("value", amount).where("value > 0").select(by, F.col("region_id").alias("pos"), F.col("value").cast("decimal(18,2)").cast("string").alias("value"), "confidence")
    return vote(found, by)


def mean_present(parts: list[Column]) -> Column:
    """Mean of the parts that are there, 0 without any."""
    there = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return F.when(there > 0, sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)) / there).otherwise(F.lit(0.0))


def document_confidence(df: DataFrame) -> DataFrame:
    """Weighted: vendor .1, client .2, lines .4, arithmetic .3.

    lines: .5 and half the share of valid ones, .7 if none is valid, 0 without lines; arithmetic: .9 if right,
    else .5 less the difference over 100 (.4 at most), .1 at least."""
    vendor = F.when(F.col("vendor").isNotNull(), 1.0).otherwise(0.0)
    client = F.when(F.col("invoice_id").isNotNull(), 0.3).otherwise(0.0) + F.when(F.col("issue_date").isNotNull(), 0.3).otherwise(0.0) + F.when(F.col("client").isNotNull(), 0.2).otherwise(0.0)
    lines = F.when(F.col("n_items") == 0, 0.0).when(F.col("valid_items") == 0, 0.7).otherwise(F.col("valid_items") / F.col("n_items") * 0.5 + 0.5)
    difference = F.coalesce(F.col("total_diff").cast("double"), F.lit(0.0))
    sums = F.when(F.col("total_ok"), 0.9).otherwise(F.greatest(F.lit(0.1), F.lit(0.5) - F.least(difference / 100, F.lit(0.4))))
    return df.withColumn("document_confidence", vendor * 0.1 + client * 0.2 + lines * 0.4 + sums * 0.3)


def field_confidence(value: Column, base: float = 0.7) -> Column:
    """0 for a missing value, .3 for an empty or zero one, else the base and .2, 1 at most."""
    text = value.cast("string")
    return F.when(value.isNull(), 0.0).when(text.isin("", "0", "0.0", "0.00"), 0.3).otherwise(round(min(base + 0.2, 1.0), 6))


#: Confidence that the presence of a part gives; fixed values.
PRESENCE = {"invoice_number": 0.9, "date": 0.85, "total": 0.95, "vendor": 0.8, "line_items": 0.7}


def presence_confidence(df: DataFrame, present: dict[str, Column]) -> DataFrame:
    """``overall``: mean of the fixed confidences of the parts that are present."""
    return df.withColumn("overall", mean_present([F.when(present[k], F.lit(v)) for k, v in PRESENCE.items() if k in present]))


def calibration(df: DataFrame) -> DataFrame:
    """Share and accuracy of the confidence bands 95-100, 90-95, 80-90 and below."""
    band = F.when(F.col("confidence") >= 0.95, "95-100").when(F.col("confidence") >= 0.90, "90-95").when(F.col("confidence") >= 0.80, "80-90").otherwise("<80")
    out = df.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.count_if("correct").alias("right"))
    every = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return out.select("band", "n", (F.col("n") / every).alias("share"), (F.col("right") / F.col("n")).alias("accuracy"))
