"""Usage, limits, charges and revenue. Prices, limits and rates are always small input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

D = "decimal(18,2)"


def monthly_usage(usage: DataFrame) -> DataFrame:
    return usage.groupBy("tenant", "month", "resource").agg(F.sum("quantity").cast("double").alias("quantity"))


def usage_report(usage: DataFrame, first: str, last: str) -> DataFrame:
    """Sums by resource, month and day with subtotals (null day, null month), months from first to last."""
    inside = usage.where(F.col("month").between(first, last)).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    sums = inside.rollup("resource", "month", "day").agg(F.sum("quantity").cast("double").alias("quantity"), F.count("*").alias("events"))
    return sums.where("resource IS NOT NULL")


def with_limits(usage: DataFrame, plans: DataFrame) -> DataFrame:
    """Usage beside its limit and rate; a resource without a limit has neither."""
    return usage.join(plans, "resource", "left")


def overage(usage: DataFrame, plans: DataFrame) -> DataFrame:
    """over = usage beyond a positive limit; charge = over x rate, in money."""
    df = with_limits(usage, plans)
    over = F.when(F.col("limit") > 0, F.greatest(F.col("quantity").cast(D) - F.col("limit").cast(D), F.lit(0).cast(D))).otherwise(F.lit(0).cast(D))
    return df.withColumn("over", over.cast("double")).withColumn("charge", F.round(over * F.col("rate").cast("decimal(8,4)"), 2).cast("double"))


def quota(df: DataFrame, alert: float = 80) -> DataFrame:
    """has_quota, remaining, percent and alert of quantity against limit; no limit is unlimited."""
    percent = F.when(F.col("limit") > 0, F.col("quantity") / F.col("limit") * 100)
    return df.withColumns({
        "has_quota": F.coalesce(F.col("quantity") < F.col("limit"), F.lit(True)), "remaining": F.greatest(F.col("limit") - F.col("quantity"), F.lit(0.0)), "percent": percent, "alert": F.coalesce(percent >= alert, F.lit(False)),
    })


def rate_limit(df: DataFrame, limit: int, *by: str) -> DataFrame:
    """n-th call within its hour, whether it is allowed, what remains and when the hour ends."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    order = Window.partitionBy(*by, "__hour").orderBy("ts", "event_id")
    df = df.withColumn("__hour", hour).withColumn("nth", F.row_number().over(order))
    reset = F.date_format(F.col("__hour") + F.expr("interval 1 hour"), "yyyy-MM-dd HH:mm:ss")
    return df.withColumns({"allowed": F.col("nth") <= limit, "remaining": F.greatest(F.lit(limit) - F.col("nth"), F.lit(0)), "reset_at": reset}).drop("__hour")


def api_usage(df: DataFrame) -> DataFrame:
    """Calls by tenant, month and endpoint, with a total row for each tenant and month."""
    out = df.rollup("tenant", "month", "endpoint").agg(F.count("*").alias("calls"), F.grouping("month").alias("__g"), F.grouping("endpoint").alias("__e"))
    return out.where("__g = 0").select("tenant", "month", F.when(F.col("__e") == 1, "total").otherwise(F.col("endpoint")).alias("endpoint"), "calls")


def subscription_price(df: DataFrame, tiers: DataFrame, promotions: DataFrame, as_of: str, tax: str = "0.10") -> DataFrame:
    """Price of subscriptions (tier, cycle, addons as money a month, promo): add-ons count twelvefold a year,
    a promotion needs its least tier rank and its date; tax on what is left."""
    df = df.join(tiers, "tier").join(promotions, "promo", "left")
    yearly = F.col("cycle") == "annual"
    subtotal = (F.when(yearly, F.col("annual")).otherwise(F.col("monthly")) + F.col("addons") * F.when(yearly, 12).otherwise(1)).cast(D)
    valid = F.coalesce((F.col("rank") >= F.coalesce("min_rank", F.lit(0))) & (F.lit(as_of).cast("date") <= F.col("valid_until")), F.lit(False))
    discount = F.when(~valid, F.lit(0)).when(F.col("kind") == "percentage", F.round(subtotal * F.col("amount") / 100, 2)).otherwise(F.col("amount")).cast(D)
    taxes = F.round((subtotal - discount) * F.lit(tax).cast("decimal(4,2)"), 2).cast(D)
    return df.withColumns({"subtotal": subtotal, "discount": discount, "tax": taxes, "total": (subtotal - discount + taxes).cast(D)})


def entitled(df: DataFrame, features: DataFrame) -> DataFrame:
    """Subscriptions whose tier has the feature they ask for; ``features``: one row (tier, feature list)."""
    rows = features.select("tier", F.explode("features").alias("feature"))
    return df.join(rows, ["tier", "feature"], "left_semi")


def upgrades(tiers: DataFrame) -> DataFrame:
    """(tier, next): every tier of higher rank; of a fixed handful of tiers."""
    a, b = tiers.select("tier", "rank"), tiers.select(F.col("tier").alias("next"), F.col("rank").alias("next_rank"))
    return a.join(b, F.col("next_rank") > F.col("rank")).select("tier", "next")


def revenue_summary(invoices: DataFrame, partners: DataFrame) -> DataFrame:
    """month, revenue, overage and partner payouts (revenue x share of the partner named by the client)."""
    month = F.date_format("issue_date", "yyyy-MM")
    share = F.coalesce(F.col("revenue_share"), F.lit(0).cast("decimal(5,4)"))
    payout = F.round(F.col("grand_total") * share, 2).cast(D)
    joined = invoices.withColumn("code", F.lower("nation")).join(partners.withColumn("code", F.lower("code")), "code", "left")
    return joined.groupBy(month.alias("month")).agg(F.count("*").alias("invoices"), F.sum("grand_total").cast("double").alias("revenue"), F.sum(payout).cast("double").alias("payout"), F.count("revenue_share").alias("referred"))


def cohorts(invoices: DataFrame) -> DataFrame:
    """Of each month: active, new and lost clients (last seen the month before), revenue and revenue a client."""
    m = F.trunc("issue_date", "month")
    own = invoices.groupBy("client_id").agg(F.min(m).alias("first"), F.add_months(F.max(m), 1).alias("after"))
    active = invoices.groupBy(m.alias("month")).agg(F.countDistinct("client_id").alias("active"), F.sum("grand_total").cast("double").alias("revenue"))
    new, lost = own.groupBy(F.col("first").alias("month")).agg(F.count("*").alias("joined")), own.groupBy(F.col("after").alias("month")).agg(F.count("*").alias("lost"))
    out = active.join(new, "month", "left").join(lost, "month", "left")
    return out.select(F.date_format("month", "yyyy-MM").alias("month"), "active", F.coalesce("joined", F.lit(0)).alias("joined"), F.coalesce("lost", F.lit(0)).alias("lost"), "revenue", (F.col("revenue") / F.col("active")).alias("arpu"))


def lifetime_value(df: DataFrame, margin: float = 0.8) -> DataFrame:
    """ltv = arpu x margin / churn, its share that may be spent on winning a client; null without churn."""
    churn = F.when(F.col("active") > 0, F.col("lost") / F.col("active"))
    ltv = F.when(churn > 0, F.col("arpu") * margin / churn)
    return df.withColumns({"churn": churn, "ltv": ltv, "max_cac": ltv / 3})


def break_even(monthly: DataFrame, investment: float) -> DataFrame:
    """The first month in which cumulated profit covers the investment; of one row a month."""
    upto = F.sum(F.col("profit").cast(D)).over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0))
    return monthly.withColumn("cumulated", upto.cast("double")).where(F.col("cumulated") >= investment).agg(F.min("month").alias("month"))


def convert(df: DataFrame, rates: DataFrame) -> DataFrame:
    """Amounts by a rate table; a missing rate is 1. The rate is kept to 4 places, the amount to 2."""
    df = df.join(rates, "currency", "left")
    rate = F.coalesce(F.round("rate", 4), F.lit(1)).cast("decimal(12,4)")
    return df.withColumn("rate", rate).withColumn("converted", F.round(F.col("amount") * rate, 2).cast(D))


def multi_currency(df: DataFrame, key: str) -> DataFrame:
    """Distinct currencies of each key and whether there are several."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set("currency")).alias("currencies")).withColumn("is_multi", F.size("currencies") > 1)


def changes(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each row with the value before it and the kind of change: new, same or changed."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy("issue_date", "invoice_id"))
    return df.withColumn("previous", before).withColumn("change", F.when(F.col("previous").isNull(), "new").when(F.col("previous") == F.col(value), "same").otherwise("changed"))


def roi(minutes: Column, rate: float, automated: Column) -> dict[str, Column]:
    """manual cost, saving, percent and a fee of 3 % of the saving."""
    manual = minutes / 60 * rate
    saving = manual - automated
    return {"manual": manual, "saving": saving, "percent": F.when(automated > 0, saving / automated * 100), "fee": saving * 0.03}
