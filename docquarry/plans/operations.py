"""Queries: pipeline metrics, usage and billing."""

from pyspark.sql import functions as F

from docquarry.operators import billing as B
from docquarry.operators import metrics as X
from docquarry.operators import validate as V
from docquarry.plans import views as W
from docquarry.registry import query

AS_OF = "2024-01-20 00:00:00"
MS = "cast(sum(cast(ms as decimal(18,2))) as double) / count(*)"
SUMMARY = f"""count(*) total, count(*) filter (success) successful, count(*) filter (not success) failed, cast(count(*) filter (success) as double) / count(*) success_rate, {MS} avg_ms,
 case when count(validation_passed) > 0 then cast(count(*) filter (validation_passed) as double) / count(validation_passed) end validation_rate, cast(sum(case when confidence > 0 then round(confidence * 100) end) as double) / 100 / greatest(1, count(*) filter (confidence > 0)) avg_confidence, cast(sum(field_count) as double) / count(*) avg_fields"""


@query("a1_pipeline_summary", f"select {SUMMARY} from pipeline_metrics where ts >= timestamp '{AS_OF}' - interval 1440 minutes")
def _(spark, d):
    return X.summary(X.trailing(W.pipeline_metrics(spark, d), AS_OF, 1440))


@query("a1_stage_summary", f"select stage, count(*) n, {MS} avg_ms from pipeline_metrics where ts >= timestamp '{AS_OF}' - interval 1440 minutes group by 1")
def _(spark, d):
    return X.stage_summary(X.trailing(W.pipeline_metrics(spark, d), AS_OF, 1440))


@query("a2_quality", """with m as (select * from pipeline_metrics order by ts desc, document_id desc limit 1000)
select count(*) samples, cast(sum(field_count) as double) / count(*) filter (field_count > 0) avg_fields, cast(sum(case when confidence > 0 then round(confidence * 100) end) as double) / 100 / count(*) filter (confidence > 0) avg_confidence,
 cast(count(*) filter (validation_passed) as double) / count(validation_passed) validation_rate, cast(count(*) filter (confidence >= 0.8) as double) / count(*) filter (confidence > 0) high_confidence_rate from m""")
def _(spark, d):
    return X.quality(X.last_rows(W.pipeline_metrics(spark, d), 1000))


PLACES = """select {0} any_value(n) n, any_value(mean) mean, min(ms) least, max(ms) most, min(ms) filter (rn = least(floor(n * 50 / 100) + 1, n)) p50, min(ms) filter (rn = least(floor(n * 95 / 100) + 1, n)) p95, min(ms) filter (rn = least(floor(n * 99 / 100) + 1, n)) p99
from (select *, row_number() over ({1} order by ms) rn, count(*) over ({1}) n, cast(sum(cast(ms as decimal(18,2))) over ({1}) as double) / count(*) over ({1}) mean from pipeline_metrics) {2}"""


@query("a3_performance", PLACES.format("", "", ""))
def _(spark, d):
    return X.percentiles(W.pipeline_metrics(spark, d), "ms")


@query("a3_performance_by_stage", PLACES.format("stage,", "partition by stage", "group by stage"))
def _(spark, d):
    return X.percentiles(W.pipeline_metrics(spark, d), "ms", by=("stage",))


@query("a4_error_breakdown", "select error_type, count(*) n from pipeline_metrics where not success group by 1")
def _(spark, d):
    return X.error_breakdown(W.pipeline_metrics(spark, d))


@query("a5_counters", "select stage, success, cast(ms > 10 as int) + cast(ms > 50 as int) + cast(ms > 100 as int) + cast(ms > 250 as int) bucket, count(*) n from pipeline_metrics group by 1, 2, 3")
def _(spark, d):
    return X.counters(W.pipeline_metrics(spark, d))


OK = "coalesce(abs(items_total - subtotal) <= 0.01, true) and coalesce(abs(total - (coalesce(subtotal, 0) + coalesce(tax, 0) - coalesce(discount, 0))) <= 0.01, true)"


@query("a6_batch_metrics", f"""select count(*) documents, count(*) filter (ok) passed, cast(count(*) filter (ok) as double) / count(*) pass_rate, sum(round(confidence * 100)) / 100 / count(confidence) avg_confidence, min(round(confidence * 100)) / 100 min_confidence, max(round(confidence * 100)) / 100 max_confidence,
 cast(sum(total) as double) total_value, arg_max(currency, invoice_id) currency from (select *, {OK} ok from declared)""")
def _(spark, d):
    return X.batch_metrics(V.validate_arithmetic(W.declared(spark, d)))


@query("a6_error_types", """select error, count(*) n from (select 'SUBTOTAL_MISMATCH' error from declared where abs(items_total - subtotal) > 0.01 union all select 'TOTAL_MISMATCH' from declared where abs(total - (coalesce(subtotal, 0) + coalesce(tax, 0) - coalesce(discount, 0))) > 0.01) group by 1""")
def _(spark, d):
    df = V.validate_arithmetic(W.declared(spark, d)).withColumn("errors", F.transform("issues", lambda x: F.concat(x["code"], F.lit(": off by "), x["difference"].cast("string"))))
    return X.error_types(df)


def stage_means(df):
    return X.stage_summary(df).select(F.col("stage").alias("metric"), F.col("avg_ms").alias("value"))


COMPARED = f"""with b as (select stage, {MS} v from pipeline_metrics where ts < timestamp '2024-01-15' group by 1), a as (select stage, {MS} v from pipeline_metrics where ts >= timestamp '2024-01-15' and stage <> 'view' group by 1)
select coalesce(a.stage, b.stage) metric, b.v before, a.v as after, a.v - b.v change, case when b.v > 0 then (a.v - b.v) / b.v * 100 else 0.0 end percent from b full join a on a.stage = b.stage"""
for _name in ("a7_before_after", "a33_run_comparison"):

    @query(_name, COMPARED)
    def _(spark, d):
        m = W.pipeline_metrics(spark, d)
        cut = F.lit("2024-01-15").cast("timestamp_ntz")
        return X.compare(stage_means(m.where(F.col("ts") < cut)), stage_means(m.where((F.col("ts") >= cut) & (F.col("stage") != "view"))))


@query("a21_monthly_usage", "select tenant, month, resource, cast(sum(quantity) as double) quantity from usage group by 1, 2, 3")
def _(spark, d):
    return B.monthly_usage(W.usage(spark, d))


@query("a22_usage_report", "select resource, month, day, cast(sum(quantity) as double) quantity, count(*) events from (select *, strftime(ts, '%Y-%m-%d') as day from usage where month between '2024-01' and '2024-02') group by rollup (resource, month, day) having resource is not null")
def _(spark, d):
    return B.usage_report(W.usage(spark, d), "2024-01", "2024-02")


@query("a23_tenant_dashboard", """select tenant, count(*) filter (resource = 'documents') documents, greatest(20 - count(*) filter (resource = 'documents'), 0) remaining, cast(sum(quantity) filter (resource = 'storage_gb') as double) storage, count(*) filter (resource = 'api_requests') api_calls, count(distinct strftime(ts, '%Y-%m-%d')) active_days from usage group by 1""")
def _(spark, d):
    u = W.usage(spark, d)
    of = lambda r: F.count_if(F.col("resource") == r)
    return u.groupBy("tenant").agg(
        of("documents").alias("documents"), F.greatest(F.lit(20) - of("documents"), F.lit(0)).alias("remaining"), F.sum(F.when(F.col("resource") == "storage_gb", F.col("quantity"))).cast("double").alias("storage"), of("api_requests").alias("api_calls"), F.countDistinct(F.date_format("ts", "yyyy-MM-dd")).alias("active_days"),
    )


def partners(spark):
    return spark.createDataFrame([("Nation_1", "0.1500"), ("NATION_3", "0.2000")], "code string, share string").select("code", F.col("share").cast("decimal(5,4)").alias("revenue_share"))


@query("a24_revenue_summary", """with p as (select * from (values ('nation_1', cast(0.15 as decimal(5,4))), ('nation_3', cast(0.2 as decimal(5,4)))) t(code, revenue_share))
select strftime(issue_date, '%Y-%m') as month, count(*) invoices, cast(sum(grand_total) as double) revenue, cast(sum(cast(round(grand_total * coalesce(revenue_share, 0), 2) as decimal(18,2))) as double) payout, count(revenue_share) referred from invoices left join p on lower(nation) = code group by 1""")
def _(spark, d):
    return B.revenue_summary(W.invoices(spark, d), partners(spark))


@query("j10_partner_referrals", "select nation, cast(share as double) share, count(*) n from invoices join (values ('nation_1', 0.15), ('nation_3', 0.2)) t(code, share) on lower(nation) = code group by 1, 2")
def _(spark, d):
    p = partners(spark).withColumn("code", F.lower("code"))
    return W.invoices(spark, d).join(p, F.lower("nation") == F.col("code")).groupBy("nation", F.col("revenue_share").cast("double").alias("share")).agg(F.count("*").alias("n"))


COHORTS = """own as (select client_id, min(date_trunc('month', issue_date)) first, max(date_trunc('month', issue_date)) + interval 1 month after_ from invoices group by 1),
active as (select date_trunc('month', issue_date) m, count(distinct client_id) active, cast(sum(grand_total) as double) revenue from invoices group by 1),
cohorts as (select strftime(m, '%Y-%m') as month, active, coalesce(j, 0) joined, coalesce(l, 0) lost, revenue, revenue / active arpu from active left join (select first m, count(*) j from own group by 1) using (m) left join (select after_ m, count(*) l from own group by 1) using (m))"""


@query("a25_cohort_revenue", f"with {COHORTS} select * from cohorts")
def _(spark, d):
    return B.cohorts(W.invoices(spark, d))


@query("a25_lifetime_value", f"with {COHORTS} select month, cast(lost as double) / active churn, case when lost > 0 then arpu * 0.8::double / (cast(lost as double) / active) end ltv, case when lost > 0 then arpu * 0.8::double / (cast(lost as double) / active) end / 3 max_cac from cohorts")
def _(spark, d):
    return B.lifetime_value(B.cohorts(W.invoices(spark, d))).select("month", "churn", "ltv", "max_cac")


@query("a26_api_usage", "select tenant, month, coalesce(endpoint, 'total') endpoint, count(*) calls from (select user_id tenant, strftime(ts, '%Y-%m') as month, event_type endpoint from events) group by grouping sets ((tenant, month, endpoint), (tenant, month))")
def _(spark, d):
    e = W.table(spark, d, "events").select(F.col("user_id").alias("tenant"), F.date_format("ts", "yyyy-MM").alias("month"), F.col("event_type").alias("endpoint"))
    return B.api_usage(e)


@query("a26_latency_sample", PLACES.format("tenant,", "partition by tenant", "group by tenant").replace("from pipeline_metrics)", "from (select * from (select *, row_number() over (partition by tenant order by ts desc, document_id desc) r from pipeline_metrics) where r <= 10))"))
def _(spark, d):
    return X.percentiles(X.last_rows(W.pipeline_metrics(spark, d), 10, "tenant"), "ms", by=("tenant",))


@query("a27_multi_currency", "select client_id, array_to_string(list_sort(list_distinct(list(currency))), ',') currencies, count(distinct currency) > 1 is_multi from (select client_id, currency from invoices union all select client_id, 'CHF' from invoices where invoice_id % 50 = 0) group by 1")
def _(spark, d):
    i = W.invoices(spark, d).select("client_id", "currency", "invoice_id")
    both = i.select("client_id", "currency").unionAll(i.where("invoice_id % 50 = 0").select("client_id", F.lit("CHF")))
    return B.multi_currency(both, "client_id").withColumn("currencies", F.array_join("currencies", ","))


@query("a28_queue_stats", "select count(*) n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') oldest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') newest from events where event_type = 'purchase'")
def _(spark, d):
    e = W.table(spark, d, "events").where("event_type = 'purchase'")
    return X.queue_stats(e.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))


@query("a29_pair_inspection", "select role, count(*) n, count(distinct conv_id) conversations, min(length(text)) shortest, max(length(text)) longest from conversations group by 1")
def _(spark, d):
    return W.table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("conversations"), F.min(F.length("text")).alias("shortest"), F.max(F.length("text")).alias("longest"))


@query("a31_batch_result", f"select region, count(*) total, count(*) filter (ok) successful, count(*) filter (not ok) failed from (select *, {OK} ok from declared) group by 1")
def _(spark, d):
    return V.validate_arithmetic(W.declared(spark, d)).groupBy("region").agg(F.count("*").alias("total"), F.count_if("math_ok").alias("successful"), F.count_if(~F.col("math_ok")).alias("failed"))


@query("a32_running_metrics", f"select tenant, count(*) runs, {MS} avg_ms, cast(sum(field_count) as double) / count(*) avg_fields from pipeline_metrics group by 1")
def _(spark, d):
    return W.pipeline_metrics(spark, d).groupBy("tenant").agg(F.count("*").alias("runs"), (X.exact_sum("ms") / F.count("*")).alias("avg_ms"), (F.sum("field_count").cast("double") / F.count("*")).alias("avg_fields"))


@query("w11_stage_durations", "select document_id, tenant, stage, (epoch_us(lead(ts) over (partition by tenant order by ts, document_id)) - epoch_us(ts)) / 1e6::double as seconds from pipeline_metrics")
def _(spark, d):
    return X.stage_durations(W.pipeline_metrics(spark, d)).select("document_id", "tenant", "stage", "seconds")


LEGAL = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "view"), ("click", "click")]


@query("j14_illegal_transitions", "with m as (select document_id, stage, lag(stage) over (partition by tenant order by ts, document_id) previous from pipeline_metrics) select * from m where previous is not null and (previous, stage) not in (('signup', 'view'), ('view', 'click'), ('click', 'purchase'), ('view', 'view'), ('click', 'click'))")
def _(spark, d):
    return X.illegal_transitions(W.pipeline_metrics(spark, d), spark.createDataFrame(LEGAL, "`from` string, `to` string")).select("document_id", "stage", "previous")


@query("w14_latest_per_key", "select tenant, stage, document_id, ms from (select *, row_number() over (partition by tenant, stage order by ts desc, document_id desc) r from pipeline_metrics) where r = 1")
def _(spark, d):
    return X.latest(W.pipeline_metrics(spark, d), "tenant", "stage").select("tenant", "stage", "document_id", "ms")


@query("w16_last_rows_per_key", "select tenant, document_id from (select *, row_number() over (partition by tenant order by ts desc, document_id desc) r from pipeline_metrics) where r <= 5")
def _(spark, d):
    return X.last_rows(W.pipeline_metrics(spark, d), 5, "tenant").select("tenant", "document_id")


@query("w12_rate_limit", "select event_id, cast(n as bigint) nth, n <= 2 allowed, greatest(2 - n, 0) remaining, strftime(date_trunc('hour', ts) + interval 1 hour, '%Y-%m-%d %H:%M:%S') reset_at from (select event_id, ts, row_number() over (partition by event_type, date_trunc('hour', ts) order by ts, event_id) n from events)")
def _(spark, d):
    out = B.rate_limit(W.table(spark, d, "events"), 2, "event_type")
    return out.select("event_id", F.col("nth").cast("long").alias("nth"), "allowed", F.col("remaining").cast("long").alias("remaining"), "reset_at")


@query("w13_break_even", "select min(month) as month from (select month, sum(profit) over (order by month) c from (select strftime(issue_date, '%Y-%m') as month, cast(sum(tax) as decimal(18,2)) profit from invoices group by 1)) where c >= 1000000")
def _(spark, d):
    monthly = W.invoices(spark, d).groupBy(F.date_format("issue_date", "yyyy-MM").alias("month")).agg(F.sum("tax").alias("profit"))
    return B.break_even(monthly, 1_000_000)


PLANS = [("documents", 1000.0, "0.1000"), ("api_requests", 1500.0, "0.0100"), ("storage_gb", 0.0, "0.5000")]
PLANS_SQL = "(select * from (values ('documents', 1000.0::double, cast(0.1 as decimal(8,4))), ('api_requests', 1500.0::double, cast(0.01 as decimal(8,4))), ('storage_gb', 0.0::double, cast(0.5 as decimal(8,4)))) t(resource, lim, rate))"
OVER = f"over_ as (select *, case when lim > 0 then greatest(cast(quantity as decimal(18,2)) - cast(lim as decimal(18,2)), 0) else 0 end as ov from (select tenant, month, resource, cast(sum(quantity) as double) quantity from usage group by 1, 2, 3) left join {PLANS_SQL} using (resource))"


def charged(spark, d):
    plans = spark.createDataFrame(PLANS, "resource string, `limit` double, rate string")
    return B.overage(B.monthly_usage(W.usage(spark, d)), plans)


@query("j9_usage_with_limits", f"with {OVER} select tenant, month, resource, quantity, lim as \"limit\", cast(rate as double) rate from over_")
def _(spark, d):
    return charged(spark, d).select("tenant", "month", "resource", "quantity", "limit", F.col("rate").cast("double").alias("rate"))


@query("f26_overage_charges", f"with {OVER} select tenant, month, resource, cast(ov as double) as over, cast(round(ov * rate, 2) as double) charge from over_".replace(" as over,", ' as "over",'))
def _(spark, d):
    return charged(spark, d).select("tenant", "month", "resource", "over", "charge")


@query("f27_quota", f"with {OVER} select tenant, month, resource, coalesce(quantity < lim, true) has_quota, greatest(lim - quantity, 0.0) remaining, case when lim > 0 then quantity / lim * 100 end percent, coalesce(case when lim > 0 then quantity / lim * 100 end >= 80, false) alert from over_")
def _(spark, d):
    return B.quota(charged(spark, d)).select("tenant", "month", "resource", "has_quota", "remaining", "percent", "alert")


TIERS = [("starter", 0, "49.00", "490.00", ["ocr"]), ("growth", 1, "149.00", "1490.00", ["ocr", "api"]), ("professional", 2, "499.00", "4990.00", ["ocr", "api", "export"]), ("enterprise", 3, "999.00", "9990.00", ["ocr", "api", "export", "sso"])]


def tiers(spark):
    t = spark.createDataFrame(TIERS, "tier string, rank int, monthly string, annual string, features array<string>")
    return t.withColumn("monthly", F.col("monthly").cast("decimal(18,2)")).withColumn("annual", F.col("annual").cast("decimal(18,2)"))


def subscriptions(spark, d):
    c = F.col("c_custkey")
    tier = F.element_at(F.array(*(F.lit(t[0]) for t in TIERS)), (c % 4 + 1).cast("int"))
    promo = F.when(c % 5 == 0, "TENTH").when(c % 5 == 1, "FLAT20").when(c % 5 == 2, "OLD")
    feature = F.element_at(F.array(*map(F.lit, ("ocr", "api", "export", "sso"))), (c % 3 + 2).cast("int"))
    return W.table(spark, d, "customer").select(c, tier.alias("tier"), F.when(c % 2 == 0, "annual").otherwise("monthly").alias("cycle"), (c % 3 * 10).cast("decimal(18,2)").alias("addons"), promo.alias("promo"), feature.alias("feature"))


SUBS = """subs as (select c_custkey, ['starter', 'growth', 'professional', 'enterprise'][c_custkey % 4 + 1] tier, case when c_custkey % 2 = 0 then 'annual' else 'monthly' end as cycle, cast(c_custkey % 3 * 10 as decimal(18,2)) addons,
 case c_custkey % 5 when 0 then 'TENTH' when 1 then 'FLAT20' when 2 then 'OLD' end promo, ['ocr', 'api', 'export', 'sso'][c_custkey % 3 + 2] feature from customer)"""


@query("f25_subscription_price", f"""with {SUBS}, p as (select *, cast(case when cycle = 'annual' then case tier when 'starter' then 490 when 'growth' then 1490 when 'professional' then 4990 else 9990 end + addons * 12 else case tier when 'starter' then 49 when 'growth' then 149 when 'professional' then 499 else 999 end + addons end as decimal(18,2)) subtotal from subs),
 q as (select *, cast(case when promo = 'TENTH' then round(subtotal * 10 / 100.0, 2) when promo = 'FLAT20' and tier in ('professional', 'enterprise') then 20 else 0 end as decimal(18,2)) discount from p), r as (select *, cast(round((subtotal - discount) * 0.10, 2) as decimal(18,2)) tax from q)
select c_custkey, cast(subtotal as double) subtotal, cast(discount as double) discount, cast(tax as double) tax, cast(subtotal - discount + tax as double) total from r""")
def _(spark, d):
    promos = spark.createDataFrame([("TENTH", "percentage", 10, 0, "2030-01-01"), ("FLAT20", "fixed", 20, 2, "2030-01-01"), ("OLD", "percentage", 50, 0, "2020-01-01")], "promo string, kind string, amount int, min_rank int, until string")
    promos = promos.withColumn("valid_until", F.col("until").cast("date"))
    out = B.subscription_price(subscriptions(spark, d), tiers(spark), promos, "2024-06-01")
    return out.select("c_custkey", *(F.col(c).cast("double").alias(c) for c in ("subtotal", "discount", "tax", "total")))


@query("j16_entitlements", f"with {SUBS} select c_custkey, tier, feature from subs where (tier, feature) in (('growth', 'api'), ('professional', 'api'), ('professional', 'export'), ('enterprise', 'api'), ('enterprise', 'export'), ('enterprise', 'sso'))")
def _(spark, d):
    return B.entitled(subscriptions(spark, d), tiers(spark)).select("c_custkey", "tier", "feature")


@query("j16_upgrade_paths", f"with {SUBS}, t as (select * from (values ('starter', 0), ('growth', 1), ('professional', 2), ('enterprise', 3)) t(tier, rank)) select c_custkey, a.tier, b.tier next from subs join t a using (tier) join t b on b.rank > a.rank")
def _(spark, d):
    return subscriptions(spark, d).select("c_custkey", "tier").join(B.upgrades(tiers(spark)), "tier")


@query("j11_subscription_changes", "select invoice_id, client_id, previous, case when previous is null then 'new' when previous = priority then 'same' else 'changed' end change from (select *, lag(priority) over (partition by client_id order by issue_date, invoice_id) previous from invoices)")
def _(spark, d):
    return B.changes(W.invoices(spark, d), "client_id", "priority").select("invoice_id", "client_id", "previous", "change")


RATES = [("EUR", 1.0852), ("GBP", 1.26754), ("JPY", 0.0067)]


@query("j12_convert", "select invoice_id, cast(rate as double) rate, cast(cast(round(grand_total * rate, 2) as decimal(18,2)) as double) converted from (select *, cast(case currency when 'EUR' then 1.0852 when 'GBP' then 1.2675 when 'JPY' then 0.0067 else 1 end as decimal(12,4)) rate from invoices)")
def _(spark, d):
    rates = spark.createDataFrame(RATES, "currency string, rate double")
    out = B.convert(W.invoices(spark, d).withColumn("amount", F.col("grand_total")), rates)
    return out.select("invoice_id", F.col("rate").cast("double").alias("rate"), F.col("converted").cast("double").alias("converted"))


@query("f24_roi", "select invoice_id, n_items * 4 / 60.0::double * 30.0::double manual, n_items * 4 / 60.0::double * 30.0::double - n_items * 0.5::double saving, case when n_items * 0.5::double > 0 then (n_items * 4 / 60.0::double * 30.0::double - n_items * 0.5::double) / (n_items * 0.5::double) * 100 end percent, (n_items * 4 / 60.0::double * 30.0::double - n_items * 0.5::double) * 0.03::double fee from invoices")
def _(spark, d):
    return W.invoices(spark, d).withColumns(B.roi(F.col("n_items") * 4, 30.0, F.col("n_items") * 0.5)).select("invoice_id", "manual", "saving", "percent", "fee")


@query("j13_unprocessed", "select doc_id from documents where sha256(text) not in (select sha256(text) from documents where doc_id % 3 = 0)")
def _(spark, d):
    docs = W.table(spark, d, "documents")
    return X.reconcile(docs.where("doc_id % 3 = 0"), docs).select("doc_id")
