"""Queries: scalar functions over whole tables."""

from pyspark.sql import functions as F

from docquarry.functions import scalars as S
from docquarry.plans import views as W
from docquarry.registry import query


def labels(spark, d):
    """Amounts and dates of invoices as they are written in several places."""
    k = F.col("invoice_id") % 6
    g = F.col("grand_total").cast("string")
    text = F.when(k == 0, F.concat(F.lit("$"), g)).when(k == 1, F.concat(F.lit("EUR "), g)).when(k == 2, F.replace(g, F.lit("."), F.lit(","))).when(k == 3, F.concat(F.lit("  -"), g, F.lit(" "))).when(k == 4, F.lit("n/a")).otherwise(F.concat(F.lit("£"), g))
    day = F.when(k % 3 == 0, F.date_format("issue_date", "yyyy-MM-dd")).when(k % 3 == 1, F.date_format("issue_date", "MM/dd/yyyy")).otherwise(F.date_format("issue_date", "dd-MM-yyyy"))
    return W.invoices(spark, d).where("n_items > 0").select("invoice_id", text.alias("text"), day.alias("day"), "currency", "grand_total", "tax", "subtotal")


LABELS = """labels_ as (select invoice_id, case invoice_id % 6 when 0 then '$' || grand_total when 1 then 'EUR ' || grand_total when 2 then replace(cast(grand_total as varchar), '.', ',') when 3 then '  -' || grand_total || ' ' when 4 then 'n/a' else '£' || grand_total end as text,
 case invoice_id % 6 % 3 when 0 then strftime(issue_date, '%Y-%m-%d') when 1 then strftime(issue_date, '%m/%d/%Y') else strftime(issue_date, '%d-%m-%Y') end as day, currency, grand_total, tax, subtotal from invoices where n_items > 0)"""


@query("f1_clean_text", r"select doc_id, trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[\x00-\x1f\x{7f}-\x{9f}]', '', 'g')) text from documents")
def _(spark, d):
    return W.table(spark, d, "documents").select("doc_id", S.clean_text(F.col("text")).alias("text"))


@query("f2_f3_f4_numbers", f"""with {LABELS} select invoice_id, coalesce(try_cast(regexp_replace(text, '[^\\d.]', '', 'g') as double), 0.0) parsed, coalesce(try_cast(regexp_replace(text, '[^\\d.\\-]', '', 'g') as double), 0.0) signed, try_cast(regexp_replace(text, '[,$]', '', 'g') as double) safe from labels_""")
def _(spark, d):
    t = F.col("text")
    return labels(spark, d).select("invoice_id", S.parse_number(t).alias("parsed"), S.normalize_currency(t).alias("signed"), S.safe_float(t).alias("safe"))


@query("f5_mixed_numbers", f"""with {LABELS}, t as (select invoice_id, regexp_replace(text, '[^\\d.,\\-]', '', 'g') t from labels_)
select invoice_id, coalesce(try_cast(case when contains(t, ',') and contains(t, '.') then replace(replace(t, '.', ''), ',', '.') when regexp_matches(t, '^[^,]*,[^,]{{2}}$') then replace(t, ',', '.') else replace(t, ',', '') end as double), 0.0) value from t""".replace(") value from t", ") as \"value\" from t"))
def _(spark, d):
    return labels(spark, d).select("invoice_id", S.parse_mixed_number(F.col("text")).alias("value"))


@query("f6_amount_of", f"with {LABELS} select invoice_id, cast(cast(try_cast(regexp_extract(replace(text, ',', ''), '(-?\\d+(?:\\.\\d{{1,4}})?)', 1) as decimal(18,4)) as decimal(18,2)) as double) amount from labels_")
def _(spark, d):
    return labels(spark, d).select("invoice_id", S.amount_of(F.col("text")).cast("double").alias("amount"))


@query("f7_parse_currency", f"""with {LABELS}, t as (select invoice_id, upper(replace(trim(text), ',', '')) t from labels_)
select invoice_id, case when starts_with(t, 'EUR') then cast(regexp_extract(t, 'EUR\\s*(-?[\\d.]+)\\s*$', 1) as double) when starts_with(t, '$') then try_cast(replace(t, '$', '') as double) when starts_with(t, '£') then try_cast(replace(t, '£', '') as double) else try_cast(regexp_replace(t, '[^\\d.\\-]', '', 'g') as double) end amount,
 case when starts_with(t, 'EUR') then 'EUR' when starts_with(t, '£') then 'GBP' else 'USD' end currency from t""")
def _(spark, d):
    return labels(spark, d).select("invoice_id", S.parse_currency(F.col("text")).alias("c")).select("invoice_id", "c.amount", "c.currency")


@query("f8_currency_alias", "select invoice_id, case c when '$' then 'USD' when '€' then 'EUR' else c end currency from (select invoice_id, case currency when 'USD' then '$' when 'EUR' then '€' else lower(currency) end c from invoices)")
def _(spark, d):
    c = F.when(F.col("currency") == "USD", "$").when(F.col("currency") == "EUR", "€").otherwise(F.lower("currency"))
    return W.invoices(spark, d).select("invoice_id", S.currency_alias(c).alias("currency"))


@query("f9_detect_currency", f"with {LABELS} select invoice_id, case when contains(text, '$') then 'USD' when contains(text, 'EUR') then 'EUR' when contains(text, '£') then 'GBP' end currency from labels_")
def _(spark, d):
    return labels(spark, d).select("invoice_id", S.detect_currency(F.col("text")).alias("currency"))


@query("f10_f11_f12_dates", f"with {LABELS} select invoice_id, strftime(coalesce(try_strptime(day, '%Y-%m-%d'), try_strptime(day, '%m/%d/%Y')), '%Y-%m-%d') iso, strftime(coalesce(try_strptime(day, '%Y-%m-%d'), try_strptime(day, '%d/%m/%Y'), try_strptime(day, '%m/%d/%Y'), try_strptime(day, '%d-%m-%Y')), '%Y-%m-%d') day_first from labels_")
def _(spark, d):
    both = {"iso": S.parse_date(F.col("day"), ("yyyy-MM-dd", "MM/dd/yyyy")), "day_first": S.parse_date(F.col("day"), S.DAY_FIRST)}
    return labels(spark, d).select("invoice_id", *(F.date_format(x, "yyyy-MM-dd").alias(k) for k, x in both.items()))


@query("f13_predicates", r"select invoice_id, region_id, regexp_matches(text, '^[$€£¥]?\s*-?[\d.,]+%?$') is_number, regexp_matches(text, '\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2}') is_date, regexp_matches(lower(text), 'total|amount due|balance') is_total from regions")
def _(spark, d):
    t = F.col("text")
    return W.regions(spark, d).select("invoice_id", "region_id", S.is_numeric(t).alias("is_number"), S.is_date(t).alias("is_date"), S.is_total_keyword(t).alias("is_total"))


@query("f14_overlap", "select a.invoice_id, a.pos, cast(len(list_intersect(list_distinct(string_split(lower(a.description), ' ')), string_split(lower(b.description), ' '))) as double) / len(list_distinct(string_split(lower(a.description), ' '))) as overlap from line_items a join line_items b on a.invoice_id = b.invoice_id and b.pos = a.pos + 1")
def _(spark, d):
    a = W.line_items(spark, d).select("invoice_id", "pos", F.col("description").alias("a"))
    b = a.select("invoice_id", (F.col("pos") - 1).alias("pos"), F.col("a").alias("b"))
    return a.join(b, ["invoice_id", "pos"]).select("invoice_id", F.col("pos").cast("long").alias("pos"), S.token_overlap(F.col("a"), F.col("b")).alias("overlap"))


@query("f16_json_of", "select event_id, case event_id % 4 when 3 then null else props end json from events")
def _(spark, d):
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```"))).when(k == 2, F.concat(F.lit("answer "), "props", F.lit(" end"))).otherwise(F.concat(F.lit("none { "), F.col("event_id").cast("string")))
    return W.table(spark, d, "events").select("event_id", S.json_of(text).alias("json"))


@query("f17_money_text", "select invoice_id, case when grand_total is null then 'N/A' when currency = 'USD' then '$' || format('{:,.2f}', cast(grand_total as double)) else currency || ' ' || format('{:,.2f}', cast(grand_total as double)) end text from invoices")
def _(spark, d):
    return W.invoices(spark, d).select("invoice_id", S.money_text(F.col("grand_total"), F.col("currency")).alias("text"))


@query("f18_f19_rates", "select invoice_id, case when subtotal > 0 then cast(tax as double) / cast(subtotal as double) else 0.0 end rate, cast(abs(subtotal - total) as double) / greatest(abs(cast(subtotal as double)), 1.0) error from declared")
def _(spark, d):
    return W.declared(spark, d).select("invoice_id", S.tax_rate(F.col("tax"), F.col("subtotal")).alias("rate"), S.relative_error(F.col("subtotal"), F.col("total")).alias("error"))


@query("f20_trim", "select doc_id, length(trim(text)) n from documents")
def _(spark, d):
    return W.table(spark, d, "documents").select("doc_id", F.length(F.trim("text")).cast("long").alias("n"))


@query("f21_contacts", rf"select doc_id, nullif(regexp_extract(text, '({S.EMAIL})', 1), '') email, nullif(trim(regexp_extract(text, '({S.PHONE})', 1)), '') phone from documents")
def _(spark, d):
    return W.table(spark, d, "documents").select("doc_id", S.email_of(F.col("text")).alias("email"), S.phone_of(F.col("text")).alias("phone"))


@query("f22_line_total", "select invoice_id, pos, cast(round(cast(qty as decimal(12,2)) * cast(unit_price as decimal(12,2)) * cast(1 + (tax_rate * 100) / 100 as decimal(8,4)) - 1.50, 2) as double) total from line_items")
def _(spark, d):
    x = S.line_total(F.col("qty"), F.col("unit_price"), F.col("tax_rate") * 100, F.lit("1.50"))
    return W.line_items(spark, d).select("invoice_id", F.col("pos").cast("long").alias("pos"), x.cast("double").alias("total"))


@query("f23_content_key", "select doc_id, sha256(text || ':v1') as \"key\" from documents")
def _(spark, d):
    return W.table(spark, d, "documents").select("doc_id", S.content_key(F.col("text"), F.lit("v1")).alias("key"))


@query("f28_deltas", "select stage, avg_ms, cast(100.0::double / avg_ms as double) speed_up from (select stage, cast(sum(cast(ms as decimal(18,2))) as double) / count(*) avg_ms from pipeline_metrics group by 1)")
def _(spark, d):
    from docquarry.operators.metrics import stage_summary

    return stage_summary(W.pipeline_metrics(spark, d)).select("stage", "avg_ms", (F.lit(100.0) / F.col("avg_ms")).alias("speed_up"))


DIFFICULTY = "greatest(least((least(length(text) / 5000.0::double, 1.0::double) * 0.3::double + case when n is not null then least(n / 50.0::double, 1.0::double) * 0.3::double else 0.0::double end + case when t then 0.4::double else 0.0::double end) / (0.3::double + case when n is not null then 0.3::double else 0.0::double end + case when t then 0.4::double else 0.0::double end), 1.0::double), 0.0::double)"


@query("f29_difficulty", f"select conv_id, turn, {DIFFICULTY} difficulty from (select *, case when turn % 2 = 0 then turn end n, regexp_matches(lower(text), 'table|line_items') t from conversations)")
def _(spark, d):
    n = F.when(F.col("turn") % 2 == 0, F.col("turn"))
    return W.table(spark, d, "conversations").select("conv_id", "turn", S.difficulty(F.col("text"), n).alias("difficulty"))


for _name, _at in (("linear", 0.02), ("exponential", 0.02), ("cosine", 0.02)):

    @query(f"f30_curriculum_{_name}", f"select conv_id, turn from (select conv_id, turn, {DIFFICULTY} x from (select *, cast(null as int) n, regexp_matches(lower(text), 'table|line_items') t from conversations)) where x <= {S.curriculum_threshold(0.5, _at, 0.06, _name)!r}::double")
    def _(spark, d, name=_name, at=_at):
        score = S.difficulty(F.col("text"), F.lit(None).cast("int"))
        return W.table(spark, d, "conversations").withColumn("x", score).where(F.col("x") <= S.curriculum_threshold(0.5, at, 0.06, name)).select("conv_id", "turn")


@query("f31_f32_regions", """with z as (select invoice_id, region_id, case region_id % 5 when 0 then 'Table' when 1 then 'vendor' when 2 then 'summary' when 3 then 'formula' else 'other' end t from regions)
select invoice_id, region_id, case t when 'Table' then 'table' when 'vendor' then 'vendor_block' when 'summary' then 'financial_summary' when 'formula' then 'formula' else 'text_block' end region_type, case t when 'Table' then 'Table Recognition:' when 'formula' then 'Formula Recognition:' else 'OCR:' end prompt, t = 'Table' is_table from z""")
def _(spark, d):
    from docquarry.operators.layout import REGION_TYPES

    k = F.col("region_id") % 5
    t = F.when(k == 0, "Table").when(k == 1, "vendor").when(k == 2, "summary").when(k == 3, "formula").otherwise("other")
    names = F.create_map(*(F.lit(x) for kv in REGION_TYPES.items() for x in kv))
    df = W.regions(spark, d).withColumn("t", t)
    return df.select("invoice_id", "region_id", F.coalesce(names[F.lower("t")], F.lit("text_block")).alias("region_type"), S.prompt_of(F.col("t")).alias("prompt"), S.is_table_region(F.col("t")).alias("is_table"))


@query("f_sql_functions", f"with {LABELS} select invoice_id, coalesce(try_cast(regexp_replace(text, '[^\\d.]', '', 'g') as double), 0.0) parsed, try_cast(regexp_replace(text, '[,$]', '', 'g') as double) safe from labels_")
def _(spark, d):
    S.register(spark)
    return labels(spark, d).select("invoice_id", F.expr("dq_parse_number(text)").alias("parsed"), F.expr("dq_safe_float(text)").alias("safe"))


@query("f_sql_table_functions", "select invoice_id, cast(pos as bigint) pos, t_description description, t_quantity quantity, t_unit_price unit_price, t_line_total line_total from record_items where in_t")
def _(spark, d):
    S.register(spark)
    W.records(spark, d).select("invoice_id", "t.items").createOrReplaceTempView("dq_documents")
    return spark.sql("select invoice_id, cast(i.pos as bigint) pos, i.description, i.quantity, i.unit_price, i.line_total from dq_documents, lateral dq_items(items) i")


@query("f_scorer_hook", "select invoice_id, cast(length(text) % 7 as double) / 7 score, length(text) > 20 long from ocr_lines where text <> ''")
def _(spark, d):
    from docquarry.operators.hooks import scored

    def load():
        import pandas as pd

        # a stub in place of a trained model
        return lambda batch: pd.DataFrame({"score": batch["text"].str.len() % 7 / 7, "long": batch["text"].str.len() > 20})

    return scored(W.ocr_lines(spark, d).where("text <> ''"), load, ["text"], "score double, long boolean", ["invoice_id"])
