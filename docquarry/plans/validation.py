"""Queries: arithmetic and other validation."""

from pyspark.sql import functions as F

from docquarry.operators import validate as V
from docquarry.plans import views as W
from docquarry.registry import query

SUMS = "coalesce(subtotal, 0) + coalesce(tax, 0)"
FULL = f"{SUMS} - coalesce(discount, 0)"
#: What the lines give, in SQL.
LINES = """lines_ as (select invoice_id, max(abs(a - line_total)) line_off, cast(sum(a) as decimal(18,2)) items_calc, cast(sum(a * tax_rate) as decimal(28,4)) tax_calc, min(line_total) worst_line, cast(sum(coalesce(nullif(line_total, 0), cast(round(unit_price, 2) as decimal(18,2)), 0)) as decimal(18,2)) items_stated
 from (select *, cast(round(qty * unit_price, 2) as decimal(18,2)) a from line_items) group by 1), x as (select * from declared left join lines_ using (invoice_id))"""
ITEMS, STATED, TOTAL = "coalesce(items_total, 0)", "coalesce(subtotal, 0)", "coalesce(total, 0)"
#: For each profile, written out from the formats: lines, items and total check failed, another error, number of
#: warnings that are no failed check, and which failed checks (i, t) are errors.
CHECKS = {
    "etl": ("false", "n_items > 0 and abs(items_total - subtotal) > 0.01", f"abs({TOTAL} - (subtotal + coalesce(tax, 0))) > 0.01", "false", f"coalesce(cast(abs({TOTAL} - (subtotal + coalesce(tax, 0))) > 0.005 and not abs({TOTAL} - (subtotal + coalesce(tax, 0))) > 0.01 as int), 0)", "it"),
    "decimal": ("line_off > 0.01", f"abs({ITEMS} - {STATED}) > 0.01", f"abs({TOTAL} - ({FULL})) > 0.01", "false", "0", "it"),
    "guarded": ("false", "n_items > 0 and subtotal > 0 and abs(items_total - subtotal) > 0.01", f"n_items > 0 and total > 0 and abs(total - ({SUMS})) > 0.01", "false", "0", "it"),
    "model": ("false", f"abs({ITEMS} - {STATED}) > 0.02", "false", "subtotal < 0 or total < 0 or worst_line < 0", "cast(n_items = 0 as int) + cast(confidence < 0.7 as int)", "i"),
    "quadrant": ("line_off > 0.01", "false", f"abs({TOTAL} - ({FULL})) > 0.01", "false", "0", "t"),
    "override": ("false", "false", f"not abs(case when items_total > 0 then items_total else {STATED} end + coalesce(tax, 0) - coalesce(discount, 0) - {TOTAL}) < 0.01", "false", "0", "t"),
    "relative": ("false", f"case when subtotal = 0 then {ITEMS} <> 0 else abs({ITEMS} - subtotal) > 0.02 * subtotal and subtotal > 0 end", "case when subtotal = 0 then abs(coalesce(tax, 0) - total) > 0.01 when total = 0 then abs(subtotal + coalesce(tax, 0)) > 0.02 else abs(subtotal + coalesce(tax, 0) - total) > 0.02 * total and total > 0 end", "false", "0", "it"),
    "half_unit": ("false", "abs(coalesce(items_stated, 0) - subtotal) > 0.5", f"abs(subtotal + tax - {TOTAL}) > 0.5", "false", "0", "it"),
    "relative_floor": ("false", f"abs({ITEMS} - {STATED}) > 0.02 * greatest(abs({STATED}), 1)", f"abs({TOTAL} - ({SUMS})) > 0.02 * greatest(abs({TOTAL}), 1)", "false", "0", "it"),
    "eval": ("false", f"n_items > 0 and abs(items_total - {STATED}) > 0.02 * greatest(abs({STATED}), 1)", f"case when {TOTAL} = 0 then not abs({FULL}) < 0.02 else not abs({TOTAL} - ({FULL})) < 0.02 * greatest(abs(total), 1) end", "false", "0", "t"),
    "receipt": ("false", "items_total > 0 and subtotal > 0 and abs(items_total - subtotal) > 0.01", f"total > 0 and subtotal > 0 and abs(total - ({FULL})) > 0.01", "false", "cast(n_items = 0 as int)", "i"),
    "worker": ("false", f"abs({ITEMS} - {STATED}) > 0.02", f"abs({TOTAL} - ({SUMS})) > 0.02", "false", "0", "t"),
    "item_tax": ("false", f"not abs(coalesce(items_calc, 0) - {STATED}) < 0.01", f"not abs(round(coalesce(items_calc, 0) + coalesce(tax_calc, 0) - coalesce(discount, 0), 2) - {TOTAL}) < 0.01", "not abs(coalesce(tax_calc, 0) - coalesce(tax, 0)) < 0.01", "0", "it"),
    "optional_parts": ("false", "false", f"subtotal is null or total is null or abs(total - ({FULL})) > 0.01", "false", "0", "t"),
}
for _name, (_lines, _items, _total, _other, _warnings, _errors) in CHECKS.items():
    _error = " or ".join(["l", "o"] + [k for k in "it" if k in _errors])
    _math = "not (i or t or l or o)" if _name == "item_tax" else "not (i or t or l)"

    @query(f"v1_arithmetic_{_name}", f"""
with {LINES} select invoice_id, not l lines_ok, not i items_ok, not t total_ok, {_math} math_ok, not ({_error}) is_valid, cast(l as bigint) + cast(i as bigint) + cast(t as bigint) + cast(o as bigint) + w n_issues
from (select *, coalesce({_lines}, false) l, coalesce({_items}, false) i, coalesce({_total}, false) t, coalesce({_other}, false) o, {_warnings} w from x)""")
    def _(spark, d, name=_name):
        p = V.PROFILES[name]
        df = W.declared(spark, d)
        df = V.with_line_checks(df, W.line_items(spark, d)) if p.lines or p.amounts or p.price_for_total or p.base == "recompute" else df
        out = V.validate_arithmetic(df, name)
        return out.select("invoice_id", "lines_ok", "items_ok", "total_ok", "math_ok", "is_valid", F.size("issues").cast("long").alias("n_issues"))


@query("v1_field_confidences", f"select invoice_id, case when i then 0.5 else 0.95 end::double subtotal_confidence, case when t then 0.5 else 0.95 end::double total_confidence, case when i or t then 0.65 else 0.90 end::double overall_confidence from (select invoice_id, {CHECKS['relative_floor'][1]} i, {CHECKS['relative_floor'][2]} t from declared)")
def _(spark, d):
    out = V.floor_confidences(V.validate_arithmetic(W.declared(spark, d), "relative_floor"))
    return out.select("invoice_id", "subtotal_confidence", "total_confidence", "overall_confidence")


@query("v1_pass_rate_by_region", f"""
select region, count(*) documents, count(*) filter (ok) passed, cast(count(*) filter (ok) as double) / count(*) pass_rate
from (select region, not (coalesce(abs(items_total - subtotal) > 0.01, false) or coalesce(abs(total - ({FULL})) > 0.01, false)) ok from declared) group by 1""")
def _(spark, d):
    return V.pass_rate(V.validate_arithmetic(W.declared(spark, d)), "region")


@query("v1_issue_rows", f"""
select invoice_id, 'SUBTOTAL_MISMATCH' code, 'error' severity, cast(abs(items_total - subtotal) as double) difference from declared where abs(items_total - subtotal) > 0.01
union all select invoice_id, 'TOTAL_MISMATCH', 'error', cast(abs(total - ({FULL})) as double) from declared where abs(total - ({FULL})) > 0.01""")
def _(spark, d):
    return V.validate_arithmetic(W.declared(spark, d)).select("invoice_id", F.inline("issues"))


@query("v2_correct_arithmetic", """
select invoice_id, cast(s as double) subtotal, cast(t as double) tax, cast(s + t as double) total,
 concat_ws(',', case when subtotal is distinct from s then 'subtotal' end, case when tax is null then 'tax' end, case when total is distinct from s + t then 'total' end) notes
from (select *, coalesce(tax, cast(round(s * 0.10, 2) as decimal(18,2))) t from (select *, coalesce(items_total, subtotal, 0) s from declared))""")
def _(spark, d):
    out = V.correct_arithmetic(W.declared(spark, d))
    return out.select("invoice_id", *(F.col(c).cast("double").alias(c) for c in ("subtotal", "tax", "total")), F.array_join("notes", ",").alias("notes"))


@query("v3_dates", """
select invoice_id, b due_before_issue, f in_future, o too_old, not (b or f or o) dates_ok from (select invoice_id, coalesce(due_date < issue_date, false) b,
 issue_date > date '1998-01-01' f, date_diff('day', issue_date, date '1998-01-01') / 365.25 > 5 o from declared)""")
def _(spark, d):
    return V.validate_dates(W.declared(spark, d), "1998-01-01", 5).select("invoice_id", "due_before_issue", "in_future", "too_old", "dates_ok")


@query("v4_required", """
select invoice_id, concat_ws(',', case when vendor is null or vendor = '' then 'vendor' end, case when coalesce(tax, 0) = 0 then 'tax' end, case when coalesce(total, 0) = 0 then 'total' end, case when due_date is null then 'due_date' end) missing from declared""")
def _(spark, d):
    out = V.validate_required(W.declared(spark, d), ["vendor", "tax", "total", "due_date"])
    return out.select("invoice_id", F.array_join("missing", ",").alias("missing"))


@query("v5_types", "select event_id, coalesce(json_type(props, '$.k') in ('BIGINT', 'UBIGINT', 'DOUBLE'), false) k_ok, coalesce(json_type(props, '$.name') = 'VARCHAR', false) name_ok from events")
def _(spark, d):
    return V.validate_types(W.table(spark, d, "events"), "props", {"k": "number", "name": "string"}).select("event_id", "k_ok", "name_ok")


def json_documents(spark, d):
    """Each invoice as JSON text: some taxes and prices in quotes, some lines as plain text, some lists as an object,
    some documents cut off."""
    i = F.col("invoice_id")
    quoted = lambda x, when: F.when(when, F.concat(F.lit('"'), x.cast("string"), F.lit('"'))).otherwise(x.cast("string"))

    def line(x, k):
        n = i + k + 1
        whole = F.concat(F.lit('{"description": "'), x["description"], F.lit('", "unit_price": '), quoted(x["unit_price"], n % 6 == 0), F.lit(', "line_total": '), x["line_total"].cast("string"), F.lit("}"))
        return F.when(n % 10 == 0, F.lit('"see attachment"')).otherwise(whole)

    lines = F.array_join(F.transform("t.items", line), ", ")
    lines = F.when(i % 9 == 0, F.lit('{"first": 1}')).otherwise(F.concat(F.lit("["), lines, F.lit("]")))
    summary = F.concat(F.lit('{"subtotal": '), F.col("t.financial.subtotal").cast("string"), F.lit(', "tax": '), quoted(F.col("t.financial.tax_total"), i % 4 == 0), F.lit(', "grand_total": '), F.when(i % 7 == 0, "null").otherwise(F.col("t.financial.grand_total").cast("string")), F.lit("}"))
    text = F.concat(F.lit('{"financial_summary": '), summary, F.lit(', "line_items": '), lines, F.lit("}"))
    return W.records(spark, d).where("size(t.items) > 0").select("invoice_id", F.when(i % 25 == 0, F.substring(text, 1, 40)).otherwise(text).alias("body"))


@query("v5_type_errors", """with d as (select distinct invoice_id from line_items), l as (select invoice_id, pos, invoice_id + pos n from line_items where invoice_id % 9 <> 0 and invoice_id % 25 <> 0)
select invoice_id, '$' path, 'json' want, 'text' got from d where invoice_id % 25 = 0
union all select invoice_id, 'financial_summary.tax', 'number', 'string' from d where invoice_id % 4 = 0 and invoice_id % 25 <> 0
union all select invoice_id, 'financial_summary.grand_total', 'number', 'null' from d where invoice_id % 7 = 0 and invoice_id % 25 <> 0
union all select invoice_id, 'line_items', 'list', 'object' from d where invoice_id % 9 = 0 and invoice_id % 25 <> 0
union all select invoice_id, 'line_items[' || (pos - 1) || ']', 'object', 'string' from l where n % 10 = 0
union all select invoice_id, 'line_items[' || (pos - 1) || '].unit_price', 'number', 'string' from l where n % 6 = 0 and n % 10 <> 0""")
def _(spark, d):
    return V.type_errors(json_documents(spark, d), "body")


@query("v6_business", """
select invoice_id, coalesce(subtotal, 0) < 0 or coalesce(tax, 0) < 0 or coalesce(total, 0) < 0 negative, coalesce(case when subtotal > 0 then cast(tax as double) / cast(subtotal as double) end > 0.05, false) high_tax, length(cast(invoice_id as varchar)) > 4 long_id from declared""")
def _(spark, d):
    return V.validate_business(W.declared(spark, d), 0.05, 4).select("invoice_id", "negative", "high_tax", "long_id")


@query("v7_statistical", """
with s as (select vendor, count(total) n, cast(sum(total) as double) s, cast(sum(cast(total * total as decimal(38,4))) as double) q from declared where vendor is not null group by 1)
select invoice_id, coalesce(abs(case when dev > 0 then (cast(total as double) - mean) / dev else 0 end) > 2.0, false) outlier from (select invoice_id, total, s / n mean, sqrt(greatest(q / n - (s / n) * (s / n), 0)) dev from declared join s using (vendor))""")
def _(spark, d):
    return V.validate_statistical(W.declared(spark, d)).select("invoice_id", "outlier")


@query("v8_document_issues", f"""
with x as (select * from declared)
select invoice_id, 'subtotal' field, 'SUBTOTAL_MISMATCH' issue, 'error' severity from x where abs(items_total - subtotal) > 0.01
union all select invoice_id, 'total', 'TOTAL_MISMATCH', 'error' from x where abs(total - ({FULL})) > 0.01
union all select invoice_id, 'due_date', 'DUE_BEFORE_ISSUE', 'error' from x where due_date < issue_date
union all select invoice_id, 'issue_date', 'FUTURE_DATE', 'warning' from x where issue_date > date '1998-01-01'
union all select invoice_id, 'issue_date', 'TOO_OLD', 'warning' from x where date_diff('day', issue_date, date '1998-01-01') / 365.25 > 10
union all select invoice_id, 'amount', 'NEGATIVE', 'error' from x where coalesce(subtotal, 0) < 0 or coalesce(tax, 0) < 0 or coalesce(total, 0) < 0
union all select invoice_id, 'tax', 'HIGH_TAX', 'warning' from x where case when subtotal > 0 then cast(tax as double) / cast(subtotal as double) end > 0.3
union all select invoice_id, 'line_items', 'NO_ITEMS', 'warning' from x where n_items = 0
union all select invoice_id, 'confidence', 'LOW_CONFIDENCE', 'warning' from x where confidence < 0.85
union all select invoice_id, 'vendor', 'MISSING', 'error' from x where vendor is null
union all select invoice_id, 'tax', 'MISSING', 'error' from x where tax is null
union all select invoice_id, 'client', 'NOT_A_NUMBER', 'error' from x where client is not null """)
def _(spark, d):
    return V.validate_document(W.declared(spark, d), "1998-01-01", required=("vendor", "tax"), numbers=("client", "client_id"))


@query("p15_needs_review", f"""
select invoice_id, confidence from declared where coalesce(abs(items_total - subtotal) > 0.01, false) or coalesce(abs(total - ({FULL})) > 0.01, false) or confidence < 0.6""")
def _(spark, d):
    return V.needs_review(V.validate_arithmetic(W.declared(spark, d))).select("invoice_id", "confidence")


@query("w8_duplicate_items", "select invoice_id, pos, occurrence from (select invoice_id, pos, row_number() over (partition by invoice_id, description order by pos) occurrence from line_items) where occurrence > 1")
def _(spark, d):
    return V.duplicate_items(W.line_items(spark, d)).select("invoice_id", F.col("pos").cast("long").alias("pos"), F.col("occurrence").cast("long").alias("occurrence"))
