"""Queries: predictions against truth, mined errors, confidence."""

from pyspark.sql import functions as F

from docquarry.operators import confidence as C
from docquarry.operators import evaluate as E
from docquarry.operators import compare as N
from docquarry.operators import mining as M
from docquarry.operators import project as P
from docquarry.operators import validate as V
from docquarry.plans import views as W
from docquarry.registry import query
from docquarry.storage import new_folder


def paired(spark, d):
    t = W.invoices(spark, d).select("invoice_id", "vendor", "currency", F.col("issue_date").cast("string").alias("date"), F.col("grand_total").alias("total"))
    p = W.predictions(spark, d).select("invoice_id", "vendor", "currency", F.col("date").cast("string").alias("date"), F.col("grand_total").alias("total"))
    return E.pairs(t, p)


PAIRS = """pairs as (select t.invoice_id, t.vendor t_vendor, p.vendor p_vendor, t.currency t_currency, p.currency p_currency, cast(t.issue_date as varchar) t_date, cast(p.date as varchar) p_date, t.grand_total t_total, p.grand_total p_total
from invoices t join predictions p using (invoice_id))"""
TEXT = {
    "equal": "t_{0} = p_{0}", "folded": "lower(trim(t_{0})) = lower(trim(p_{0}))", "inside": "contains(lower(trim(p_{0})), lower(trim(t_{0})))",
    "contains": "(contains(lower(trim(p_{0})), lower(trim(t_{0}))) or contains(lower(trim(t_{0})), lower(trim(p_{0}))))",
    "tokens": "len(list_intersect(list_distinct(string_split(lower(trim(t_{0})), ' ')), string_split(lower(trim(p_{0})), ' '))) / len(list_distinct(string_split(lower(trim(t_{0})), ' '))) > 0.7",
}
NUMBER = {True: "case when t_total = 0 then p_total = 0 else cast(abs(t_total - p_total) as double) < {0} * abs(cast(t_total as double)) end", False: "cast(abs(t_total - p_total) as double) < {0}", "most": "cast(abs(t_total - p_total) as double) <= {0}"}
#: For each profile: text rule, number rule (limit, relative), both missing agree, fields without truth count.
RULES = {
    "truth_keys": ("folded", 1e-4, True, False, False), "contains": ("contains", 0.01, "most", False, True), "blocks": ("folded", 0.01, False, False, True), "regions": ("tokens", 0.01, False, False, True), "three_fields": ("equal", 0.01, "most", False, True),
    "paths_exact": ("folded", 0.0, "most", True, True), "paths_string": ("folded", 0.0, "most", True, True), "four_fields": ("equal", 0.01, True, False, True), "contained_in": ("inside", 0.01, False, False, True),
}


def matches(profile: str) -> str:
    text, limit, relative, missing, every = RULES[profile]
    out = []
    for c in ("vendor", "currency", "date", "total"):
        right = NUMBER[relative].format(limit) if c == "total" else TEXT[text].format(c)
        right = f"case when t_{c} is null and p_{c} is null then {str(missing).lower()} else coalesce({right}, false) end"
        out.append(f"{right if every else f'case when t_{c} is not null then {right} end'} {c}_ok")
    return f"select invoice_id, {', '.join(out)} from pairs"


SUMMED = "select *, coalesce(cast(vendor_ok as int), 0) + coalesce(cast(currency_ok as int), 0) + coalesce(cast(date_ok as int), 0) + coalesce(cast(total_ok as int), 0) hit, cast(vendor_ok is not null as int) + cast(currency_ok is not null as int) + cast(date_ok is not null as int) + cast(total_ok is not null as int) counted"
for _name in RULES:

    @query(f"e1_fields_{_name}", f"""with {PAIRS}, m as ({matches(_name)}), s as ({SUMMED} from m)
select invoice_id, vendor_ok, currency_ok, date_ok, total_ok, hit, counted, case when counted > 0 then cast(hit as double) / counted else 0.0 end accuracy from s""")
    def _(spark, d, name=_name):
        return E.field_accuracy(paired(spark, d), name).select("invoice_id", "vendor_ok", "currency_ok", "date_ok", "total_ok", F.col("right").alias("hit"), "counted", "accuracy")


@query("e1_fields_f1", f"""with {PAIRS}, m as ({matches("truth_keys")}), s as (select p.invoice_id, cast(coalesce(vendor_ok, false) as int) + cast(coalesce(currency_ok, false) as int) + cast(coalesce(date_ok, false) as int) + cast(coalesce(total_ok, false) as int) tp,
 cast(coalesce(not vendor_ok, false) as int) + cast(coalesce(not currency_ok, false) as int) + cast(coalesce(not date_ok, false) as int) + cast(coalesce(not total_ok, false) as int) fn,
 cast(t_vendor is null and p_vendor is not null as int) + cast(t_currency is null and p_currency is not null as int) + cast(t_date is null and p_date is not null as int) + cast(t_total is null and p_total is not null as int) fp from m join pairs p using (invoice_id))
select *, case when tp > 0 then cast(2 * tp as double) / (2 * tp + fp + fn) else 0.0 end f1 from s""")
def _(spark, d):
    return E.field_f1(paired(spark, d)).select("invoice_id", "tp", "fn", "fp", "f1")


ALIGNED = """aligned as (select coalesce(t.invoice_id, p.invoice_id) invoice_id, coalesce(t.pos, p.pos) pos, t.description t_description, t.qty t_qty, t.line_total t_line_total, p.description p_description, p.qty p_qty, p.line_total p_line_total
from line_items t full join predicted_items p on t.invoice_id = p.invoice_id and t.pos = p.pos)"""
COUNTS = f"""{ALIGNED}, counts as (select invoice_id, count(t_qty) truth_rows, count(p_qty) predicted_rows, count(*) filter (t_qty is not null and p_qty is not null) as both_rows,
 count(*) filter (t_description = p_description) same_description, count(*) filter (t_qty = p_qty) same_qty, count(*) filter (t_line_total = p_line_total) same_total,
 count(*) filter (len(list_intersect(list_distinct(string_split(lower(t_description), ' ')), list_distinct(string_split(lower(p_description), ' ')))) / len(list_distinct(list_concat(string_split(lower(t_description), ' '), string_split(lower(p_description), ' ')))) > 0.7) like_description
from aligned group by 1)"""
RATIO = "(cast(least(truth_rows, predicted_rows) as double) / greatest(truth_rows, predicted_rows))"
SAME, COLUMNS = "cast(truth_rows = predicted_rows as double)", "cast(predicted_rows > 0 as double)"
SCORES = {
    "halves": f"{SAME} * 0.5 + {COLUMNS} * 0.5",
    "row_cell": f"{SAME} * 0.3 + case when truth_rows > 0 then cast(same_description + same_qty + same_total as double) / (3 * truth_rows) else 0.0 end * 0.7",
    "three_parts": f"{RATIO} * 0.4 + {COLUMNS} * 0.3 + case when both_rows > 0 then cast(like_description + same_qty + same_total as double) / (3 * both_rows) else 0.0 end * 0.3",
    "ratios": f"({RATIO} + {COLUMNS}) / 2",
    "items": "case when truth_rows > 0 then greatest(0.0, 1 - cast(abs(truth_rows - predicted_rows) as double) / truth_rows) else cast(predicted_rows = 0 as double) end",
}
for _name, _score in SCORES.items():

    @query(f"e3_table_{_name}", f"with {COUNTS} select invoice_id, cast(({_score}).replace('','') as double) score from counts".replace(".replace('','')", ""))
    def _(spark, d, name=_name):
        return E.table_score(E.table_counts(W.line_items(spark, d), W.predicted_items(spark, d)), name).select("invoice_id", "score")


HTML = "select invoice_id, '<table>' || string_agg('<tr><td>' || description || '</td><td>' || cast(qty as bigint) || '</td><td>' || line_total || '</td></tr>', '' order by pos) || '</table>' html from {0} group by 1"
COUNTED = "len(regexp_extract_all({0}, '{1}'))"


@query("e3_table_markup", f"""with t as ({HTML.format("line_items")}), p as (select invoice_id, case when invoice_id % 3 = 0 then replace(html, '</td></tr>', '</td><td>x</td></tr>') when invoice_id % 5 = 0 then replace(html, '</table>', '<tr><td>more</td></tr><tr></tr></table>') else html end html from ({HTML.format("predicted_items")})),
b as (select t.invoice_id, t.html t, coalesce(p.html, '') p from t left join p using (invoice_id)),
n as (select invoice_id, {COUNTED.format("t", "<tr")} tr, {COUNTED.format("p", "<tr")} pr, {COUNTED.format("regexp_extract(t, '(?s)<tr[^>]*>(.*?)</tr>', 1)", "<t[dh]")} tc, {COUNTED.format("regexp_extract(p, '(?s)<tr[^>]*>(.*?)</tr>', 1)", "<t[dh]")} pc from b)
select invoice_id, ((1 - cast(abs(pr - tr) as double) / greatest(tr, 1)) + (1 - cast(abs(pc - tc) as double) / greatest(tc, 1))) / 2 score from n""")
def _(spark, d):
    i, html = F.col("invoice_id"), F.col("html")
    t, p = P.html_table(W.line_items(spark, d)), P.html_table(W.predicted_items(spark, d))
    wide, long = F.replace(html, F.lit("</td></tr>"), F.lit("</td><td>x</td></tr>")), F.replace(html, F.lit("</table>"), F.lit("<tr><td>more</td></tr><tr></tr></table>"))
    p = p.select(i, F.when(i % 3 == 0, wide).when(i % 5 == 0, long).otherwise(html).alias("read"))
    return t.join(p, "invoice_id", "left").select("invoice_id", E.markup_score(html, F.col("read")).alias("score"))


for _name, _all in (("matched", False), ("all", True)):

    @query(f"e2_numbers_{_name}", f"""with {ALIGNED}, s as (select invoice_id, count(*) filter (abs(t_qty - p_qty) <= 0.01) + count(*) filter (cast(abs(t_line_total - p_line_total) as double) <= 0.01) hit, 2 * count(*) counted from aligned where t_qty is not null {"" if _all else "and p_qty is not null"} group by 1)
select invoice_id, hit, counted, cast(hit as double) / counted accuracy from s""")
    def _(spark, d, unmatched=_all):
        return E.numeric_accuracy(W.line_items(spark, d), W.predicted_items(spark, d), unmatched).withColumnRenamed("right", "hit")


DOCUMENT = f"""{PAIRS}, m as ({matches("blocks")}), f as ({SUMMED} from m), {COUNTS}, n as (select invoice_id, cast(count(*) filter (abs(t_qty - p_qty) <= 0.01) + count(*) filter (cast(abs(t_line_total - p_line_total) as double) <= 0.01) as double) / (2 * count(*)) as num from aligned where t_qty is not null group by 1),
scored as (select invoice_id, cast(hit as double) / counted as field, cast(total_ok as double) as valid, coalesce(num, 1.0) as number, coalesce({RATIO}, 1.0) as tab from f left join n using (invoice_id) left join counts using (invoice_id))"""


def scored(spark, d, weights="even"):
    side = lambda p: {f"{p}_vendor": F.col(f"{p}.vendor.name"), f"{p}_currency": F.col(f"{p}.financial.currency"), f"{p}_date": F.col(f"{p}.issue_date"), f"{p}_total": F.col(f"{p}.financial.grand_total").cast("decimal(18,2)")}
    lines = lambda p: F.transform(f"{p}.items", lambda x: F.struct(x["quantity"].alias("qty"), x["line_total"].cast(W.MONEY).alias("line_total")))
    df = W.records(spark, d).withColumns(side("t") | side("p") | {f"{p}_items": lines(p) for p in "tp"})
    return E.row_scores(df, weights).select("invoice_id", "field", "number", "table", "valid", "overall")


@query("e4_documents_even", f"with {DOCUMENT} select invoice_id, field, number, tab as \"table\", valid, field * 0.3 + number * 0.3 + tab * 0.2 + valid * 0.2 as overall from scored")
def _(spark, d):
    return scored(spark, d)


@query("e4_documents_field", f"with {DOCUMENT} select invoice_id, field * 0.5 + number * 0.3 + tab * 0.2 + valid * 0.0 as overall from scored")
def _(spark, d):
    return scored(spark, d, "field").select("invoice_id", "overall")


@query("e4_exact_match", f"with {PAIRS} select count(*) samples, count(*) filter (coalesce(t_vendor = p_vendor and t_date = p_date and t_total = p_total, false)) exact from pairs")
def _(spark, d):
    same = F.coalesce((F.col("t_vendor") == F.col("p_vendor")) & (F.col("t_date") == F.col("p_date")) & (F.col("t_total") == F.col("p_total")), F.lit(False))
    return paired(spark, d).agg(F.count("*").alias("samples"), F.count_if(same).alias("exact"))


#: What a base model reads: some vendors are missed, every currency is taken for USD, some totals are one off.
BASE = "base as (select * replace (case when invoice_id % 4 <> 0 then p_vendor end as p_vendor, 'USD' as p_currency, case when invoice_id % 3 = 0 then cast(p_total + 1 as decimal(18,2)) else p_total end as p_total) from pairs)"


@query("e5_compare_models", f"""with {PAIRS}, m as ({matches("blocks")}), f as ({SUMMED} from m), {BASE}, mb as ({matches("blocks").replace("from pairs", "from base")}), fb as ({SUMMED} from mb), both_ as (select f.invoice_id, cast(fb.hit as double) / fb.counted base, cast(f.hit as double) / f.counted tuned from f join fb using (invoice_id))
select invoice_id, base, tuned, tuned - base gain, case when tuned = 1.0 then 'completed' when tuned > 0 then 'partial' else 'failed' end status from both_""")
def _(spark, d):
    i, money = F.col("invoice_id"), "decimal(18,2)"
    df = paired(spark, d).withColumns({
        "b_vendor": F.when(i % 4 != 0, F.col("p_vendor")), "b_currency": F.lit("USD"), "b_date": F.col("p_date"),
        "b_total": F.when(i % 3 == 0, (F.col("p_total") + F.lit(1).cast(money)).cast(money)).otherwise(F.col("p_total")),
    })
    return E.compare_models(df, "blocks", "invoice_id")


@query("e6_validation_pass_rate", "select count(*) documents, count(*) filter (ok) passed from (select coalesce(abs(total - (coalesce(subtotal, 0) + coalesce(tax, 0))) <= 0.01, true) ok from declared)")
def _(spark, d):
    rule = V.Profile("0.01", items=None)
    return V.validate_arithmetic(W.declared(spark, d), rule).agg(F.count("*").alias("documents"), F.count_if("math_ok").alias("passed"))


@query("a16_dataset_scores", f"with {DOCUMENT} select count(*) samples, cast(count(*) filter (valid = 1.0) as double) / count(*) valid_rate, min(field) field_min, max(field) field_max, floor(avg(field) * 1000000 + 0.5) field_mean6, floor(stddev_pop(field) * 1000000 + 0.5) field_std6 from scored")
def _(spark, d):
    six = lambda x: F.floor(x * 1000000 + 0.5).cast("double")
    out = E.summary(scored(spark, d), "field", "valid")
    return out.select("samples", F.col("valid_mean").alias("valid_rate"), "field_min", "field_max", six(F.col("field_mean")).alias("field_mean6"), six(F.col("field_std")).alias("field_std6"))


@query("a17_scores_by_region", f"with {DOCUMENT} select region, count(*) samples, min(field) field_min, max(field) field_max, floor(avg(field) * 1000000 + 0.5) field_mean6 from scored join (select invoice_id, region from invoices) using (invoice_id) group by 1")
def _(spark, d):
    out = E.summary(scored(spark, d).join(W.invoices(spark, d).select("invoice_id", "region"), "invoice_id"), "field", by=("region",))
    return out.select("region", "samples", "field_min", "field_max", F.floor(F.col("field_mean") * 1000000 + 0.5).cast("double").alias("field_mean6"))


@query("a18_batch_average", f"with {DOCUMENT} select floor(avg(field) * 1000000 + 0.5) field6, floor(avg(number) * 1000000 + 0.5) number6, floor(avg(tab) * 1000000 + 0.5) table6, floor(avg(valid) * 1000000 + 0.5) valid6 from scored")
def _(spark, d):
    return scored(spark, d).agg(*(F.floor(F.avg(c) * 1000000 + 0.5).cast("double").alias(f"{c}6") for c in ("field", "number", "table", "valid")))


FLAT = "select invoice_id, 'vendor.name' path, vendor as value from {0} where vendor is not null union all select invoice_id, 'currency', currency from {0} where currency is not null union all select invoice_id, 'date', cast({1} as varchar) from {0} union all select invoice_id, 'items[' || (pos - 1) || '].qty', cast(cast(qty as bigint) as varchar) from {2} union all select invoice_id, 'items[' || (pos - 1) || '].description', description from {2}"


def nested(inv, items, date):
    lines = items.groupBy("invoice_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col("qty").cast("bigint").alias("qty"), "description"))), lambda x: F.struct(x["qty"].alias("qty"), x["description"].alias("description"))).alias("items"))
    return inv.select("invoice_id", F.struct(F.col("vendor").alias("name")).alias("vendor"), "currency", F.col(date).cast("string").alias("date")).join(lines, "invoice_id", "left")


@query("p8_flatten", FLAT.format("invoices", "issue_date", "line_items"))
def _(spark, d):
    return E.flatten(nested(W.invoices(spark, d), W.line_items(spark, d), "issue_date"), "invoice_id", ["vendor", "currency", "date", "items"])


@query("a19_all_paths", f"with t as ({FLAT.format('invoices', 'issue_date', 'line_items')}), p as ({FLAT.format('predictions', 'date', 'predicted_items')}), s as (select count(*) filter (coalesce(t.value = p.value, false)) hit, count(*) counted from t full join p on t.invoice_id = p.invoice_id and t.path = p.path) select hit, counted, cast(hit as double) / counted accuracy from s")
def _(spark, d):
    columns = ["vendor", "currency", "date", "items"]
    t = E.flatten(nested(W.invoices(spark, d), W.line_items(spark, d), "issue_date"), "invoice_id", columns)
    p = E.flatten(nested(W.predictions(spark, d), W.predicted_items(spark, d), "date"), "invoice_id", columns)
    return E.path_accuracy(t, p, "invoice_id").withColumnRenamed("right", "hit")


LETTERS = "list_distinct(list_filter(string_split(lower({0}), ''), lambda x: x <> ''))"
LIKE = "coalesce(cast(len(list_intersect({a}, {b})) as double) / len(list_distinct(list_concat({a}, {b}))), 0.0)"
NEAR = "1.0 - least(abs({1} - {0}) / greatest(abs({0}), 1.0), 1.0)"
FOLD = "lower(trim(coalesce({0}, '')))"
_LIKE = LIKE.format(a=LETTERS.format("x"), b=LETTERS.format("y"))


def _fields(names: str, prefix: str = "") -> list[str]:
    """Errors of text fields, as (element, folded truth x, folded prediction y)."""
    return [f"select invoice_id, cast(null as int) item_pos, '{prefix}{n}' element, {FOLD.format('t_' + n)} x, {FOLD.format('p_' + n)} y from records" for n in names.split()]


_TEXTS = [*_fields("name address city state postal_code email", "vendor_"), *_fields("invoice_id issue_date due_date payment_terms currency"), f"select invoice_id, cast(pos as int), 'line_item_description', {FOLD.format('t_description')}, {FOLD.format('p_description')} from record_items where in_t and in_p"]
_NUMBERS = [f"select invoice_id, cast(null as int) item_pos, '{n}' element, t_{n} x, p_{n} y from records" for n in ("subtotal", "tax_total", "discount_total", "grand_total")]
_NUMBERS += [f"select invoice_id, cast(pos as int), 'line_item_{n}', t_{n}, p_{n} from record_items where in_t and in_p" for n in ("quantity", "unit_price", "line_total")]
ERRORS = f"""texts as ({" union all ".join(_TEXTS)}), numbers as ({" union all ".join(_NUMBERS)}), sizes as (select invoice_id, count(*) filter (in_t) nt, count(*) filter (in_p) np from record_items group by 1),
errors as (select invoice_id, item_pos, element, case when y = '' then 'missing_field' else 'incorrect_value' end error, case when y = '' then 0.0::double else {_LIKE} end confidence from texts where y = '' or x <> y
union all select invoice_id, item_pos, element, case when y is null then 'missing_field' else 'incorrect_value' end, case when y is null then 0.0::double else {NEAR.format("x", "y")} end from numbers where y is null or abs(y - x) > 0.01
union all select invoice_id, null, 'grand_total', 'wrong_format', 0.0::double from records where abs(p_subtotal + p_tax_total - p_discount_total - p_grand_total) > 0.01
union all select invoice_id, null, 'line_items', 'misaligned_table', 0.0::double from sizes where nt <> np)"""


def errors(spark, d):
    return N.mine_errors(W.records(spark, d))


@query("m1_errors", f"with {ERRORS} select * from errors")
def _(spark, d):
    return errors(spark, d)


@query("a15_error_rollup", f"""with {ERRORS}, low as (select *, confidence < 0.5 l from errors), first as (select list({{'invoice_id': invoice_id, 'item_pos': item_pos, 'element': element, 'error': error}} order by invoice_id, item_pos nulls first, element, error) x from (select * from errors order by invoice_id, item_pos nulls first, element, error limit 100)),
r as (select 'all' as level, '' as name, count(*) n, count(*) filter (l) low from low union all select 'error', error, count(*), count(*) filter (l) from low group by error union all select 'element', element, count(*), count(*) filter (l) from low group by element union all select 'sample', cast(invoice_id as varchar), count(*), count(*) filter (l) from low group by invoice_id)
select r.*, case when level = 'all' then (select string_agg(e.invoice_id || ':' || coalesce(cast(e.item_pos as varchar), '-') || ':' || e.element || ':' || e.error, ' ') from (select unnest(x) e from first)) end examples from r""")
def _(spark, d):
    # one scan of the tables: the errors are few, and written once for both readings
    path = new_folder(spark, "errors")
    errors(spark, d).write.parquet(path)
    told = F.transform("examples", lambda e: F.concat_ws(":", e["invoice_id"].cast("string"), F.coalesce(e["item_pos"].cast("string"), F.lit("-")), e["element"], e["error"]))
    return M.error_rollup(spark.read.parquet(path)).withColumn("examples", F.array_join(told, " "))


@query("a15_hard_samples", f"with {ERRORS} select invoice_id, count(*) n from errors group by 1 having count(*) >= 3")
def _(spark, d):
    return M.hard_samples(errors(spark, d))


_FOLDED = lambda t, p: f"cast({FOLD.format(t)} = {FOLD.format(p)} as int)"
_SAME = lambda names: [_FOLDED(f"t_{n}", f"p_{n}") for n in names.split()]
_CLOSE = lambda n: f"cast(coalesce(abs(t_{n} - p_{n}) < 0.01, t_{n} is null and p_{n} is null) as int)"
_MONEY = [_CLOSE(n) for n in ("subtotal", "tax_total", "discount_total", "grand_total")]
_SHARE = lambda parts: f"cast({' + '.join(parts)} as double) / {len(parts)}"
BLOCKS = f"""blocks as (select invoice_id, {_SHARE(_SAME("name address city state postal_code email"))} vendor_block, {_SHARE(_SAME("client nation"))} client_info, {_SHARE(_SAME("invoice_id issue_date due_date payment_terms"))} invoice_metadata, {_SHARE([*_MONEY, *_SAME("currency")])} financial_summary from records)"""
CELLS = f"""agreed as (select invoice_id, count(*) filter (in_t) nt, count(*) filter (in_p) np, count(*) filter (in_t and in_p) nb, sum({_FOLDED("t_description", "p_description")} + {_CLOSE("quantity")} + {_CLOSE("unit_price")} + {_CLOSE("line_total")}) filter (in_t and in_p) ok from record_items group by 1)"""


@query("e1_blocks", f"with {BLOCKS} select * from blocks")
def _(spark, d):
    return N.block_accuracies(W.records(spark, d)).select("invoice_id", "vendor_block", "client_info", "invoice_metadata", "financial_summary")


@query("e4_documents_blocks", f"""with {BLOCKS}, {CELLS}, s as (select b.*, case when coalesce(nt, 0) = 0 and coalesce(np, 0) = 0 then 1.0 when coalesce(nt, 0) = 0 or coalesce(np, 0) = 0 then 0.0 else cast(nt = np as double) * 0.3::double + cast(ok as double) / (nb * 4) * 0.7::double end line_item_table from blocks b left join agreed using (invoice_id))
select invoice_id, cast(line_item_table as double) line_item_table, floor((vendor_block * 1.5 + client_info * 1.5 + invoice_metadata * 1.5 + financial_summary * 2.0 + line_item_table * 2.5) / 9 * 1000000000 + 0.5) score9 from s""")
def _(spark, d):
    return N.weighted_scores(W.records(spark, d)).select("invoice_id", "line_item_table", F.floor(F.col("score") * 1000000000 + 0.5).cast("double").alias("score9"))


_WORDS = lambda x: f"list_distinct(list_filter(regexp_split_to_array({FOLD.format(x)}, '\\s+'), lambda w: w <> ''))"
_COMMON = lambda t, p: f"cast(len(list_intersect({_WORDS(t)}, {_WORDS(p)})) as double) / greatest(len({_WORDS(t)}), 1)"
_ZERO = lambda n: f"cast(abs(coalesce(t_{n}, 0.0) - coalesce(p_{n}, 0.0)) < 0.01 as int)"


@query("e1_regions_of_blocks", f"""with x as (select *, concat_ws(' ', t_address || ',', t_city || ',', t_state, t_postal_code) t_place from records),
y as (select invoice_id, {_SHARE([*_SAME("name"), f"cast({_COMMON('t_place', 'p_address')} > 0.7 as int)", f"cast(coalesce(contains({FOLD.format('p_contact')}, lower(t_email)) or contains({FOLD.format('p_contact')}, lower(t_tax_id)), t_email is null and t_tax_id is null) as int)"])} vendor_block,
 {_SHARE(_SAME("invoice_id issue_date due_date client"))} client_invoice_info, {_SHARE([*(_ZERO(n) for n in ("subtotal", "tax_total", "discount_total", "grand_total")), f"cast({FOLD.format('t_payment_terms')} = {FOLD.format('p_payment_terms')} or {_COMMON('t_payment_terms', 'p_payment_terms')} > 0.7 as int)", *_SAME("currency")])} financial_summary from x)
select *, (vendor_block + client_invoice_info + financial_summary) / 3 accuracy from y""")
def _(spark, d):
    return N.region_accuracies(W.records(spark, d)).select("invoice_id", "vendor_block", "client_invoice_info", "financial_summary", "accuracy")


_STRIP = lambda x, keep: f"regexp_replace({FOLD.format(x)}, '[^{keep}]', '', 'g')"


def _leaf(field: str, t: str, p: str, kind: str, source: str = "records", where: str = "true") -> str:
    same = f"{FOLD.format(f'cast({t} as varchar)')} = {FOLD.format(f'cast({p} as varchar)')}"
    if kind == "number":
        same += f" or coalesce(abs({t} - {p}) < 0.01, false)"
    if kind == "date":
        same += f" or {_STRIP(t, '0-9')} = {_STRIP(p, '0-9')}"
    return f"select invoice_id, '{field}' field, '{kind}' kind, {same} matches from {source} where ({t} is not null or {p} is not null) and {where}"


LEAVES = " union all ".join([
    *(_leaf(n, f"t_{n}", f"p_{n}", "text") for n in ("name", "address", "city", "state", "postal_code", "email", "invoice_id", "payment_terms", "currency")), _leaf("country", "t_state", "cast(null as varchar)", "text"), _leaf("tax_id", "t_tax_id", "cast(null as varchar)", "text"), _leaf("contact", "cast(null as varchar)", "p_contact", "text"),
    _leaf("name", "t_client", "p_client", "text"), _leaf("nation", "t_nation", "p_nation", "text"), *(_leaf(n, f"t_{n}", f"p_{n}", "date") for n in ("issue_date", "due_date")), *(_leaf(n, f"t_{n}", f"p_{n}", "number") for n in ("subtotal", "tax_total", "discount_total", "grand_total")),
    _leaf("description", "t_description", "p_description", "text", "record_items"), *(_leaf(n, f"t_{n}", f"p_{n}", "number", "record_items") for n in ("quantity", "unit_price", "line_total")),
])


@query("e1_all_leaves", f"with leaf as ({LEAVES}) select invoice_id, count(*) filter (matches) hit, count(*) counted, cast(count(*) filter (matches) as double) / count(*) accuracy from leaf group by 1")
def _(spark, d):
    return N.leaf_accuracy(W.records(spark, d)).withColumnRenamed("right", "hit")


@query("e1_by_field", f"with leaf as ({LEAVES}) select field, kind, count(*) filter (matches) hit, count(*) counted, cast(count(*) filter (matches) as double) / count(*) accuracy from leaf group by 1, 2")
def _(spark, d):
    return N.accuracy_by_field(W.records(spark, d)).withColumnRenamed("right", "hit")


@query("t1_synthesis_plan", f"with {ERRORS} select element, n, case when contains(element, 'line_items') then 'complex_table' when contains(element, 'currency') then 'multi_currency' else 'unusual_layout' end kind, least(n * 10, 100) samples from (select element, count(*) n from errors group by 1 order by n desc, element limit 5)")
def _(spark, d):
    return M.synthesis_plan(errors(spark, d))


def classed(spark, d):
    n = lambda df, c: df.groupBy("invoice_id").agg(F.count("*").alias(c))
    df = paired(spark, d).join(n(W.line_items(spark, d), "t_rows"), "invoice_id", "left").join(n(W.predicted_items(spark, d), "p_rows"), "invoice_id", "left")
    return M.classify_errors(df)


CLASSED = f"""{PAIRS}, classed as (select invoice_id, case when abs(coalesce(cast(p_total as double), 0) - coalesce(cast(t_total as double), 0)) > 0.02 * greatest(abs(coalesce(cast(t_total as double), 0)), 1) then 'TOTAL_MISMATCH'
 when coalesce(np, 0) <> coalesce(nt, 0) then 'TABLE_STRUCTURE_ERROR' when lower(p_currency) <> lower(t_currency) then 'CURRENCY_ERROR' when p_date <> t_date then 'DATE_ERROR' when lower(p_vendor) <> lower(t_vendor) then 'VENDOR_INFO_ERROR' else 'OTHER' end error_class
 from pairs left join (select invoice_id, count(*) nt from line_items group by 1) using (invoice_id) left join (select invoice_id, count(*) np from predicted_items group by 1) using (invoice_id))"""
SEVERE = "case error_class when 'TOTAL_MISMATCH' then 5 when 'TABLE_STRUCTURE_ERROR' then 4 when 'CURRENCY_ERROR' then 3 when 'DATE_ERROR' then 2 when 'VENDOR_INFO_ERROR' then 2 else 1 end"


@query("m2_error_class", f"with {CLASSED} select invoice_id, error_class, {SEVERE} severity from classed")
def _(spark, d):
    return classed(spark, d).select("invoice_id", "error_class", "severity")


@query("a20_error_frequency", f"with {CLASSED} select error_class, {SEVERE} severity, count(*) n from classed group by 1, 2")
def _(spark, d):
    return classed(spark, d).groupBy("error_class", "severity").agg(F.count("*").alias("n"))


@query("m5_correction_type", f"""with {PAIRS}, k as (select invoice_id, case when coalesce(cast(abs(t_total - p_total) as double) > 0.01, false) then 'arithmetic' when p_vendor is null and t_vendor is not null then 'field_missing' when p_vendor is distinct from t_vendor then 'field_incorrect' else 'other' end kind from pairs)
select *, case kind when 'arithmetic' then 'hard' when 'field_incorrect' then 'easy' else 'medium' end difficulty from k""")
def _(spark, d):
    off = F.coalesce(F.abs(F.col("t_total") - F.col("p_total")).cast("double") > 0.01, F.lit(False))
    return M.correction_type(paired(spark, d), "p_vendor", "t_vendor", off).select("invoice_id", "kind", "difficulty")


def candidates(spark, d):
    """Three readings of each vendor: truth, prediction, and a faulty one."""
    t = W.invoices(spark, d).select("invoice_id", F.lit(1).alias("pos"), F.col("vendor").alias("value"), F.lit(0.6).alias("confidence"))
    p = W.predictions(spark, d).select("invoice_id", F.lit(2), F.col("vendor"), F.lit(0.7))
    x = W.invoices(spark, d).where("invoice_id % 4 < 2").select("invoice_id", F.lit(3), F.when(F.col("invoice_id") % 4 == 0, F.lit("Other")).otherwise(F.concat(F.lit(" $"), F.col("invoice_id").cast("string"))), (F.col("invoice_id") % 10 / F.lit(10.0)))
    return t.unionAll(p).unionAll(x)


@query("a8_vote", """
with c as (select invoice_id, 1 pos, vendor as value, 0.6 confidence from invoices union all select invoice_id, 2, vendor, 0.7 from predictions union all select invoice_id, 3, case when invoice_id % 4 = 0 then 'Other' else ' $' || invoice_id end, cast(invoice_id % 10 as decimal(18,6)) / 10 from invoices where invoice_id % 4 < 2),
n as (select *, coalesce(cast(try_cast(replace(replace(trim(value), ',', ''), '$', '') as double) as varchar), lower(trim(value))) v from c),
f as (select invoice_id, v, sum(cast(confidence as decimal(18,6))) s, count(*) k, min(pos) first, arg_min(value, pos) as value from n group by 1, 2),
r as (select *, row_number() over (partition by invoice_id order by (v is null), s desc, first) rn, sum(k) over (partition by invoice_id) n from f)
select invoice_id, value, case when v is null then 0.0 when n = 1 then cast(s as double) else least(1.0, least(1.0, cast(s as double) / n) + case when k > 1 then least(0.1, k * 0.02) else 0.0 end) end confidence, cast(n as bigint) candidates, case when v is null then 0 else k end agreeing from r where rn = 1""")
def _(spark, d):
    return C.vote(candidates(spark, d), "invoice_id").withColumn("candidates", F.col("candidates").cast("long"))


@query("a9_total_vote", r"""
with m as (select invoice_id, region_id pos, confidence, regexp_extract(text, '(?i)(?:total|grand\s+total|amount\s+due|balance\s+due)[\s:]*\$?\s*([\d,]+\.?\d*)', 1) a, regexp_extract(text, '^\$?\s*([\d,]+\.?\d*)\s*$', 1) b from regions),
c as (select invoice_id, pos, confidence, cast(cast(try_cast(replace(case when a <> '' then a else b end, ',', '') as double) as decimal(18,2)) as varchar) as value from m where try_cast(replace(case when a <> '' then a else b end, ',', '') as double) > 0),
f as (select invoice_id, value, sum(cast(confidence as decimal(18,6))) s, count(*) k, min(pos) first from c group by 1, 2), r as (select *, row_number() over (partition by invoice_id order by s desc, first) rn, sum(k) over (partition by invoice_id) n from f)
select invoice_id, value, case when n = 1 then cast(s as double) else least(1.0, least(1.0, cast(s as double) / n) + case when k > 1 then least(0.1, k * 0.02) else 0.0 end) end confidence from r where rn = 1""")
def _(spark, d):
    return C.vote_total(W.regions(spark, d), "invoice_id").select("invoice_id", "value", "confidence")


@query("a11_section_confidence", "with p as (select invoice_id, case when vendor is not null then 0.9 end a, case when n_items > 0 then 0.8 end b, case when total is not null then confidence end c from declared) select invoice_id, case when a is null and b is null and c is null then 0.0 else (coalesce(a, 0.0) + coalesce(b, 0.0) + coalesce(c, 0.0)) / (cast(a is not null as int) + cast(b is not null as int) + cast(c is not null as int)) end overall from (select invoice_id, cast(a as double) a, cast(b as double) b, c from p)")
def _(spark, d):
    parts = [F.when(F.col("vendor").isNotNull(), F.lit(0.9)), F.when(F.col("n_items") > 0, F.lit(0.8)), F.when(F.col("total").isNotNull(), F.col("confidence"))]
    return W.declared(spark, d).select("invoice_id", C.mean_present(parts).alias("overall"))


@query("a12_document_confidence", """
with x as (select invoice_id, vendor, client, issue_date, n_items, coalesce(cast(abs(total - (coalesce(subtotal, 0) + coalesce(tax, 0) - coalesce(discount, 0))) as double), 0.0) diff, (select count(*) from line_items l where l.invoice_id = d.invoice_id and l.qty > 10) valid from declared d)
select invoice_id, cast(vendor is not null as double) * 0.1::double + (0.3::double + 0.3::double + 0.2::double) * 0.2::double + (case when n_items = 0 then 0.0::double when valid = 0 then 0.7::double else cast(valid as double) / n_items * 0.5::double + 0.5::double end) * 0.4::double
 + (case when not diff > 0.01 then 0.9::double else greatest(0.1::double, 0.5::double - least(diff / 100, 0.4::double)) end) * 0.3::double document_confidence from x""")
def _(spark, d):
    valid = W.line_items(spark, d).groupBy("invoice_id").agg(F.count_if(F.col("qty") > 10).alias("valid_items"))
    df = V.validate_arithmetic(W.declared(spark, d), "quadrant").join(valid, "invoice_id", "left").withColumn("valid_items", F.coalesce("valid_items", F.lit(0)))
    return C.document_confidence(df).select("invoice_id", "document_confidence")


@query("a13_field_confidence", "select invoice_id, case when vendor is null then 0.0 when vendor = '' then 0.3 else 0.9 end::double vendor, case when tax is null then 0.0 when tax = 0 then 0.3 else 0.9 end::double tax from declared")
def _(spark, d):
    return W.declared(spark, d).select("invoice_id", C.field_confidence(F.col("vendor")).alias("vendor"), C.field_confidence(F.col("tax")).alias("tax"))


@query("a14_presence_confidence", "select invoice_id, (0.9::double + 0.85::double + case when total is not null then 0.95::double else 0 end + case when vendor is not null then 0.8::double else 0 end + case when n_items > 0 then 0.7::double else 0 end) / (2 + cast(vendor is not null as int) + cast(total is not null as int) + cast(n_items > 0 as int)) overall from declared")
def _(spark, d):
    present = {"invoice_number": F.col("invoice_id").isNotNull(), "vendor": F.col("vendor").isNotNull(), "total": F.col("total").isNotNull(), "line_items": F.col("n_items") > 0, "date": F.col("issue_date").isNotNull()}
    return C.presence_confidence(W.declared(spark, d), present).select("invoice_id", "overall")


@query("a30_calibration", """
with x as (select case when confidence >= 0.95 then '95-100' when confidence >= 0.90 then '90-95' when confidence >= 0.80 then '80-90' else '<80' end band, coalesce(abs(total - (coalesce(subtotal, 0) + coalesce(tax, 0) - coalesce(discount, 0))) <= 0.01, true) ok from declared)
select band, count(*) n, cast(count(*) as double) / (select count(*) from x) share, cast(count(*) filter (ok) as double) / count(*) accuracy from x group by 1""")
def _(spark, d):
    return C.calibration(V.validate_arithmetic(W.declared(spark, d), "quadrant").withColumn("correct", F.col("math_ok")))


@query("d9_low_confidence_samples", "select invoice_id, avg6 from (select d.invoice_id, coalesce(floor(avg(r.confidence) * 1000000 + 0.5), 0) avg6 from declared d left join regions r using (invoice_id) group by 1) where avg6 < 800000")
def _(spark, d):
    mean = W.regions(spark, d).groupBy("invoice_id").agg((F.floor(F.avg("confidence") * 1000000 + 0.5) / 1000000).alias("confidence"))
    out = M.low_confidence(W.declared(spark, d).select("invoice_id").join(mean, "invoice_id", "left"), 0.8)
    return out.select("invoice_id", F.floor(F.col("confidence") * 1000000 + 0.5).cast("double").alias("avg6"))
