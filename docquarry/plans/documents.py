"""Queries: layout and extraction over printed invoices."""

from pyspark.sql import functions as F

from docquarry.operators import confidence as C
from docquarry.operators import extract as T
from docquarry.operators import layout as L
from docquarry.operators import validate as V
from docquarry.plans import views as W
from docquarry.registry import query


def found(pattern: str, where: str = "true", pick: str = "arg_min", read: str = "{}") -> str:
    """The value of the first or last line that a pattern finds, as SQL written beside the operator's profile."""
    value = f"regexp_extract(text, '{pattern}', 1)"
    return f"{pick}({read.format(value)}, line_no) filter ({value} <> '' and {where})"


LAST = "arg_max"
MONEY = "try_cast(replace({}, ',', '') as double)"
#: The printed documents have a line of each of these, so the formats' patterns come out as:
LINES_OF = "l as (select *, max(line_no) over (partition by invoice_id) as last from {0})"


@query("x1_fields_heuristic", rf"""with {LINES_OF.format('ocr_lines')} select invoice_id, {found(r'(?i)(?:invoice|inv)\s*#?\s*:?\s*([A-Z0-9\-]+)', pick=LAST)} invoice_number, coalesce(arg_min(coalesce(nullif(regexp_extract(text, '(\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}})', 1), ''), nullif(regexp_extract(text, '(\d{{4}}-\d{{2}}-\d{{2}})', 1), '')), line_no) filter (regexp_matches(text, '\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{4}}-\d{{2}}-\d{{2}}')), null) as date,
 {found(r'(?i)total\s*:?\s*\$?\s*([\d,]+\.?\d*)', pick=LAST, read=MONEY)} total, {found(r'(?i)subtotal\s*:?\s*\$?\s*([\d,]+\.?\d*)', pick=LAST, read=MONEY)} subtotal, {found(r'(?i)tax\s*:?\s*\$?\s*([\d,]+\.?\d*)', pick=LAST, read=MONEY)} tax,
 arg_min(trim(text), line_no) filter (line_no <= 10 and length(trim(text)) > 3 and not regexp_matches(lower(text), 'invoice|bill to|ship to|date|page')) vendor from l group by 1""")
def _(spark, d):
    return T.extract_fields(W.ocr_lines(spark, d), "heuristic")


@query("x1_fields_keyword_line", rf"""with street as (select invoice_id, min(line_no) s from receipt_lines where line_no <= 15 and regexp_matches(text, '\d') and regexp_matches(lower(text), 'street|st|ave|blvd|road|rd') group by 1),
below as (select r.*, s from receipt_lines r join street using (invoice_id) where line_no between s and s + 2), ends as (select invoice_id, min(line_no) e from below where trim(text) = '' group by 1),
a as (select invoice_id, string_agg(trim(text), chr(10) order by line_no) address from below left join ends using (invoice_id) where line_no < coalesce(e, 1000000) group by 1),
f as (select invoice_id, {found(r'(?i)invoice #[:\s]*(\S+)')} invoice_number, {found(r'(?i)date[:\s]+(\S+)')} date, {found(r'(?i)vendor[:\s]+(.+)', 'line_no <= 10')} vendor, {found(r'(?i)^subtotal[:\s]*\$?([\d,]+\.?\d*)', read=MONEY)} subtotal, {found(r'(?i)^tax[:\s]*\$?([\d,]+\.?\d*)', read=MONEY)} tax, {found(r'(?i)^total[:\s]*\$?([\d,]+\.?\d*)', read=MONEY)} total, {found(r'(\d+\.?\d*)%', "contains(lower(text), 'tax')", LAST, MONEY)} / 100 tax_rate from receipt_lines group by 1)
select f.*, address from f left join a using (invoice_id)""")
def _(spark, d):
    return T.pipeline_fields(W.receipt_lines(spark, d))


CARD = r"(?i)\b(visa|mastercard|amex|discover)\b"


@query("x1_fields_store_receipt", rf"""with {LINES_OF.format('receipt_lines')}, f as (select invoice_id, coalesce({found(r'(?i)^\s*(.*\bwalmart\b.*?)\s*$', 'line_no <= 6')}, arg_min(trim(text), line_no) filter (trim(text) <> '')) vendor, {found(r'(?i)store\s*#\s*(\d+)')} store_number, min(text) filter (line_no = 7) stamp,
 {found(CARD, 'line_no > last - 10', LAST, 'upper({})')} card, {found(r'(?i)\b(cash)\b', 'line_no > last - 10', LAST, 'upper({})')} cash, {found(r'(\d{4})\b', f"line_no > last - 10 and regexp_matches(text, '{CARD}')", LAST)} digits,
 {found(r'(?i)subtotal.*?([\d,]+\.?\d*)', 'line_no > last - 20', LAST, MONEY)} subtotal, {found(r'(?i)\b(?:sales tax|tax)\b.*?([\d,]+\.?\d*)', 'line_no > last - 20', LAST, MONEY)} tax, {found(r'(?i)\b(?:grand total|total|amount due|amt due)\b.*?([\d,]+\.?\d*)', "line_no > last - 20 and not contains(lower(text), 'subtotal')", LAST, MONEY)} total from l group by 1)
select f.invoice_id, vendor, store_number, cast(issue_date as varchar) date, trim(regexp_extract(stamp, '(\d{{2}}:\d{{2}}( PM)?)$', 1)) as "time", coalesce(card, cash) as "method", case when card is not null then digits end last4, f.subtotal, f.tax, f.total from f join receipts r using (invoice_id)""")
def _(spark, d):
    return T.store_receipts(W.receipt_pages(spark, d))


@query("x1_fields_simple", rf"with {LINES_OF.format('ocr_lines')} select invoice_id, min(text) filter (line_no = 1 and text <> '') vendor, {found(r'(?i)total.*?(\d+\.\d{2})\s*$', 'line_no > last - 30', LAST, MONEY)} total from l group by 1")
def _(spark, d):
    return T.extract_fields(W.ocr_lines(spark, d), "simple")


@query("x1_fields_receipt", rf"""with {LINES_OF.format('receipt_lines')} select invoice_id, arg_min(trim(text), line_no) filter (line_no <= 5 and length(trim(text)) > 2) merchant, {found(r'(?i)^(.*\d+\s+[a-z\s]+(?:street|st|avenue|ave|road|rd|boulevard|blvd).*)$', pick=LAST)} address, max(text) filter (line_no = 6) phone,
 case invoice_id % 3 when 0 then regexp_extract(max(text) filter (line_no = 7), '^(\S+)', 1) when 1 then null else regexp_extract(max(text) filter (line_no = 7), '^(\S+)', 1) end date, {found(r'(\d{1,2}:\d{2}\s*(?:PM)?)', pick=LAST)} as "time", cast(invoice_id as varchar) receipt_no, 'C' || invoice_id % 7 cashier, 'R' || invoice_id % 5 register,
 case when invoice_id % 4 = 0 then 'CASH' else 'VISA' end as "method", {found(r'(\d+\.\d{2})', "line_no > floor(last * 8 / 10.0) and regexp_matches(lower(text), 'tendered|cash')", LAST, MONEY)} tendered, case when invoice_id % 4 = 0 then 5.0 else 0.0 end::double change,
 {found(r'(?i)^\s*(?:grand total|total|amount)\b\D*([\d,]+\.?\d*)', pick=LAST, read=MONEY)} total from l group by 1""")
def _(spark, d):
    return T.extract_fields(W.receipt_pages(spark, d), "receipt")


@query("x1_fields_validator_text", r"""with m as (select invoice_id, line_no, list_filter(regexp_split_to_array(trim(replace(translate(text, '=$', '  '), ',', '')), '\s+'), lambda w: w <> '') w from receipt_lines where regexp_matches(lower(text), 'qty|unit|total|x|item')),
n as (select *, list_filter(w, lambda x: regexp_matches(x, '[\d.]')) n from m), q as (select invoice_id, cast(trunc(try_cast(n[1] as double)) as bigint) qty, try_cast(n[2] as double) price from n),
s as (select invoice_id, count(*) n_items, sum(cast(round(qty * cast(price as decimal(18,4)), 2) as decimal(18,2))) subtotal from q where qty is not null and price is not null group by 1),
h as (select r.invoice_id, min(text) filter (line_no = 1) vendor, any_value(n_items) n_items, any_value(subtotal) subtotal from receipt_lines r left join s using (invoice_id) group by 1)
select invoice_id, vendor, coalesce(n_items, 0) n_items, cast(coalesce(subtotal, 0) as double) subtotal, cast(round(cast(coalesce(subtotal, 0) as decimal(18,2)) * 0.10, 2) as double) tax, cast(coalesce(subtotal, 0) + round(cast(coalesce(subtotal, 0) as decimal(18,2)) * 0.10, 2) as double) grand_total from h""")
def _(spark, d):
    out = T.validator_text(W.receipt_lines(spark, d))
    return out.select("invoice_id", "vendor", "n_items", *(F.col(c).cast("double").alias(c) for c in ("subtotal", "tax", "grand_total")))


@query("x1_fields_etl", r"""
with t as (select invoice_id, string_agg(text, ' ' order by line_no) text from ocr_lines group by 1),
a as (select invoice_id, text, list_reverse_sort(list_filter(list_transform(list_concat(regexp_extract_all(text, '(?i)(?:total|amount due|balance)[\s:]*\$?[\s]*([\d,]+\.?\d*)', 1), regexp_extract_all(text, '\$[\s]*([\d,]+\.?\d*)', 1)), lambda x: try_cast(replace(x, ',', '') as double)), lambda x: x is not null)) n, nullif(regexp_extract(text, '([A-Z]{3})', 1), '') code from t)
select invoice_id, trim(coalesce(nullif(regexp_extract(text, '(?i)(?:invoice|inv)[\s#:]*([A-Z0-9\-]+)', 1), ''), nullif(regexp_extract(text, '(?i)invoice[\s#:]*#?[\s]*([0-9A-Z\-]+)', 1), ''), nullif(regexp_extract(text, '(?i)#[\s]*([0-9A-Z\-]{6,})', 1), ''))) invoice_number,
 trim(coalesce(nullif(regexp_extract(text, '(?i)(?:from|vendor|supplier)[\s:]+([A-Z][A-Za-z\s&]+)', 1), ''), nullif(regexp_extract(text, '(?i)^([A-Z][A-Za-z\s&]{3,30})\s+(?:invoice|bill)', 1), ''))) vendor,
 trim(coalesce(nullif(regexp_extract(text, '(?i)(?:date|invoice date)[\s:]+(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})', 1), ''), nullif(regexp_extract(text, '(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})', 1), ''))) date,
 n[1] total, case when n[2] < n[1] * 0.9::double then n[2] end subtotal, len(n) amounts, case when code is null then 'USD' when code in ('USD', 'EUR', 'GBP', 'CAD', 'AUD') then code end currency from a""")
def _(spark, d):
    return T.extract_text(T.joined_text(W.ocr_lines(spark, d)))


@query("x1_fields_regions_text", r"""
with l as (select *, regexp_replace(text, '^\s+|\s+$', '', 'g') line, row_number() over (partition by invoice_id order by line_no) k from ocr_lines),
v as (select invoice_id, arg_min(name, k) vendor from (select invoice_id, k, case when regexp_matches(line, '(?i)^[A-Z][A-Z0-9\s&\-.,]+(INC|LLC|LTD|CORP|CO|COMPANY)') then trim(regexp_extract(line, '(?i)^([A-Z][A-Z0-9\s&\-.,]+(INC|LLC|LTD|CORP|CO|COMPANY))', 1))
 when length(line) > 3 and not (contains(lower(line), 'invoice') or contains(lower(line), 'bill to') or contains(lower(line), 'ship to') or contains(lower(line), 'date') or contains(lower(line), 'page')) then line end name from l where k <= 15) where name is not null group by 1),
t as (select invoice_id, string_agg(text, ' ' order by line_no) text from ocr_lines group by 1),
a as (select invoice_id, text, list_reverse_sort(list_filter(list_transform(regexp_extract_all(text, '\$?\d{1,3}(,\d{3})*(\.\d{2})?'), lambda x: try_cast(replace(replace(x, '$', ''), ',', '') as double)), lambda x: x > 0)) n, regexp_extract_all(text, '\d{4}[-/]\d{2}[-/]\d{2}|\d{2}[-/]\d{2}[-/]\d{4}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}') d from t)
select invoice_id, nullif(regexp_extract(text, '(?i)(invoice|inv)[\s#:]*([A-Z0-9\-]+)', 2), '') invoice_number, d[1] date, d[2] due_date, coalesce(nullif(regexp_extract(text, '\b(USD|EUR|GBP|CAD|JPY|CNY|AUD|CHF|INR)\b', 1), ''), 'USD') currency,
 coalesce(try_cast(replace(regexp_extract(text, '(?i)(total|grand\s+total|amount\s+due|balance\s+due)[\s:]*\$?\s*([\d,]+\.?\d*)', 2), ',', '') as double), n[1]) total, try_cast(replace(regexp_extract(text, '(?i)subtotal[\s:]*\$?\s*([\d,]+\.?\d*)', 1), ',', '') as double) subtotal,
 try_cast(replace(regexp_extract(text, '(?i)(tax|sales\s+tax|vat)[\s:]*\$?\s*([\d,]+\.?\d*)', 2), ',', '') as double) tax, vendor, n[1:10] amounts from a left join v using (invoice_id)""")
def _(spark, d):
    return T.extract_region_text(W.ocr_lines(spark, d))


SPECS = [("invoice_number", "header", r"INV-(\d+)"), ("date", "header", r"(\d{4}-\d{2}-\d{2})"), ("total", "footer", r"^Total (\S+)$"), ("quantity", "table", r"^Qty (\d+)$")]
ZONED = "zoned as (select *, case when y < ph * 0.3::double then 'header' when y > ph * 0.7::double then 'footer' else 'table' end as zone from (select *, max(y + h) over (partition by invoice_id) ph from regions))"


@query("j6_fields_by_schema", f"""with {ZONED}, s as (select * from (values ('invoice_number', 'header', 'INV-(\\d+)'), ('date', 'header', '(\\d{{4}}-\\d{{2}}-\\d{{2}})'), ('total', 'footer', '^Total (\\S+)$'), ('quantity', 'table', '^Qty (\\d+)$')) t(field, zone, pattern)),
m as (select invoice_id, field, region_id, confidence, case field when 'invoice_number' then regexp_extract(text, 'INV-(\\d+)', 1) when 'date' then regexp_extract(text, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) when 'total' then regexp_extract(text, '^Total (\\S+)$', 1) else regexp_extract(text, '^Qty (\\d+)$', 1) end v from zoned join s using (zone))
select invoice_id, field, arg_min(v, region_id) as value, arg_min(confidence, region_id) confidence from m where v <> '' group by 1, 2""")
def _(spark, d):
    return L.fields_by_schema(W.regions(spark, d), spark.createDataFrame(SPECS, "field string, zone string, pattern string"))


@query("x3_extract_by_schema", f"""with {ZONED}, m as (select invoice_id, region_id, regexp_extract(text, '^Total (\\S+)$', 1) v from zoned where zone = 'footer') select invoice_id, arg_min(v, region_id) total from m where v <> '' group by 1""")
def _(spark, d):
    found = L.fields_by_schema(W.regions(spark, d), spark.createDataFrame(SPECS[2:3], "field string, zone string, pattern string"))
    return found.select("invoice_id", F.col("value").alias("total"))


@query("w1_rows_by_mean")
def _(spark, d):
    return L.rows_by_mean(W.region_pages(spark, d))


GAPPED = "gapped as (select *, sum(n) over (partition by invoice_id order by y, region_id) as row_ from (select *, coalesce(cast(abs(y - lag(y) over (partition by invoice_id order by y, region_id)) >= 12 as int), 0) n from regions where trim(text) <> ''))"


@query("w2_rows_by_gap", f"with {GAPPED} select invoice_id, region_id, cast(row_ as bigint) as \"row\" from gapped")
def _(spark, d):
    return L.rows_by_gap(W.regions(spark, d)).select("invoice_id", "region_id", "row")


@query("w3_rows_by_bucket", "select invoice_id, cast(round_even((y + h / 2.0::double) / 10, 0) * 10 as int) as \"row\", count(*) n from regions group by 1, 2")
def _(spark, d):
    return L.rows_by_bucket(W.regions(spark, d)).groupBy("invoice_id", "row").agg(F.count("*").alias("n"))


@query("w4_reading_order", "select invoice_id, region_id, row_number() over (partition by invoice_id order by y, x, region_id) place from regions")
def _(spark, d):
    return L.reading_order(W.regions(spark, d)).select("invoice_id", "region_id", F.col("place").cast("long").alias("place"))


@query("w5_zones", f"with {ZONED} select invoice_id, region_id, zone from zoned")
def _(spark, d):
    return L.zones(W.regions(spark, d)).select("invoice_id", "region_id", "zone")


#: The numbers of a page, the first of them or all ({1}), and whether a region's centre is near one of them.
PLACED = r"""p as (select *, max(x + w) over (partition by invoice_id) pw, max(y + h) over (partition by invoice_id) ph, x + w / 2.0::double cx, y + h / 2.0::double cy, regexp_matches(text, '^[$€£¥]?\s*-?[\d.,]+%?$') num from {0}),
firsts as (select invoice_id, list({{'x': cx, 'y': cy}} order by y, x, region_id){1} f, min(y) top, max(y + h) low from p where num group by 1),
q as (select p.*, top, low, coalesce(len(list_filter(f, lambda n: (n.x - cx) * (n.x - cx) + (n.y - cy) * (n.y - cy) < 2500)) > 0, false) near from p left join firsts using (invoice_id))"""
#: Regions whose cells hold bare numbers.
BARE = "(select * replace (regexp_replace(text, '^(Qty|Unit|Total) ', '') as text) from regions)"


def without_label(text):
    """A text without the label that ``BARE`` takes off; found by its letters, as a pattern takes longer than the rest of a cell."""
    return F.when(F.startswith(text, F.lit("Qty ")), F.substring(text, 5, 2**31 - 1)).when(F.startswith(text, F.lit("Unit ")), F.substring(text, 6, 2**31 - 1)).when(F.startswith(text, F.lit("Total ")), F.substring(text, 7, 2**31 - 1)).otherwise(text)


def bare(spark, d):
    return W.region_pages(spark, d, without_label)


for _name, _source, _read, _first in (("w6_quadrants", "regions", W.region_pages, L.FIRST_NUMBERS), ("w6_quadrants_of_numbers", BARE, bare, None)):

    @query(_name, f"""with {PLACED.format(_source, f"[1:{_first}]" if _first else "")}
select invoice_id, region_id, case when cx < pw * 0.5::double and cy < ph * 0.3::double then 'vendor' when cx > pw * 0.5::double or regexp_matches(lower(text), 'invoice|bill to|client|customer|date|due') then 'client' when cy between top and low and near then 'line_items'
 when regexp_matches(lower(text), 'tax|vat|gst|discount|subtotal') then 'tax' when cx > pw * 0.6::double and cy > ph * 0.7::double or contains(lower(text), 'total') then 'totals' end part from q""")
    def _(spark, d, read=_read, first=_first):
        return L.quadrants(read(spark, d), first).select("invoice_id", "region_id", "part")


BOXES = f"{ZONED}, boxes as (select invoice_id, zone, min(x) x1, min(y) y1, max(x + w) x2, max(y + h) y2, count(*) n from zoned group by 1, 2)"


@query("w15_extents", f"with {BOXES} select * from boxes")
def _(spark, d):
    return L.extents(L.zones(W.regions(spark, d)), "invoice_id", "zone")


@query("w7_receipt_thirds", "select invoice_id, line_no, case when i < floor(n / 3.0) then 'header' when i >= floor(n * 8 / 10.0) then 'footer' else 'middle' end part from (select *, count(*) over (partition by invoice_id) n, row_number() over (partition by invoice_id order by line_no) - 1 i from ocr_lines)")
def _(spark, d):
    return L.thirds(W.ocr_lines(spark, d)).select("invoice_id", "line_no", "part")


@query("w9_first_and_last_match", "select invoice_id, arg_min(text, line_no) filter (contains(lower(text), 'total')) first_total, arg_max(text, line_no) filter (contains(lower(text), 'total')) last_total from ocr_lines group by 1")
def _(spark, d):
    both = (T.Field("first_total", (r"(?i)(.*total.*)",)), T.Field("last_total", (r"(?i)(.*total.*)",), "last"))
    return T.extract_fields(W.ocr_lines(spark, d), both)


@query("w10_bottom_up", "with l as (select *, max(line_no) over (partition by invoice_id) as last from ocr_lines) select invoice_id, arg_max(text, line_no) filter (line_no > last - 3 and starts_with(text, 'Subtotal')) subtotal from l group by 1")
def _(spark, d):
    return T.extract_fields(W.ocr_lines(spark, d), (T.Field("subtotal", (r"^(Subtotal.*)$",), "last", tail=3),))


SECTION = """section as (select * from (select *, min(line_no) filter (trim(text) = '' or regexp_matches(lower(text), 'subtotal')) over (partition by invoice_id) e from (select *, min(line_no) filter (contains(lower(text), 'date')) over (partition by invoice_id) + 1 s from ocr_lines) where line_no > s) where line_no <= s + 20 and line_no < coalesce(e, line_no + 1))"""


def item_section(spark, d):
    lines = W.ocr_lines(spark, d)
    return L.section(lines.where("text <> '' or line_no > 4"), "date", "subtotal")


SECTION = SECTION.replace("+ 1 s from ocr_lines)", "s from ocr_lines where text <> '' or line_no > 4)")


@query("w17_table_section", f"with {SECTION} select invoice_id, line_no from section")
def _(spark, d):
    return item_section(spark, d).select("invoice_id", "line_no")


NUMBERS = r"list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda x: try_cast(regexp_replace(x, '[$,]', '', 'g') as double)), lambda x: x is not null)"


@query("x2_items_text_section", f"with {SECTION}, n as (select invoice_id, line_no, {NUMBERS} n from section) select invoice_id, row_number() over (partition by invoice_id order by line_no) pos, n[1] qty, n[2] unit_price, case when len(n) >= 3 then n[3] else n[1] * n[2] end line_total from n where len(n) >= 2")
def _(spark, d):
    return T.items_of_section(item_section(spark, d)).withColumn("pos", F.col("pos").cast("long"))


@query("x2_items_delimited", r"with p as (select invoice_id, line_no, list_filter(regexp_split_to_array(text, '\s*\|\s*|\t+|\s{2,}'), lambda x: trim(x) <> '') p from ocr_lines) select invoice_id, line_no, p[1] description, try_cast(regexp_extract(p[2], '(-?[\d.]+)', 1) as double) qty, try_cast(regexp_extract(p[3], '(-?[\d.]+)', 1) as double) unit_price, try_cast(regexp_extract(p[-1], '(-?[\d.]+)', 1) as double) line_total from p where len(p) >= 3")
def _(spark, d):
    return T.items_delimited(W.ocr_lines(spark, d))


@query("x2_items_priced_line", r"select invoice_id, line_no, trim(regexp_replace(text, '\s*\$?\d+\.\d{2}\s*$', '')) description, cast(regexp_extract(text, '(\d+\.\d{2})\s*$', 1) as double) line_total from ocr_lines where regexp_extract(text, '(\d+\.\d{2})\s*$', 1) <> ''")
def _(spark, d):
    return T.items_priced(W.ocr_lines(spark, d))


@query("x2_items_gap_rows", f"""with {GAPPED.replace("from regions", "from (select * replace (regexp_replace(text, '^(Qty|Unit|Total) ', '') as text) from regions)")},
c as (select invoice_id, row_, text, x, region_id, confidence, try_cast(regexp_replace(text, '[$,]', '', 'g') as double) num from gapped),
g as (select invoice_id, row_, list(num order by x, region_id) filter (num is not null) n, coalesce(string_agg(text, ' ' order by x, region_id) filter (num is null), '') description, min(confidence) confidence from c group by 1, 2 having count(*) >= 2)
select invoice_id, cast(row_ as bigint) as "row", description, case when len(n) >= 2 and n[1] < 1000 then n[1] else 1.0 end qty, coalesce(case when len(n) >= 2 then n[-2] else n[1] end, 0.0) unit_price, coalesce(n[-1], 0.0) line_total, confidence from g where description <> ''""")
def _(spark, d):
    return T.items_of_rows(L.cells_by_gap(bare(spark, d)))


@query("x2_items_bucket_rows", """with r as (select * replace (regexp_replace(text, '^(Qty|Unit|Total) ', '') as text), cast(round_even((y + h / 2.0::double) / 10, 0) * 10 as int) row_ from regions), c as (select *, try_cast(regexp_replace(text, '[$,]', '', 'g') as double) num from r),
g as (select invoice_id, row_, list(num order by x, region_id) filter (num is not null) n, coalesce(string_agg(text, ' ' order by x, region_id) filter (num is null), '') description, min(confidence) confidence from c group by 1, 2 having count(*) >= 2)
select invoice_id, row_ as "row", description, case when len(n) >= 2 and n[1] < 1000 then n[1] else 1.0 end qty, coalesce(case when len(n) >= 2 then n[-2] else n[1] end, 0.0) unit_price, coalesce(n[-1], 0.0) line_total, confidence from g where description <> ''""")
def _(spark, d):
    plain = W.regions(spark, d).withColumn("text", F.regexp_replace("text", "^(Qty|Unit|Total) ", ""))
    return T.items_of_rows(L.rows_by_bucket(plain))


#: Overlap of each region with the box of each zone of its page, the boxes being one row of a page.
SHARES = """{0}, held as materialized (select invoice_id, list({{'zone': zone, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} order by zone) b from boxes group by 1),
met as (select r.*, unnest(b) z from zoned r join held using (invoice_id)),
o as (select *, greatest(least(x + w, z.x2) - greatest(x, z.x1), 0) * greatest(least(y + h, z.y2) - greatest(y, z.y1), 0) i, w * h a, (z.x2 - z.x1) * (z.y2 - z.y1) c from met),
u as (select *, case when a + c - i > 0 then cast(i as double) / (a + c - i) else 0.0 end iou from o)""".format(BOXES)


@query("j4_assign_tokens", f"with {SHARES} select invoice_id, region_id, arg_min(z.zone, (-iou, z.zone)) box, max(iou) iou from u where iou > 0.02 group by 1, 2")
def _(spark, d):
    return L.assigned(L.zoned_pages(W.region_pages(spark, d)), 0.02)


@query("j5_near_numbers", f"with {PLACED.format(BARE, f"[1:{L.FIRST_NUMBERS}]")} select invoice_id, region_id from q where near")
def _(spark, d):
    return L.near_numbers(bare(spark, d)).select("invoice_id", "region_id")


@query("x4_semantic_layout", f"""with {SHARES}, told as (select invoice_id, region_id, arg_min(z.zone, (-iou, z.zone)) box from u where iou > 0 group by 1, 2), tokens as (select invoice_id, box, list(region_id order by region_id) t from told group by 1, 2),
rows_ as (select invoice_id, cast(round_even((y + h / 2.0::double) / 10, 0) * 10 as int) r, string_agg(text, ' | ' order by x, region_id) line from zoned where zone = 'table' group by 1, 2), tables as (select invoice_id, string_agg(line, chr(10) order by r) content from rows_ group by 1),
r as (select invoice_id, zone, count(*) n, string_agg(text, ' ' order by y, x, region_id) text, min(x) x1, min(y) y1, max(x + w) x2, max(y + h) y2, string_agg(text, chr(10) order by y, x, region_id) lines from zoned group by 1, 2)
select r.invoice_id, zone region_type, n, text, x1, y1, x2, y2, array_to_string(coalesce(t, []), ',') tokens, case when zone = 'table' then content else lines end content from r left join tokens on tokens.invoice_id = r.invoice_id and box = zone left join tables on tables.invoice_id = r.invoice_id""")
def _(spark, d):
    return L.semantic_layout(W.region_pages(spark, d)).withColumn("tokens", F.array_join(F.col("tokens").cast("array<string>"), ","))


#: What is read from lines (invoice_id, line_no, text), checked and reviewed.
PARSED = r"""f as (select invoice_id, count(*) filter (regexp_matches(text, '(?i)invoice #[:\s]*\S')) ids, count(*) filter (regexp_matches(text, '(?i)date[:\s]+\S')) dates, count(*) filter (regexp_matches(text, '(?i)vendor[:\s]+.') and line_no <= {1}) vendors, arg_min(try_cast(regexp_extract(text, '(?i)^subtotal[:\s]*\$?([\d,]+\.?\d*)', 1) as decimal(18,2)), line_no) filter (regexp_extract(text, '(?i)^subtotal[:\s]*\$?([\d,]+\.?\d*)', 1) <> '') subtotal, arg_min(try_cast(regexp_extract(text, '(?i)^tax[:\s]*\$?([\d,]+\.?\d*)', 1) as decimal(18,2)), line_no) filter (regexp_extract(text, '(?i)^tax[:\s]*\$?([\d,]+\.?\d*)', 1) <> '') tax,
 arg_min(try_cast(regexp_extract(text, '(?i)^total[:\s]*\$?([\d,]+\.?\d*)', 1) as decimal(18,2)), line_no) filter (regexp_extract(text, '(?i)^total[:\s]*\$?([\d,]+\.?\d*)', 1) <> '') total from {0} group by 1),
i as (select invoice_id, count(*) n_items, sum(cast(regexp_extract(text, '  Total (\d+\.\d{{2}})\s*$', 1) as decimal(18,2))) items_total from {0} where regexp_extract(text, '  Total (\d+\.\d{{2}})\s*$', 1) <> '' group by 1),
o as (select f.*, coalesce(n_items, 0) n_items, items_total, not coalesce(abs(coalesce(items_total, 0) - subtotal) > 0.02 * abs(subtotal), false) items_ok, not coalesce(abs(total - (subtotal + tax)) > 0.02 * abs(total), false) total_ok,
 coalesce((case when ids > 0 then 0.9::double else 0 end + case when dates > 0 then 0.85::double else 0 end + case when total is not null then 0.95::double else 0 end + case when vendors > 0 then 0.8::double else 0 end + case when n_items > 0 then 0.7::double else 0 end) / nullif(cast(ids > 0 as int) + cast(dates > 0 as int) + cast(total is not null as int) + cast(vendors > 0 as int) + cast(coalesce(n_items, 0) > 0 as int), 0), 0.0) presence from f left join i using (invoice_id))"""
#: Printed invoices, and the heads of those that have no lines.
PRINTED = "printed as (select * from ocr_lines union all select invoice_id, 2, 'Invoice #: INV-' || invoice_id from invoices where n_items = 0 union all select invoice_id, 3, 'Date: ' || strftime(issue_date, '%Y-%m-%d') from invoices where n_items = 0)"


def parsed(lines, *keep):
    """Documents read from lines, with or without items, their sums checked."""
    money = lambda c: F.col(c).cast("decimal(18,2)").alias(c)
    read = T.parse_lines(lines, "keyword_line", keep=keep).withColumns({c: money(c) for c in ("subtotal", "tax", "total")})
    checked = V.validate_arithmetic(read.withColumn("n_items", F.coalesce("n_items", F.lit(0))), "relative")
    return C.presence_confidence(checked, {c: F.col(c).isNotNull() for c in ("invoice_number", "date", "total", "vendor")} | {"line_items": F.col("n_items") > 0})


def reviewed(df, confidence):
    review = ~(F.col("items_ok") & F.col("total_ok")) | (confidence < 0.6)
    return df.select("invoice_id", "n_items", F.col("items_total").cast("double").alias("items_total"), F.col("total").cast("double").alias("total"), "items_ok", "total_ok", confidence.alias("confidence"), review.alias("needs_review"))


@query("x5_parse_document", f"with {PRINTED}, {PARSED.format('printed', 10)} select invoice_id, n_items, cast(items_total as double) items_total, cast(total as double) total, items_ok, total_ok, presence confidence, not (items_ok and total_ok) or presence < 0.6 needs_review from o")
def _(spark, d):
    bare = W.invoices(spark, d).where("n_items = 0")
    head = F.array(F.struct(F.lit(2).alias("line_no"), F.concat(F.lit("Invoice #: INV-"), F.col("invoice_id").cast("string")).alias("text")), F.struct(F.lit(3).alias("line_no"), F.concat(F.lit("Date: "), F.date_format("issue_date", "yyyy-MM-dd")).alias("text")))
    df = parsed(W.ocr_lines(spark, d).unionByName(bare.select("invoice_id", F.inline(head))))
    return reviewed(df, F.col("overall"))


@query("x5_parse_regions", f"""with lined as (select invoice_id, cast(round_even((y + h / 2.0::double) / 10, 0) * 10 as int) line_no, string_agg(text, '  ' order by x, region_id) text from regions group by 1, 2), sure as (select invoice_id, floor(avg(confidence) * 1000000 + 0.5) / 1000000 c from regions group by 1), {PARSED.format('lined', 310)}
select invoice_id, n_items, cast(items_total as double) items_total, cast(total as double) total, items_ok, total_ok, c confidence, not (items_ok and total_ok) or c < 0.6 needs_review from o join sure using (invoice_id)""")
def _(spark, d):
    df = L.pages(W.region_pages(spark, d)).withColumn("sure", F.floor(F.aggregate("cells", F.lit(0.0), lambda s, c: s + c["confidence"], lambda s: s / F.size("cells")) * 1000000 + 0.5) / 1000000)
    return reviewed(parsed(T.lines_of_pages(df, keep=("sure",)), "sure"), F.col("sure"))


@query("x6_normalize_invoice", "select invoice_id, trim(vendor) vendor, coalesce(try_cast(nullif(regexp_replace(amount, '[^\\d.\\-]', '', 'g'), '') as double), 0.0) amount, coalesce(qty, 1.0) qty from (select invoice_id, '  ' || vendor || ' ' vendor, case when invoice_id % 3 = 0 then 'n/a' else '$ ' || grand_total end amount, case when invoice_id % 4 = 0 then null else cast(n_items as double) end qty from invoices)")
def _(spark, d):
    df = W.invoices(spark, d).select("invoice_id", F.concat(F.lit("  "), "vendor", F.lit(" ")).alias("vendor"), F.when(F.col("invoice_id") % 3 == 0, "n/a").otherwise(F.concat(F.lit("$ "), F.col("grand_total").cast("string"))).alias("amount"), F.when(F.col("invoice_id") % 4 != 0, F.col("n_items").cast("double")).alias("qty"))
    return T.normalize_invoice(df)
