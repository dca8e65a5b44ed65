"""Queries: what is written to files and read back, batch and stream."""

from pyspark.sql import functions as F

from docquarry.operators import confidence as C
from docquarry.operators import extract as T
from docquarry.operators import layout as L
from docquarry.plans import views as W
from docquarry.plans.documents import SHARES, ZONED
from docquarry.plans.evaluation import ERRORS, errors
from docquarry.registry import query
from docquarry.sources import files as S
from docquarry.storage import new_folder
from docquarry.streaming import streams as R


#: A page as a file: its id, its text and a line end.
PAGE = "cast(page_id as varchar) || chr(10) || coalesce(html, '') || chr(10)"
PAGES = f"select page_id, octet_length(encode({PAGE})) size, sha256({PAGE}) sha256 from pages"


def page_files(spark, d, path, where="true"):
    """Each page as a file of its own, in four folders."""
    text = F.concat(F.col("page_id").cast("string"), F.lit("\n"), F.coalesce("html", F.lit("")))
    S.write_files(W.table(spark, d, "pages").where(where).select(text.alias("text"), (F.col("page_id") % 4).alias("shelf")), path, "text", "shelf")


def of_page(files):
    """Rows of files with the page's id, from the first line."""
    return files.select(F.substring_index(F.col("content").cast("string"), "\n", 1).cast("long").alias("page_id"), "size", "sha256")


@query("s1_s2_folder_source", f"select *, 's1' \"source\" from ({PAGES}) union all select *, 's2' from ({PAGES}) where page_id % 4 = 1 and size between 100 and 52428800")
def _(spark, d):
    path = new_folder(spark, "pages")
    page_files(spark, d, path)
    whole = of_page(S.bundled(S.folder(spark, path, "*.txt", recursive=True))).withColumn("source", F.lit("s1"))
    part = of_page(S.bundled(S.folder(spark, path, "*.txt", prefix="shelf=1", recursive=True, least=S.LEAST, most=S.MOST))).withColumn("source", F.lit("s2"))
    return whole.unionAll(part)


@query("s2_listing", f"select page_id % 4 shelf, count(*) files, cast(sum(size) as bigint) size from ({PAGES}) group by 1")
def _(spark, d):
    path = new_folder(spark, "pages")
    page_files(spark, d, path)
    shelf = F.regexp_extract("path", "shelf=([0-9]+)/", 1).cast("long")
    return S.bundled(S.listing(spark, path, "*.txt")).groupBy(shelf.alias("shelf")).agg(F.count("*").alias("files"), F.sum("size").alias("size"))


@query("s5_json_lines", "select doc_id, lang, length(text) n from documents")
def _(spark, d):
    path = new_folder(spark, "jsonl")
    W.table(spark, d, "documents").select("doc_id", "lang", "text").write.json(path)
    W.table(spark, d, "region").select(F.concat(F.lit("not json "), "r_name")).write.mode("append").text(path)
    return S.json_lines(spark, path, "doc_id long, lang string, text string").where("doc_id is not null").select("doc_id", "lang", F.length("text").cast("long").alias("n"))


@query("s6_strict_predictions", "select invoice_id, vendor, currency from predictions")
def _(spark, d):
    path = new_folder(spark, "predictions")
    W.predictions(spark, d).select("invoice_id", "vendor", "currency").write.json(path)
    return S.json_lines(spark, path, "invoice_id long, vendor string, currency string", strict=True)


@query("s7_stage_folders", "select document_id, tenant from pipeline_metrics where stage = 'purchase'")
def _(spark, d):
    path = new_folder(spark, "stages")
    S.write_stage(W.pipeline_metrics(spark, d).select("document_id", "tenant", "stage"), path)
    return spark.read.parquet(path).where("stage = 'purchase'").select("document_id", "tenant")


@query("s9_data_lake", """with l as (select document_id, cast(ts as date) as "date", case when cast(ts as date) = date '2024-01-15' then ms + 1 else ms end ms from pipeline_metrics)
select document_id, year("date") as "year", month("date") as "month", day("date") as "day", ms from l""")
def _(spark, d):
    path = new_folder(spark, "lake")
    rows = W.pipeline_metrics(spark, d).select("document_id", F.to_date("ts").alias("date"), "ms")
    S.write_by_day(rows, path, "date")
    # one day is loaded again, corrected
    S.write_by_day(rows.where("date = date '2024-01-15'").withColumn("ms", F.col("ms") + 1), path, "date")
    return spark.read.parquet(path).select("document_id", *(F.col(c).cast("long").alias(c) for c in ("year", "month", "day")), "ms")


@query("s8_two_tables", "select i.invoice_id, i.vendor, count(l.pos) lines from invoices i left join line_items l using (invoice_id) group by 1, 2")
def _(spark, d):
    path = new_folder(spark, "oltp")
    S.write_parent_and_child(W.invoices(spark, d), W.line_items(spark, d), path)
    child = spark.read.parquet(f"{path}/line_items").groupBy("invoice_id").agg(F.count("*").alias("lines"))
    return spark.read.parquet(f"{path}/invoices").select("invoice_id", "vendor").join(child, "invoice_id", "left").withColumn("lines", F.coalesce("lines", F.lit(0)))


@query("s12_targets", "with n as (select count(*) n from invoices) select * from (values ('csv', 1::bigint, true), ('parquet', 1, true), ('late', 2, true), ('broken', 2, false)) v(target, attempts, went), (select n as \"rows\" from n) where went union all select 'broken', 2, false, 0")
def _(spark, d):
    path = new_folder(spark, "targets")
    df, tried = W.invoices(spark, d).select("invoice_id", F.col("grand_total").cast("double").alias("total")), []

    def late(x):
        tried.append(1)
        if len(tried) == 1:
            raise ConnectionError("not there yet")
        x.write.parquet(f"{path}/late")

    targets = {"csv": lambda x: S.write_csv(x, f"{path}/csv"), "parquet": lambda x: x.write.parquet(f"{path}/parquet"), "late": late, "broken": lambda x: x.write.format("none such").save(path)}
    for _ in range(2):
        status = S.load(df, targets, f"{path}/ledger", 1)
    reads = {"csv": spark.read.schema("invoice_id long, total double").option("header", True).csv(f"{path}/csv"), "parquet": spark.read.parquet(f"{path}/parquet"), "late": spark.read.parquet(f"{path}/late")}
    held = None
    for name, rows in reads.items():
        n = rows.agg(F.count("*").alias("rows")).withColumn("target", F.lit(name))
        held = n if held is None else held.unionByName(n)
    status = status.groupBy("target").agg(F.count("*").alias("attempts"), F.bool_or("went").alias("went"))
    return status.join(held, "target", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


@query("s16_manifest", f"select page_id, cast(page_id % 7 <> 0 as boolean) found, case when page_id % 7 <> 0 then sha256({PAGE}) end sha256 from pages")
def _(spark, d):
    path = new_folder(spark, "pages")
    page_files(spark, d, path)
    files = S.bundled(S.folder(spark, path, "*.txt", recursive=True))
    # the manifest is a file too; every seventh page's truth is not where it says
    named = of_page(files.withColumn("sha256", F.substring_index("path", "/", -2)))
    named.select("page_id", F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("gone-"), "sha256")).otherwise(F.col("sha256")).alias("truth_path")).write.json(f"{path}-manifest")
    found, missing = S.manifest(S.json_lines(spark, f"{path}-manifest", "page_id long, truth_path string", strict=True), files, depth=2)
    found = found.select("page_id", F.lit(True).alias("found"), "sha256")
    return found.unionByName(missing.select("page_id", F.lit(False).alias("found"), F.lit(None).cast("string").alias("sha256")))


@query("s17_layouts", "select invoice_id, layout, count(*) n from regions, (values ('pages'), ('text_regions'), ('tokens'), ('text_blocks')) v(layout) where confidence >= 0.7 group by 1, 2")
def _(spark, d):
    cell = lambda c: F.struct(c["text"].alias("text"), F.array(*(c[k].cast("double") for k in "xywh")).alias("bbox"), c["confidence"].alias("confidence"))
    docs = W.region_pages(spark, d).select("invoice_id", F.explode(F.array(F.transform("cells", cell))).alias("cells"))

    def each(part, name):
        return F.transform("cells", lambda c: c[part]).alias(name)

    # all four shapes of a document in one row, from one gathering
    shapes = docs.select(
        "invoice_id", F.array(F.struct(F.col("cells").alias("elements"))).alias("pages"), F.col("cells").alias("text_regions"), F.col("cells").alias("text_blocks"), each("text", "tokens"), each("bbox", "bboxes"), each("confidence", "confidences"),
    )
    counts = F.array(*(F.struct(F.lit(layout).alias("layout"), F.size(S.cells_of(layout)).cast("long").alias("n")) for layout in S.LAYOUTS))
    return shapes.select("invoice_id", F.inline(counts)).where("n > 0")


@query("m3_error_log", f"with {ERRORS} select error, count(*) n from errors group by 1")
def _(spark, d):
    path = new_folder(spark, "errors")
    S.write_error_log(errors(spark, d), path)
    return S.replay(spark, path, "invoice_id long, element string, confidence double, error string").groupBy("error").agg(F.count("*").alias("n"))


@query("m4_replay", f"with {ERRORS} select invoice_id, 'Read ' || element || ' again.' prompt from errors where error = 'missing_field'")
def _(spark, d):
    path = new_folder(spark, "errors")
    S.write_error_log(errors(spark, d), path)
    rows = S.replay(spark, path, "invoice_id long, element string, confidence double, error string").where("error = 'missing_field'")
    return rows.select("invoice_id", F.concat(F.lit("Read "), "element", F.lit(" again.")).alias("prompt"))


@query("st6_corrections_stream", "select conv_id, turn, role from conversations where role = 'assistant'")
def _(spark, d):
    path = new_folder(spark, "corrections")
    W.table(spark, d, "conversations").select("conv_id", "turn", "role").write.json(path)
    rows = spark.readStream.schema("conv_id long, turn long, role string").json(path).where("role = 'assistant'")
    out = new_folder(spark, "training")
    R.to_parquet(rows, out, f"{out}-log").awaitTermination()
    return spark.read.schema("conv_id long, turn long, role string").parquet(out)


@query("st8_folder_stream", PAGES)
def _(spark, d):
    path = new_folder(spark, "pages")
    out = new_folder(spark, "ingested")
    # files arrive in two waves; the second run goes on where the first ended
    for wave in ("page_id % 2 = 0", "page_id % 2 = 1"):
        page_files(spark, d, path, wave)
        # a micro-batch costs seconds whatever it holds, and its logs are written again every ten: pages are small, so it takes many
        with S.bundles(spark):
            R.to_parquet(of_page(S.folder_stream(spark, path, "*.txt", content=True, files=20_000)), out, f"{out}-log").awaitTermination()
    return spark.read.schema("page_id long, size long, sha256 string").parquet(out)


@query("st10_multi_sink_stream", "select event_type, count(*) n, 2 copies from events group by 1")
def _(spark, d):
    from docquarry.plans.streams import events

    path = new_folder(spark, "sinks")

    def write(df, epoch):
        S.write_targets(df, {name: lambda x, name=name: x.write.mode("overwrite").parquet(f"{path}/{name}/batch={epoch}") for name in ("a", "b")})

    R.to_targets(events(spark, d).select("event_id", "event_type"), write, f"{path}-log").awaitTermination()
    both = spark.read.parquet(f"{path}/a").unionAll(spark.read.parquet(f"{path}/b"))
    return both.groupBy("event_id", "event_type").agg(F.count("*").cast("int").alias("copies")).groupBy("event_type", "copies").agg(F.count("*").alias("n"))


@query("a10_typed_vote", """with c as (select invoice_id, 1 pos, cast(grand_total as varchar) v, 0.6 c from invoices where grand_total is not null union all select invoice_id, 2, '$' || grand_total, 0.7 from predictions where grand_total is not null union all select invoice_id, 3, 'n/a', 0.9 from invoices where grand_total is not null),
n as (select *, try_cast(replace(replace(v, ',', ''), '$', '') as double) d from c), f as (select invoice_id, d, sum(cast(c as decimal(18,6))) s, count(*) k, min(pos) p from n where d is not null group by 1, 2), r as (select *, row_number() over (partition by invoice_id order by s desc, p) rn from f) select invoice_id, d amount, k source_count from r where rn = 1""")
def _(spark, d):
    t = W.invoices(spark, d).where("grand_total is not null").select("invoice_id", F.lit(1).alias("pos"), F.col("grand_total").cast("string").alias("value"), F.lit(0.6).alias("confidence"))
    p = W.predictions(spark, d).where("grand_total is not null").select("invoice_id", F.lit(2), F.concat(F.lit("$"), F.col("grand_total").cast("string")), F.lit(0.7))
    known = t.unionAll(p).unionAll(t.select("invoice_id", F.lit(3), F.lit("n/a"), F.lit(0.9))).where(F.regexp_replace("value", "[,$]", "").try_cast("double").isNotNull())
    return C.vote(known, "invoice_id").select("invoice_id", F.regexp_replace("value", "[,$]", "").cast("double").alias("amount"), F.col("agreeing").alias("source_count"))


# ------------------------------------------------------------------- extraction from placed regions

MONEY = r"try_cast(nullif(regexp_extract(replace(text, ',', ''), '(-?\d+\.\d{2})', 1), '') as double)"


@query("x1_fields_boxes", rf"""with r as (select *, row_number() over (partition by invoice_id order by y, x, region_id) r, row_number() over (partition by invoice_id, x < 300 order by y, x, region_id) l, {MONEY} m from regions)
select invoice_id, arg_min(regexp_extract(text, '(?i)invoice\s*#?\s*[:\-]?\s*([A-Za-z0-9\-/]+)', 1), r) filter (r <= 30 and regexp_extract(text, '(?i)invoice\s*#?\s*[:\-]?\s*([A-Za-z0-9\-/]+)', 1) <> '') invoice_number, arg_min(regexp_extract(text, '(\d{{4}}-\d{{2}}-\d{{2}})', 1), r) filter (r <= 30 and regexp_extract(text, '(\d{{4}}-\d{{2}}-\d{{2}})', 1) <> '') date,
 arg_min(text, r) filter (x < 300 and l <= 8) vendor, arg_max(m, r) filter (m is not null and regexp_matches(lower(text), '\bsubtotal\b')) subtotal, arg_max(m, r) filter (m is not null and regexp_matches(lower(text), '\b(tax|vat)\b')) tax, coalesce(arg_max(m, r) filter (m is not null and regexp_matches(lower(text), '\b(total|amount due)\b')), max(m)) total from r group by 1""")
def _(spark, d):
    return T.extract_boxes(W.region_pages(spark, d))


@query("x1_fields_quadrant", r"""with p as (select *, max(x + w) over (partition by invoice_id) pw, max(y + h) over (partition by invoice_id) ph, x + w / 2.0::double cx, y + h / 2.0::double cy, regexp_matches(text, '^[$€£¥]?\s*-?[\d.,]+%?$') num from regions), q as (select *, min(y) filter (num) over (partition by invoice_id) top, max(y + h) filter (num) over (partition by invoice_id) low from p),
z as (select *, case when cx < pw * 0.5::double and cy < ph * 0.3::double then 'vendor' when cx > pw * 0.5::double or regexp_matches(lower(text), 'invoice|bill to|client|customer|date|due') then 'client' when cy between top and low then 'line_items' when regexp_matches(lower(text), 'tax|vat|gst|discount|subtotal') then 'tax' when cx > pw * 0.6::double and cy > ph * 0.7::double or contains(lower(text), 'total') then 'totals' end part,
 try_cast(replace(nullif(regexp_extract(text, '(-?\d[\d,]*\.?\d*)\s*$', 1), ''), ',', '') as double) v from q)
select invoice_id, arg_min(text, (y, x, region_id)) filter (part = 'vendor') vendor, max(v) filter (part = 'totals') total, arg_min(v, (y, x, region_id)) filter (v is not null and starts_with(lower(text), 'tax')) tax, count(part) placed from z group by 1""")
def _(spark, d):
    return T.extract_parts(L.quadrants(W.region_pages(spark, d), None))


@query("x1_fields_labelled", rf"""with {ZONED} select invoice_id, arg_min(regexp_extract(text, '(?i)vendor:\s*(.+)', 1), region_id) filter (zone = 'header' and regexp_extract(text, '(?i)vendor:\s*(.+)', 1) <> '') vendor, cast(null as varchar) email, arg_min(trim(regexp_extract(text, '(\+?\d{{0,2}}[ .-]?\(?\d{{3}}\)?[ .-]?\d{{3}}[ .-]?\d{{4}})', 1)), region_id) filter (zone = 'header' and regexp_extract(text, '(\+?\d{{0,2}}[ .-]?\(?\d{{3}}\)?[ .-]?\d{{3}}[ .-]?\d{{4}})', 1) <> '') phone,
 arg_min(try_cast(replace(regexp_extract(text, '(?i)^tax\D*([\d,]+\.\d{{2}})', 1), ',', '') as double), region_id) filter (zone = 'footer' and regexp_extract(text, '(?i)^tax\D*([\d,]+\.\d{{2}})', 1) <> '') tax, arg_min(try_cast(replace(regexp_extract(text, '(?i)^total\D*([\d,]+\.\d{{2}})', 1), ',', '') as double), region_id) filter (zone = 'footer' and regexp_extract(text, '(?i)^total\D*([\d,]+\.\d{{2}})', 1) <> '') total from zoned group by 1""")
def _(spark, d):
    return T.extract_labelled(L.zones(W.regions(spark, d)))


BUCKETS = "b as (select *, cast(round_even((y + h / 2.0::double) / 10, 0) * 10 as int) row_ from regions)"


@query("x2_items_table_rows", rf"with {BUCKETS}, c as (select invoice_id, row_, list(text order by x, region_id) c from b group by 1, 2 having count(*) >= 3) select invoice_id, row_ as \"row\", c[1] description, try_cast(regexp_extract(c[2], '(-?[\d.]+)', 1) as double) qty, try_cast(regexp_extract(c[3], '(-?[\d.]+)', 1) as double) unit_price, try_cast(regexp_extract(c[-1], '(-?[\d.]+)', 1) as double) line_total from c".replace('\\"', '"'))
def _(spark, d):
    return T.items_of_table(L.rows_by_bucket(W.regions(spark, d)))


def named_table(spark, d):
    """(invoice_id, cells): the line items of a page as a table of bare cells under a header row; every third page has price
    before quantity. All in the row of the page."""
    swapped = F.col("invoice_id") % 3 == 0
    across = lambda k: F.when(swapped & (k == 1), 340).when(swapped & (k == 2), 190).otherwise(k * 150 + 40)
    keep = lambda t, n, k: (n >= 5) & (k < 4) & ((k == 3) | ~(t.startswith("Sub") | t.startswith("Tax") | t.startswith("Total ")))
    pages = W.region_pages(spark, d, lambda t: F.regexp_replace(t, "^(Qty|Unit|Total) ", ""), across, keep).where(F.size("cells") > 0)
    top = F.array_min(F.transform("cells", lambda c: c["y"]))
    titles = (("Description", 40, 40), ("Quantity", 340, 190), ("Unit Price", 190, 340), ("Total", 490, 490))
    head = F.array(*(
        F.struct((top - 30).alias("y"), F.when(swapped, a).otherwise(b).alias("x"), F.lit(k).alias("region_id"), F.lit(t).alias("text"), F.lit(100).alias("w"), F.lit(20).alias("h"), F.lit(1.0).alias("confidence"))
        for k, (t, a, b) in enumerate(titles)
    ))
    return pages.select("invoice_id", F.concat(head, "cells").alias("cells"))


@query("x2_items_header_named", """with c as (select * from regions where region_id >= 50 and region_id % 10 < 4 and (region_id % 10 = 3 or not (text like 'Sub%' or text like 'Tax%' or text like 'Total %'))), r as (select *, cast(round_even((y + h / 2.0::double) / 10, 0) * 10 as int) row_, region_id % 10 k, regexp_replace(text, '^(Qty|Unit|Total) ', '') v from c),
g as (select invoice_id, row_ as "row", max(v) filter (k = 0) description, try_cast(max(v) filter (k = 1) as double) quantity, try_cast(max(v) filter (k = 2) as double) unit_price, try_cast(max(v) filter (k = 3) as double) total, count(*) n from r group by 1, 2)
select invoice_id, "row", description, quantity, unit_price, total, coalesce(floor(quantity * unit_price * 100 + 0.5) / 100, total) line_total from g where n >= 3""")
def _(spark, d):
    return T.items_named(named_table(spark, d))


@query("x2_items_receipt", r"select invoice_id, line_no, trim(regexp_extract(text, '^(?:\d+\s+)?([^\d$]+)', 1)) description, cast(coalesce(nullif(regexp_extract(text, '(?i)(?:qty\s+)?(\d+)\s*(?:x\b|@|unit)', 1), ''), nullif(regexp_extract(text, '^(\d+)\s', 1), ''), '1') as double) qty, cast(regexp_extract(text, '\$?(\d+\.\d{2})\s*$', 1) as double) line_total from ocr_lines where regexp_extract(text, '\$?(\d+\.\d{2})\s*$', 1) <> '' and not regexp_matches(lower(text), 'total:|subtotal|^tax|^total')")
def _(spark, d):
    return T.items_of_receipt(W.ocr_lines(spark, d))


@query("x2_items_box_rows")
def _(spark, d):
    return T.items_of_box_rows(L.cells_by_mean(W.region_pages(spark, d)))


@query("f15_overlap", f"with {SHARES} select invoice_id, region_id, z.zone as zone, iou from u")
def _(spark, d):
    shares = L.shares_of_zones(L.zoned_pages(W.region_pages(spark, d)))
    return shares.unpivot(["invoice_id", "region_id"], [*L.ZONES], "zone", "iou").where("iou IS NOT NULL")
