"""Queries: projections, exports, joins of records, training sets, sorting and set operations."""

from pyspark.sql import functions as F

from docquarry.functions import scalars as S
from docquarry.operators import datasets as D
from docquarry.operators import extract as X
from docquarry.operators import evaluate as E
from docquarry.operators import project as P
from docquarry.operators import validate as V
from docquarry.plans import views as W
from docquarry.plans.scalars import DIFFICULTY
from docquarry.registry import query


@query("p1_canonical", "select invoice_id document_id, vendor vendor_name, strftime(issue_date, '%Y-%m-%d') date, cast(coalesce(grand_total, 0) as double) total, coalesce(currency, 'USD') currency, n_items items from invoices")
def _(spark, d):
    return P.canonical(W.invoices(spark, d))


@query("p2_dates_with_flag", "select invoice_id, strftime(d, '%Y-%m-%d') date, d is null date_defaulted from (select invoice_id, case invoice_id % 3 when 0 then issue_date when 1 then issue_date end d from invoices)")
def _(spark, d):
    k = F.col("invoice_id") % 3
    text = F.when(k == 0, F.date_format("issue_date", "yyyy-MM-dd")).when(k == 1, F.date_format("issue_date", "MM/dd/yyyy")).otherwise("soon")
    return P.with_date(W.invoices(spark, d).select("invoice_id", text.alias("text")), "text").select("invoice_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "date_defaulted")


@query("p3_fill_missing", "select invoice_id, coalesce(p.vendor, t.vendor) vendor, p.currency from predictions p left join (select invoice_id, vendor from invoices) t using (invoice_id)")
def _(spark, d):
    return P.fill(W.predictions(spark, d).select("invoice_id", "vendor", "currency"), W.invoices(spark, d), "invoice_id", ["vendor", "currency"])


@query("p4_unified_kinds", "select invoice_id, 'invoice' kind, vendor, cast(grand_total as double) total, cast(null as varchar) cashier from invoices where invoice_id % 2 = 0 union all select invoice_id, 'receipt', vendor, cast(grand_total as double), 'c' || (invoice_id % 7) from invoices where invoice_id % 2 = 1")
def _(spark, d):
    i = W.invoices(spark, d).select("invoice_id", "vendor", F.col("grand_total").cast("double").alias("total"))
    a = i.where("invoice_id % 2 = 0").withColumn("kind", F.lit("invoice"))
    b = i.where("invoice_id % 2 = 1").withColumn("kind", F.lit("receipt")).withColumn("cashier", F.concat(F.lit("c"), (F.col("invoice_id") % 7).cast("string")))
    return b.unionByName(a, allowMissingColumns=True)


@query("p5_standardise", "select invoice_id, cast(coalesce(subtotal, items_total, 0) as double) subtotal, cast(t as double) tax, cast(coalesce(total, coalesce(items_total, 0) + t) as double) total from (select *, cast(coalesce(tax, round(coalesce(items_total, 0) * 0.10, 2)) as decimal(18,2)) t from declared)")
def _(spark, d):
    return P.standardise(W.declared(spark, d)).select("invoice_id", *(F.col(c).cast("double").alias(c) for c in ("subtotal", "tax", "total")))


@query("p6_long_fields", "with f as (select invoice_id, 'vendor' field, vendor as value from invoices union all select invoice_id, 'currency', currency from invoices union all select invoice_id, 'grand_total', cast(grand_total as varchar) from invoices) select invoice_id, field, value, try_cast(value as double) value_num, 'model' as source, sha256(invoice_id || '|' || field) lineage from f where value is not null")
def _(spark, d):
    return P.long_fields(W.invoices(spark, d), "invoice_id", ["vendor", "currency", "grand_total"], "model")


@query("p7_nested_path", "select event_id, json_extract_string(props, '$.k') k, json_extract_string(props, '$.a.b') missing from events")
def _(spark, d):
    at = lambda p: F.get_json_object("props", p)
    return W.table(spark, d, "events").select("event_id", at("$.k").alias("k"), at("$.a.b").alias("missing"))


@query("p9_key_fields", "select invoice_id, vendor, strftime(issue_date, '%Y-%m-%d') date, cast(grand_total as double) total, currency, n_items from invoices")
def _(spark, d):
    return W.invoices(spark, d).select("invoice_id", "vendor", F.date_format("issue_date", "yyyy-MM-dd").alias("date"), F.col("grand_total").cast("double").alias("total"), "currency", "n_items")


def sql_redacted(c: str) -> str:
    for p in P.PII.values():
        c = f"regexp_replace({c}, '{p}', '[REDACTED]', 'g')"
    return c


@query("p10_redact", f"select doc_id, md5({sql_redacted('text')}) digest, len(regexp_extract_all(text, '{P.PII['email']}')) email, len(regexp_extract_all(text, '{P.PII['phone']}')) phone, len(regexp_extract_all(text, '{P.PII['ssn']}')) ssn, len(regexp_extract_all(text, '{P.PII['card']}')) card from documents")
def _(spark, d):
    docs = W.table(spark, d, "documents")
    return P.redacted(docs.select("doc_id", "text", *(x.alias(k) for k, x in P.pii_counts(F.col("text")).items())), "doc_id").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), *P.PII)


CASES = lambda c, kinds, other: "case " + " ".join(f"when regexp_matches(lower({c}), '{p}') then '{k}'" for k, p in kinds.items()) + (f" else '{other}'" if other else "") + " end"


@query("p11_kind_by_name", f"select page_id, {CASES('url', P.BY_NAME, None)} kind from pages")
def _(spark, d):
    return W.table(spark, d, "pages").select("page_id", P.first_keyword(F.col("url"), P.BY_NAME).alias("kind"))


@query("p12_kind_by_text", f"select doc_id, {CASES('text', P.BY_TEXT, 'generic')} kind from documents")
def _(spark, d):
    return W.table(spark, d, "documents").select("doc_id", P.first_keyword(F.col("text"), P.BY_TEXT, "generic").alias("kind"))


@query("p13_receipt_kind", f"select invoice_id, pos, {CASES('description', P.RECEIPTS, 'retail')} kind from line_items")
def _(spark, d):
    return W.line_items(spark, d).select("invoice_id", F.col("pos").cast("long").alias("pos"), P.first_keyword(F.col("description"), P.RECEIPTS, "retail").alias("kind"))


@query("p14_challenge", "select invoice_id, case when n_items > 25 then 'multi_page' when priority = '1-URGENT' or n_items > 15 then 'complex_table' when status = 'P' then 'visual_noise' when currency not in ('USD', 'EUR') and invoice_id % 10 < 3 then 'multi_currency' when n_items > 10 then 'dense_data' else 'key_value' end challenge from invoices")
def _(spark, d):
    return P.challenge(W.invoices(spark, d)).select("invoice_id", "challenge")


@query("p16_review_filter", "select invoice_id from declared where confidence < 0.5 and status = 'F'")
def _(spark, d):
    return W.declared(spark, d).where((F.col("confidence") < 0.5) & (F.col("status") == "F")).select("invoice_id")


@query("p17_page_flags", "select conv_id, max(cast(turn < 3 and length(text) > 50 as int)) = 1 has_text, sum(length(text)) < 100 sparse, count(*) > 1 several, max(cast(turn = 0 and len(string_split(text, chr(10))) > 10 as int)) = 1 has_tables from conversations group by 1")
def _(spark, d):
    return P.page_flags(W.table(spark, d, "conversations").withColumnRenamed("turn", "page"), "conv_id")


@query("s3_s4_file_checks", "select page_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) extension, strlen(html) as size, sha256(html) sha256, case when lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) = 'pdf' then 'pdf' when lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) in ('png', 'jpg', 'jpeg', 'tiff') then 'image' else 'unknown' end kind, case when lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) not in ('pdf', 'png', 'jpg', 'jpeg', 'tiff', 'html', '') then 'extension' when strlen(html) < 2000 then 'too_small' when strlen(html) > 10000 then 'too_large' end refused from pages")
def _(spark, d):
    out = P.file_checks(W.table(spark, d, "pages"), "url", "html", 2000, 10000, ("pdf", "png", "jpg", "jpeg", "tiff", "html", ""))
    return out.select("page_id", "extension", F.col("size").cast("long").alias("size"), "sha256", "kind", "refused")


@query("s10_features", "select invoice_id, cast(coalesce(grand_total, 0) as double) total_amount, n_items line_item_count, currency, case when subtotal > 0 then cast(coalesce(tax, 0) as double) / cast(subtotal as double) else 0.0 end tax_rate, year(issue_date) as year, month(issue_date) as month, isodow(issue_date) - 1 weekday from invoices")
def _(spark, d):
    return P.features(W.invoices(spark, d))


@query("s11_document_text", "select invoice_id, concat_ws(' ', 'Vendor: ' || vendor, 'Invoice ID: ' || invoice_id, 'Date: ' || strftime(issue_date, '%Y-%m-%d'), t) text from invoices left join (select invoice_id, string_agg(description, ' ' order by pos) t from line_items group by 1) using (invoice_id)")
def _(spark, d):
    return P.document_text(W.invoices(spark, d), W.line_items(spark, d))


@query("s13_flat_export", "select cast(invoice_id as varchar) doc_id, coalesce(vendor, '') vendor_name, 'INV-' || invoice_id invoice_number, strftime(issue_date, '%Y-%m-%d') issue_date, coalesce(cast(subtotal as varchar), '') subtotal, coalesce(cast(tax as varchar), '') tax_amount, coalesce(cast(grand_total as varchar), '') grand_total, coalesce(currency, 'USD') currency, 'completed' status from invoices")
def _(spark, d):
    return P.flat_export(W.invoices(spark, d))


@query("s14_accounting_export", "select invoice_id, client, coalesce(description, 'Service') item, case when description is null then 1.0 else qty end qty, case when description is null then cast(coalesce(grand_total, 0) as double) else unit_price end rate, case when description is null then cast(coalesce(grand_total, 0) as double) else cast(line_total as double) end amount from invoices left join line_items using (invoice_id)")
def _(spark, d):
    return P.accounting_export(W.invoices(spark, d), W.line_items(spark, d))


@query("s15_json_export", "select invoice_id, '{\"invoice_id\":' || invoice_id || coalesce(',\"vendor\":\"' || vendor || '\"', '') || ',\"currency\":\"' || currency || '\"}' as json from invoices")
def _(spark, d):
    return W.invoices(spark, d).select("invoice_id", F.to_json(F.struct("invoice_id", "vendor", "currency")).alias("json"))


@query("s18_markdown", "select invoice_id, concat_ws(chr(10), '# Invoice ' || invoice_id, 'Vendor: ' || vendor, '| description | quantity | total |', '| --- | --- | --- |', t, 'Total: ' || grand_total) text from invoices join (select invoice_id, string_agg('| ' || description || ' | ' || cast(qty as bigint) || ' | ' || line_total || ' |', chr(10) order by pos) t from line_items group by 1) using (invoice_id)")
def _(spark, d):
    return P.markdown(W.invoices(spark, d), W.line_items(spark, d))


@query("s19_html_table", "select invoice_id, '<table>' || string_agg('<tr><td>' || description || '</td><td>' || cast(qty as bigint) || '</td><td>' || line_total || '</td></tr>', '' order by pos) || '</table>' html from line_items group by 1")
def _(spark, d):
    return P.html_table(W.line_items(spark, d))


@query("s7_stage_store", "select tenant, count(*) filter (stage = 'signup') signup, count(*) filter (stage = 'view') \"view\", count(*) filter (stage = 'purchase') purchase from pipeline_metrics group by 1")
def _(spark, d):
    return W.pipeline_metrics(spark, d).groupBy("tenant").pivot("stage", ["signup", "view", "purchase"]).agg(F.count(F.lit(1))).na.fill(0)


@query("s8_parent_and_child", "select i.invoice_id, i.vendor, count(l.pos) lines, cast(sum(l.line_total) as double) total from invoices i left join line_items l using (invoice_id) group by 1, 2")
def _(spark, d):
    child = W.line_items(spark, d).groupBy("invoice_id").agg(F.count("*").alias("lines"), F.sum("line_total").cast("double").alias("total"))
    return W.invoices(spark, d).select("invoice_id", "vendor").join(child, "invoice_id", "left").withColumn("lines", F.coalesce("lines", F.lit(0)))


@query("j1_predictions_and_truth", "select coalesce(t.invoice_id, p.invoice_id) invoice_id, t.invoice_id is not null and p.invoice_id is not null matched from (select invoice_id from invoices where invoice_id % 5 <> 0) t full join (select invoice_id from predictions where invoice_id % 7 <> 0) p on t.invoice_id = p.invoice_id")
def _(spark, d):
    t, p = W.invoices(spark, d).where("invoice_id % 5 <> 0"), W.predictions(spark, d).where("invoice_id % 7 <> 0")
    return E.pairs(t.select("invoice_id", "vendor"), p.select("invoice_id", "vendor")).select("invoice_id", "matched")


@query("j2_aligned_items", "select coalesce(t.invoice_id, p.invoice_id) invoice_id, coalesce(t.pos, p.pos) pos, t.qty t_qty, p.qty p_qty from line_items t full join predicted_items p on t.invoice_id = p.invoice_id and t.pos = p.pos")
def _(spark, d):
    return E.aligned_items(W.line_items(spark, d), W.predicted_items(spark, d)).select("invoice_id", F.col("pos").cast("long").alias("pos"), "t_qty", "p_qty")


DIFF = """a as (select invoice_id, lower(trim(description)) item, sum(qty) qty, cast(sum(line_total) as decimal(18,2)) total from line_items group by 1, 2), b as (select invoice_id, lower(trim(description)) item, sum(qty) qty, cast(sum(line_total) as decimal(18,2)) total from predicted_items group by 1, 2),
diffs as (select coalesce(a.invoice_id, b.invoice_id) invoice_id, coalesce(a.item, b.item) item, case when a.qty is null then 'added' when b.qty is null then 'deleted' when a.qty <> b.qty then 'quantity_changed' when a.total <> b.total then 'price_changed' else 'match' end kind, coalesce(b.total, 0) - coalesce(a.total, 0) difference from a full join b on a.invoice_id = b.invoice_id and a.item = b.item)"""


@query("j3_document_diff", f"with {DIFF} select invoice_id, item, kind, cast(difference as double) difference from diffs")
def _(spark, d):
    return P.compare_documents(W.line_items(spark, d), W.predicted_items(spark, d))


@query("j3_comparison_status", f"with {DIFF} select invoice_id, case when count(*) = count(*) filter (kind = 'match') then 'match' when count(*) filter (kind = 'match') > 0 then 'partial_match' else 'mismatch' end status, cast(sum(difference) as double) difference from diffs group by 1")
def _(spark, d):
    return P.comparison_status(P.compare_documents(W.line_items(spark, d), W.predicted_items(spark, d)))


@query("j7_missing_artifacts", "select invoice_id from invoices where invoice_id not in (select invoice_id from line_items)")
def _(spark, d):
    return W.invoices(spark, d).select("invoice_id").join(W.line_items(spark, d), "invoice_id", "left_anti")


@query("j8_corrections", "select invoice_id, p.vendor before, t.vendor as after from predictions p join (select invoice_id, vendor from invoices) t using (invoice_id) where p.vendor is distinct from t.vendor")
def _(spark, d):
    p = W.predictions(spark, d).select("invoice_id", F.col("vendor").alias("before"))
    t = W.invoices(spark, d).select("invoice_id", F.col("vendor").alias("after"))
    return p.join(t, "invoice_id").where(~F.col("before").eqNullSafe(F.col("after")))


@query("j15_base_and_tuned", "select invoice_id, b.vendor base_vendor, t.vendor tuned_vendor, coalesce(b.vendor = t.vendor, false) agree from predictions b join (select invoice_id, vendor from invoices) t using (invoice_id)")
def _(spark, d):
    b = W.predictions(spark, d).select("invoice_id", F.col("vendor").alias("base_vendor"))
    t = W.invoices(spark, d).select("invoice_id", F.col("vendor").alias("tuned_vendor"))
    return b.join(t, "invoice_id").withColumn("agree", F.coalesce(F.col("base_vendor") == F.col("tuned_vendor"), F.lit(False)))


# ----------------------------------------------------------------------------------- sorting and sets


@query("t2_top_amounts", "select invoice_id, array_to_string(list_transform(list_reverse_sort(list(line_total))[1:3], lambda x: cast(x as varchar)), ',') top from line_items group by 1")
def _(spark, d):
    top = F.slice(F.sort_array(F.collect_list("line_total"), asc=False), 1, 3)
    return W.line_items(spark, d).groupBy("invoice_id").agg(F.array_join(F.transform(top, lambda x: x.cast("string")), ",").alias("top"))


@query("t3_two_largest", "with a as (select invoice_id, list_reverse_sort(list(cast(line_total as double))) a from line_items group by 1) select invoice_id, a[1] total, case when a[2] < a[1] * 0.9::double then a[2] end subtotal from a")
def _(spark, d):
    a = W.line_items(spark, d).groupBy("invoice_id").agg(F.sort_array(F.collect_list(F.col("line_total").cast("double")), asc=False).alias("a"))
    one, two = F.try_element_at("a", F.lit(1)), F.try_element_at("a", F.lit(2))
    return a.select("invoice_id", one.alias("total"), F.when(two < one * 0.9, two).alias("subtotal"))


@query("t4_job_listing", "select document_id, stage from pipeline_metrics where success order by ts desc, document_id limit 20 offset 10")
def _(spark, d):
    return W.pipeline_metrics(spark, d).where("success").orderBy(F.col("ts").desc(), "document_id").offset(10).limit(20).select("document_id", "stage")


@query("t5_first_in_queue", "select document_id from pipeline_metrics where not success order by ts, document_id limit 25")
def _(spark, d):
    return W.pipeline_metrics(spark, d).where(~F.col("success")).orderBy("ts", "document_id").limit(25).select("document_id")


@query("t6_curriculum", "select conv_id, turn, least(length(text) / 5000.0::double, 1.0::double) * 0.3::double / 0.3::double difficulty from conversations where least(length(text) / 5000.0::double, 1.0::double) * 0.3::double / 0.3::double <= 0.05 and not regexp_matches(lower(text), 'table|line_items')")
def _(spark, d):
    plain = W.table(spark, d, "conversations").where(~F.lower("text").rlike("table|line_items"))
    return D.curriculum(plain, S.difficulty(F.col("text"), F.lit(None).cast("int")), 0.05, "conv_id", "turn").select("conv_id", "turn", "difficulty")


@query("t7_region_counts", "select region, count(*) n from invoices group by 1 order by n desc, region")
def _(spark, d):
    return W.invoices(spark, d).groupBy("region").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "region")


@query("u1_merge", "select doc_id, 'documents' origin from documents union all select doc_id, 'labels' from labels")
def _(spark, d):
    part = lambda name: W.table(spark, d, name).select("doc_id", F.lit(name).alias("origin"))
    return part("documents").unionByName(part("labels"))


@query("u2_key_differences", "select p.invoice_id, concat_ws(',', case when p.currency is distinct from t.currency then 'currency' end, case when p.vendor is distinct from t.vendor then 'vendor' end) changed from predictions p join (select invoice_id, vendor, currency from invoices) t using (invoice_id)")
def _(spark, d):
    names = F.array(F.lit("currency"), F.lit("vendor"))
    p = W.predictions(spark, d).select("invoice_id", F.struct("currency", "vendor").alias("p"))
    t = W.invoices(spark, d).select("invoice_id", F.struct("currency", "vendor").alias("t"))
    same = F.filter(names, lambda n: F.when(n == "currency", F.col("p.currency").eqNullSafe(F.col("t.currency"))).otherwise(F.col("p.vendor").eqNullSafe(F.col("t.vendor"))))
    return p.join(t, "invoice_id").select("invoice_id", F.array_join(F.array_except(names, same), ",").alias("changed"))


@query("u3_set_similarity", "select invoice_id, pos, cast(len(list_intersect(a, b)) as double) / len(list_distinct(list_concat(a, b))) jaccard from (select t.invoice_id, t.pos, list_distinct(string_split(lower(t.description), ' ')) a, list_distinct(string_split(lower(p.description), ' ')) b from line_items t join predicted_items p on t.invoice_id = p.invoice_id and t.pos = p.pos)")
def _(spark, d):
    both = E.aligned_items(W.line_items(spark, d), W.predicted_items(spark, d)).where("t_qty is not null and p_qty is not null")
    return both.select("invoice_id", F.col("pos").cast("long").alias("pos"), E.jaccard(F.col("t_description"), F.col("p_description")).alias("jaccard"))


@query("u4_run_intersect", "select doc_id from documents intersect select doc_id from labels")
def _(spark, d):
    return W.table(spark, d, "documents").select("doc_id").intersect(W.table(spark, d, "labels").select("doc_id"))


@query("u4_run_except", "select doc_id from documents except all select doc_id from labels")
def _(spark, d):
    return W.table(spark, d, "documents").select("doc_id").exceptAll(W.table(spark, d, "labels").select("doc_id"))


# -------------------------------------------------------------------------------------- training sets


@query("d1_instruction_pairs", "with f as (select invoice_id, 'vendor' kind, vendor answer from invoices union all select invoice_id, 'grand_total', cast(grand_total as varchar) from invoices union all select invoice_id, 'issue_date', cast(issue_date as varchar) from invoices) select invoice_id, kind, case cast('0x' || left(md5(invoice_id || '|' || kind), 8) as bigint) % 3 when 0 then 'Read the ' || replace(kind, '_', ' ') || '.' when 1 then 'What is the ' || replace(kind, '_', ' ') || '?' else 'Give the ' || replace(kind, '_', ' ') || ' of this document.' end prompt, answer from f where answer is not null")
def _(spark, d):
    return D.field_pairs(W.invoices(spark, d), "invoice_id", ["vendor", "grand_total", "issue_date"])


_PICK = "cast('0x' || left(md5(invoice_id || '|' || kind), 8) as bigint) % "
_WORDED = " ".join(f"when '{k}' then [{', '.join(repr(x) for x in q)}][{_PICK}{len(q)} + 1]" for k, q in D.QUESTIONS.items())
#: What an answer must hold: the region or field it names, and a value read from it.
PAIR_PARTS = """select invoice_id, 'full_extraction' kind, t_invoice_id named, t_grand_total amount, n from r union all select invoice_id, 'vendor_block', 'vendor_block', null, 0 from r union all select invoice_id, 'client_info', 'client_info', null, 0 from r union all select invoice_id, 'invoice_metadata', 'invoice_metadata', null, 0 from r
union all select invoice_id, 'line_items', 'line_items', null, n from r union all select invoice_id, 'financial_summary', 'financial_summary', t_grand_total, 0 from r union all select invoice_id, 'invoice_id', 'invoice_id', null, 0 from r union all select invoice_id, 'grand_total', 'grand_total', t_grand_total, 0 from r where t_grand_total is not null
union all select invoice_id, 'vendor_name', 'vendor_name', null, 0 from r where t_name is not null union all select invoice_id, 'due_date', 'due_date', null, 0 from r where t_due_date is not null union all select invoice_id, 'table', null, null, n from r where n > 0
union all select invoice_id, 'reasoning', cast(abs(t_subtotal + t_tax_total - t_discount_total - t_grand_total) <= 0.01 as varchar), t_grand_total, 0 from r where t_grand_total is not null union all select invoice_id, 'summary', t_invoice_id, null, n from r where t_name is not null and t_grand_total is not null"""


#: What is read of an answer in JSON, of whichever kind.
ANSWER = "region string, field string, value string, invoice_id string, agrees string, stated double, financial_summary struct<grand_total: double>, items array<struct<description: string>>, content struct<grand_total: double, items: array<struct<description: string>>>"


@query("d1_pairs_by_kind", f"with n as (select invoice_id, count(*) filter (in_t) n from record_items group by 1), r as (select records.*, coalesce(n, 0) n from records left join n using (invoice_id)), p as ({PAIR_PARTS}) select invoice_id, kind, case kind {_WORDED} end prompt, named, amount, cast(n as bigint) n from p")
def _(spark, d):
    # an answer is read once
    read = F.when(~F.col("kind").isin("table", "summary"), F.from_json("answer", ANSWER))
    out = D.instruction_pairs(W.records(spark, d)).withColumn("r", read)
    at = lambda path: F.col(f"r.{path}")
    named = F.when(F.col("kind") == "summary", F.regexp_extract("answer", "Invoice (INV-[0-9]+)", 1)).when(F.col("kind") == "reasoning", at("agrees")).when(F.col("kind") == "full_extraction", at("invoice_id")).otherwise(F.coalesce(at("region"), at("field")))
    amount = F.when(F.col("kind") == "full_extraction", at("financial_summary.grand_total")).when(F.col("kind") == "financial_summary", at("content.grand_total")).when(F.col("kind") == "grand_total", at("value").cast("double")).when(F.col("kind") == "reasoning", at("stated"))
    n = F.when(F.col("kind") == "full_extraction", F.size(at("items"))).when(F.col("kind") == "line_items", F.size(at("content.items"))).when(F.col("kind") == "table", F.regexp_count("answer", F.lit("\n")) - 1).when(F.col("kind") == "summary", F.regexp_extract("answer", ": ([0-9]+) items", 1).cast("int")).otherwise(0)
    return out.select("invoice_id", "kind", "prompt", named.alias("named"), amount.alias("amount"), n.cast("long").alias("n"))


@query("d1_receipt_pairs", "select invoice_id, kind, answer from (select invoice_id, 'receipt_total' kind, cast(cast(grand_total as double) as varchar) answer from receipts union all select invoice_id, 'receipt_merchant', case when k % 2 = 0 then 'Walmart Supercenter' else 'Corner Shop Inc' end from receipts union all select invoice_id, 'receipt_payment', case when k % 4 = 0 then 'CASH' else 'VISA' end from receipts union all select invoice_id, 'receipt_extraction', cast(invoice_id as varchar) from receipts)")
def _(spark, d):
    out = D.receipt_pairs(X.extract_fields(W.receipt_pages(spark, d), "receipt"))
    return out.select("invoice_id", "kind", F.when(F.col("kind") == "receipt_extraction", F.get_json_object("answer", "$.receipt_no")).otherwise(F.col("answer")).alias("answer"))


def faulty_samples(spark, d):
    """Samples of the vendor block; some broken by fixed rules."""
    i = F.col("invoice_id")
    pairs = D.instruction_pairs(W.records(spark, d), ("vendor_block",)).withColumn("answer", F.when(i % 5 == 0, F.lit("Acme")).when(i % 7 == 0, F.replace("answer", F.lit('"region"'), F.lit('"part"'))).otherwise(F.col("answer")))
    df = D.training_samples(pairs, F.concat(i.cast("string"), F.lit(".png")))
    text = F.when(i % 11 == 0, F.replace("sample", F.lit('"image":'), F.lit('"picture":'))).when(i % 13 == 0, F.replace("sample", F.lit('"conversations":'), F.lit('"talk":'))).when(i % 17 == 0, F.lit('{"image": "a", "conversations": [{"role": "human"}]}')).when(i % 19 == 0, F.replace("sample", F.lit('"human"'), F.lit('"user"'))).when(i % 23 == 0, F.left("sample", F.lit(30))).otherwise(F.col("sample"))
    return df.withColumn("sample", text)


@query("d6_validate_samples", """select invoice_id, case when i % 11 = 0 then 'missing_image' when i % 13 = 0 then 'missing_conversations' when i % 17 = 0 then 'invalid_conversations' when i % 19 <> 0 and i % 23 = 0 then 'invalid_json' when i % 5 = 0 then 'answer_no_json' end error,
 case when i % 11 = 0 or i % 13 = 0 or i % 17 = 0 or (i % 19 <> 0 and i % 23 = 0) then '' else concat_ws(',', case when i % 19 = 0 then 'first_not_human' end, case when i % 5 <> 0 and i % 7 = 0 then 'no_region' end) end warnings from (select invoice_id, invoice_id i from records)""")
def _(spark, d):
    return D.validate_samples(faulty_samples(spark, d)).select("invoice_id", "error", F.array_join("warnings", ",").alias("warnings"))


@query("d2_region_samples", "select invoice_id, 'vendor' region, vendor text from invoices where vendor is not null union all select invoice_id, 'line_items', string_agg(description, '; ' order by pos) from line_items group by 1 union all select invoice_id, 'totals', subtotal || ' + ' || tax || ' = ' || grand_total from invoices where grand_total is not null")
def _(spark, d):
    return D.region_samples(W.invoices(spark, d), W.line_items(spark, d))


@query("d3_prompt_completion", "select conv_id, turn, prompt, text completion from (select *, lag(text) over (partition by conv_id order by turn) prompt, lag(role) over (partition by conv_id order by turn) r from conversations) where role = 'assistant' and r = 'user'")
def _(spark, d):
    return D.prompt_completion(W.table(spark, d, "conversations"))


@query("d3_conversation_text", "select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) text from conversations group by 1")
def _(spark, d):
    return D.conversations(W.table(spark, d, "conversations"), "conv_id")


@query("d4_split", "select doc_id, case when p < 80 then 'train' when p < 90 then 'validation' else 'test' end split from (select doc_id, cast('0x' || left(md5(cast(doc_id as varchar)), 8) as bigint) % 100 p from documents)")
def _(spark, d):
    return D.split(W.table(spark, d, "documents").select("doc_id"), "doc_id", {"train": 80, "validation": 10, "test": 10})


@query("d5_sample_each", "select invoice_id, pos from (select invoice_id, pos, row_number() over (partition by invoice_id order by cast('0x' || left(md5(invoice_id || '|' || pos), 8) as bigint), pos) k from line_items) where k <= 2")
def _(spark, d):
    return D.sample_each(W.line_items(spark, d), "invoice_id", 2, "invoice_id", "pos").select("invoice_id", "pos")


@query("d6_validate_pairs", "with s as (select *, min(turn) filter (role <> 'system') over (partition by conv_id) s from conversations), k as (select *, row_number() over (partition by conv_id order by turn) k from s where turn >= s) select conv_id, count(*) turns, count(*) < 2 too_short, max(role) filter (k = 1) <> 'user' first_wrong, coalesce(max(role) filter (k = 2) <> 'assistant', true) second_wrong from k group by 1")
def _(spark, d):
    return D.validate_pairs(W.table(spark, d, "conversations"))


@query("d7_curriculum", f"select conv_id, turn, x difficulty from (select conv_id, turn, {DIFFICULTY} x from (select *, case when turn % 2 = 0 then turn end n, regexp_matches(lower(text), 'table|line_items') t from conversations)) where x <= 0.3::double + 0.7::double * (1 - cos(pi() / 8))")
def _(spark, d):
    turns = W.table(spark, d, "conversations")
    score = S.difficulty(F.col("text"), F.when(F.col("turn") % 2 == 0, F.col("turn")))
    return D.curriculum(turns, score, S.curriculum_threshold(0.25, schedule="cosine"), "conv_id", "turn").select("conv_id", "turn", "difficulty")


@query("d8_review_queue", """with x as (select invoice_id, confidence, coalesce(abs(items_total - subtotal) > 0.01, false) i, coalesce(abs(total - (coalesce(subtotal, 0) + coalesce(tax, 0) - coalesce(discount, 0))) > 0.01, false) t from declared)
select invoice_id, case when i and t then 'hard' when i or t then 'medium' else 'easy' end difficulty, case when i then 'SUBTOTAL_MISMATCH' when t then 'TOTAL_MISMATCH' end first_issue from x where i or t or confidence < 0.6""")
def _(spark, d):
    return D.review_queue(V.validate_arithmetic(W.declared(spark, d)))


@query("d10_exploded_pairs", "select invoice_id, pos, 'Total of ' || description || '?' prompt, cast(line_total as varchar) answer from line_items")
def _(spark, d):
    lines = W.line_items(spark, d).groupBy("invoice_id").agg(F.collect_list(F.struct("pos", "description", "line_total")).alias("pairs"))
    return lines.select("invoice_id", F.explode("pairs").alias("p")).select("invoice_id", F.col("p.pos").cast("long").alias("pos"), F.concat(F.lit("Total of "), "p.description", F.lit("?")).alias("prompt"), F.col("p.line_total").cast("string").alias("answer"))


@query("d11_few_shot", "select doc_id, md5('A bill: invoice' || chr(10) || chr(10) || 'Document: ' || text || chr(10) || chr(10) || 'Answer:') digest from documents")
def _(spark, d):
    out = D.few_shot(W.table(spark, d, "documents"), "A bill: invoice", "text")
    return out.select("doc_id", F.md5(F.col("prompt").cast("binary")).alias("digest"))
