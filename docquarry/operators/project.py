"""Projections, classifications, merges and redaction of document records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(df: DataFrame) -> DataFrame:
    """Records under their canonical names with defaults: total 0, currency USD."""
    return df.select(F.col("invoice_id").alias("document_id"), F.col("vendor").alias("vendor_name"), F.date_format("issue_date", "yyyy-MM-dd").alias("date"), F.coalesce("grand_total", F.lit(0)).cast("double").alias("total"), F.coalesce("currency", F.lit("USD")).alias("currency"), F.coalesce("n_items", F.lit(0)).alias("items"))


def with_date(df: DataFrame, text: str) -> DataFrame:
    """``date`` by ISO then month-first; null with ``date_defaulted`` where neither fits."""
    date = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text, F.lit("MM/dd/yyyy"))).cast("date")
    return df.withColumn("date", date).withColumn("date_defaulted", F.col("date").isNull())


def fill(df: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Missing, empty or zero values from another source; what is there is never replaced."""
    def missing(c: str) -> Column:
        return F.col(c).isNull() | F.col(c).cast("string").isin("", "0", "0.0", "0.00")

    o = other.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    return df.join(o, key, "left").withColumns({c: F.when(missing(c), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).drop(*(f"__{c}" for c in columns))


def standardise(df: DataFrame, rate: str = "0.10") -> DataFrame:
    """A summary where none is stated: subtotal from the lines, tax by the rate, total from both."""
    subtotal = F.coalesce("items_total", F.lit(0)).cast("decimal(18,2)")
    tax = F.coalesce("tax", F.round(subtotal * F.lit(rate).cast("decimal(4,2)"), 2)).cast("decimal(18,2)")
    return df.withColumn("subtotal", F.coalesce("subtotal", subtotal)).withColumn("tax", tax).withColumn("total", F.coalesce("total", (subtotal + tax).cast("decimal(18,2)")))


def long_fields(df: DataFrame, key: str, columns: list[str], source: str) -> DataFrame:
    """(key, field, value, value_num, source, lineage): one row for each field that has a value; lineage is a
    hash of key and field, the same in every run."""
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))
    lineage = F.sha2(F.concat_ws("|", F.col(key).cast("string"), "field").cast("binary"), 256)
    out = df.select(key, F.inline(rows)).where("value IS NOT NULL")
    return out.select(key, "field", "value", F.col("value").try_cast("double").alias("value_num"), F.lit(source).alias("source"), lineage.alias("lineage"))


#: Patterns of personal data in the order they are taken out; fixed values.
PII = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "card": r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b",
}


def redact(c: Column, patterns: dict[str, str] | None = None) -> Column:
    for p in (patterns or PII).values():
        c = F.regexp_replace(c, p, "[REDACTED]")
    return c


def redacted(df: DataFrame, key: str) -> DataFrame:
    """Every string of every column but the key redacted, inside structs and arrays too."""
    def walk(kind: T.DataType, c: Column) -> Column:
        if isinstance(kind, T.StringType):
            return redact(c)
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*(walk(f.dataType, c[f.name]).alias(f.name) for f in kind)))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: walk(kind.elementType, x))
        return c

    return df.select(*(F.col(f.name) if f.name == key else walk(f.dataType, F.col(f.name)).alias(f.name) for f in df.schema))


def pii_counts(text: Column) -> dict[str, Column]:
    """How often each class stands in a text, counted before anything is taken out."""
    return {k: F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)).cast("long") for k, p in PII.items()}


def first_keyword(c: Column, kinds: dict[str, str], otherwise: str | None = None) -> Column:
    """The first kind whose pattern a lower-cased text has."""
    low, out = F.lower(c), None
    for kind, pattern in kinds.items():
        out = F.when(low.rlike(pattern), kind) if out is None else out.when(low.rlike(pattern), kind)
    return out if otherwise is None else out.otherwise(otherwise)


#: Keywords of document kinds by file name, by text, and of receipts; fixed values.
BY_NAME = {"invoice": "invoice|inv|bill", "receipt": "receipt", "statement": "statement|stmt", "contract": "contract|agreement"}
BY_TEXT = {"invoice": "invoice|bill to", "bank_statement": "statement|closing balance", "receipt": "receipt|thank you|purchase|transaction"}
RECEIPTS = {"restaurant": "burger|pizza|restaurant|menu|tip", "grocery": "grocery|supermarket|walmart|target|kroger", "pharmacy": "pharmacy|rx|prescription|cvs|walgreens", "gas": "gas|petrol|fuel|station"}


def challenge(df: DataFrame) -> DataFrame:
    """Challenge category of an invoice: by number of lines, kind, and for foreign currencies a fixed share."""
    share = F.pmod(F.col("invoice_id"), F.lit(10)) < 3
    kind = (
        F.when(F.col("n_items") > 25, "multi_page").when((F.col("priority") == "1-URGENT") | (F.col("n_items") > 15), "complex_table").when(F.col("status") == "P", "visual_noise")
        .when(~F.col("currency").isin("USD", "EUR") & share, "multi_currency").when(F.col("n_items") > 10, "dense_data").otherwise("key_value")
    )
    return df.withColumn("challenge", kind)


def page_flags(pages: DataFrame, key: str) -> DataFrame:
    """From page texts (key, page from 0, text): text layer, sparse, several pages, tables on the first."""
    n = F.length("text")
    return pages.groupBy(key).agg(
        F.max((F.col("page") < 3) & (n > 50)).alias("has_text"), (F.sum(n) < 100).alias("sparse"), (F.count("*") > 1).alias("several"), F.max((F.col("page") == 0) & (F.size(F.split("text", r"\n")) > 10)).alias("has_tables"),
    )


def file_checks(df: DataFrame, name: str, content: str, least: int = 100, most: int = 50 << 20, allowed: tuple[str, ...] = ("pdf", "png", "jpg", "jpeg", "tiff")) -> DataFrame:
    """extension, size, sha256, kind (by extension, then magic bytes) and why a file is refused."""
    ext, size = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)), F.octet_length(content)
    data = F.col(content).cast("binary")
    kind = F.when(ext == "pdf", "pdf").when(ext.isin("png", "jpg", "jpeg", "tiff"), "image").when(F.startswith(data, F.lit(b"%PDF")), "pdf").when(F.startswith(data, F.lit(bytes.fromhex("89504e47"))) | F.startswith(data, F.lit(bytes.fromhex("ffd8ff"))), "image").otherwise("unknown")
    refused = F.when(~ext.isin(*allowed), "extension").when(size < least, "too_small").when(size > most, "too_large")
    return df.withColumns({"extension": ext, "size": size, "sha256": F.sha2(data, 256), "kind": kind, "refused": refused})


def features(df: DataFrame) -> DataFrame:
    """Numbers and calendar parts of an invoice for a feature table; weekday 0 is Monday."""
    rate = F.when(F.col("subtotal") > 0, F.coalesce(F.col("tax"), F.lit(0)).cast("double") / F.col("subtotal").cast("double")).otherwise(F.lit(0.0))
    return df.select("invoice_id", F.coalesce("grand_total", F.lit(0)).cast("double").alias("total_amount"), F.col("n_items").alias("line_item_count"), "currency", rate.alias("tax_rate"), F.year("issue_date").alias("year"), F.month("issue_date").alias("month"), F.weekday("issue_date").alias("weekday"))


def document_text(df: DataFrame, items: DataFrame) -> DataFrame:
    """One text for each invoice: vendor, id, date and what its lines describe."""
    lines = items.groupBy("invoice_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "description"))), lambda x: x["description"]).alias("__d"))
    parts = (F.concat(F.lit("Vendor: "), "vendor"), F.concat(F.lit("Invoice ID: "), F.col("invoice_id").cast("string")), F.concat(F.lit("Date: "), F.date_format("issue_date", "yyyy-MM-dd")), F.array_join("__d", " "))
    return df.join(lines, "invoice_id", "left").select("invoice_id", F.concat_ws(" ", *parts).alias("text"))


def flat_export(df: DataFrame) -> DataFrame:
    """The nine columns of the flat export."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.select(F.col("invoice_id").cast("string").alias("doc_id"), F.coalesce("vendor", F.lit("")).alias("vendor_name"), F.concat(F.lit("INV-"), F.col("invoice_id").cast("string")).alias("invoice_number"), F.date_format("issue_date", "yyyy-MM-dd").alias("issue_date"), text("subtotal").alias("subtotal"), text("tax").alias("tax_amount"), text("grand_total").alias("grand_total"), F.coalesce("currency", F.lit("USD")).alias("currency"), F.lit("completed").alias("status"))


def accounting_export(df: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each line; an invoice without lines gives one (Service, 1, total, total)."""
    i = items.select("invoice_id", "description", F.col("qty").cast("double").alias("qty"), F.col("unit_price").cast("double").alias("rate"), F.col("line_total").cast("double").alias("amount"))
    out = df.select("invoice_id", F.col("grand_total").cast("double").alias("__total"), "client").join(i, "invoice_id", "left")
    none, total = F.col("description").isNull(), F.coalesce(F.col("__total"), F.lit(0.0))
    return out.select("invoice_id", "client", F.coalesce("description", F.lit("Service")).alias("item"), F.when(none, 1.0).otherwise(F.col("qty")).alias("qty"), F.when(none, total).otherwise(F.col("rate")).alias("rate"), F.when(none, total).otherwise(F.col("amount")).alias("amount"))


def markdown(df: DataFrame, items: DataFrame) -> DataFrame:
    """A report for each invoice: heading, table of lines, totals."""
    row = F.concat(F.lit("| "), "description", F.lit(" | "), F.col("qty").cast("bigint").cast("string"), F.lit(" | "), F.col("line_total").cast("string"), F.lit(" |"))
    table = items.select("invoice_id", "pos", row.alias("row")).groupBy("invoice_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "row"))), lambda x: x["row"]).alias("__r"))
    parts = (F.concat(F.lit("# Invoice "), F.col("invoice_id").cast("string")), F.concat(F.lit("Vendor: "), "vendor"), F.lit("| description | quantity | total |"), F.lit("| --- | --- | --- |"), F.array_join("__r", "\n"), F.concat(F.lit("Total: "), F.col("grand_total").cast("string")))
    return df.join(table, "invoice_id").select("invoice_id", F.concat_ws("\n", *parts).alias("text"))


def html_table(items: DataFrame) -> DataFrame:
    """An HTML table of the lines of each invoice."""
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell(F.col("description")), cell(F.col("qty").cast("bigint").cast("string")), cell(F.col("line_total").cast("string")), F.lit("</tr>"))
    rows = items.select("invoice_id", "pos", row.alias("row")).groupBy("invoice_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "row"))), lambda x: x["row"]).alias("__r"))
    return rows.select("invoice_id", F.concat(F.lit("<table>"), F.array_join("__r", ""), F.lit("</table>")).alias("html"))


def compare_documents(a: DataFrame, b: DataFrame, key: str = "invoice_id") -> DataFrame:
    """Lines of two documents matched by description within a key: added, deleted, price or quantity changed,
    or matching, with the differences."""
    side = lambda df, p: df.groupBy(key, F.lower(F.trim("description")).alias("item")).agg(F.sum("qty").alias(f"{p}_qty"), F.sum("line_total").cast("decimal(18,2)").alias(f"{p}_total"))
    df = side(a, "a").join(side(b, "b"), [key, "item"], "full")
    kind = F.when(F.col("a_qty").isNull(), "added").when(F.col("b_qty").isNull(), "deleted").when(F.col("a_qty") != F.col("b_qty"), "quantity_changed").when(F.col("a_total") != F.col("b_total"), "price_changed").otherwise("match")
    difference = (F.coalesce("b_total", F.lit(0)) - F.coalesce("a_total", F.lit(0))).cast("double")
    return df.select(key, "item", kind.alias("kind"), difference.alias("difference"))


def comparison_status(lines: DataFrame, key: str = "invoice_id") -> DataFrame:
    """match, partial_match or mismatch of two documents and the total difference."""
    n, same = F.count("*"), F.count_if(F.col("kind") == "match")
    return lines.groupBy(key).agg(F.when(n == same, "match").when(same > 0, "partial_match").otherwise("mismatch").alias("status"), F.sum(F.col("difference").cast("decimal(18,2)")).cast("double").alias("difference"))
