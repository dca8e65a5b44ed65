"""Training sets from documents: pairs, splits, checks and order."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.operators.validate import json_kind


def place(key: Column) -> Column:
    """The first 32 bits of the MD5 of the key as text; any SQL engine gives the same number."""
    return F.conv(F.left(F.md5(key.cast("string").cast("binary")), F.lit(8)), 16, 10).cast("long")


def bucket(key: Column, n: int) -> Column:
    """A place in 0..n-1 that depends on the key alone, so that it holds when data grow."""
    return place(key) % n


def split(df: DataFrame, key: str, shares: dict[str, int]) -> DataFrame:
    """``split`` by shares of 100 of the hashed key."""
    at, upto, out = bucket(F.col(key), 100), 0, None
    for name, share in shares.items():
        upto += share
        out = F.when(at < upto, name) if out is None else out.when(at < upto, name)
    return df.withColumn("split", out)


TEMPLATES = ("Read the {0}.", "What is the {0}?", "Give the {0} of this document.")


def field_pairs(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, kind, prompt, answer): a question for each field that has a value; wording by hash of key and field."""
    rows = F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("answer")) for c in columns))
    out = df.select(key, F.inline(rows)).where("answer IS NOT NULL")
    at = bucket(F.concat_ws("|", F.col(key).cast("string"), "kind"), len(TEMPLATES)).cast("int")
    template = F.element_at(F.array(*(F.lit(t) for t in TEMPLATES)), at + 1)
    return out.select(key, "kind", F.replace(template, F.lit("{0}"), F.replace("kind", F.lit("_"), F.lit(" "))).alias("prompt"), "answer")


#: What is asked for each kind of pair; the wording goes by a hash of document and kind.
QUESTIONS = {
    "full_extraction": ("Give all data of this document as JSON.", "Read the whole document into JSON.", "Turn this invoice into structured data."), "vendor_block": ("Who issued this document? Answer as JSON.", "Give the vendor block."),
    "client_info": ("Who is billed? Answer as JSON.", "Give the client block."), "invoice_metadata": ("Give number, dates and terms as JSON.", "Read the header data."), "line_items": ("List all lines as JSON.", "Read the table of items."),
    "financial_summary": ("Give all amounts as JSON.", "Read the totals."), "invoice_id": ("What is the invoice number?",), "grand_total": ("What is the total amount due?",), "vendor_name": ("What is the vendor name?",), "due_date": ("What is the due date?",),
    "table": ("Write the items as a table.", "Give the lines in markdown."), "reasoning": ("Do the amounts add up? Show the sum.", "Check the total step by step."), "summary": ("Sum this document up in a sentence.", "What is this document about?"),
}


def asked(key: Column, kind: Column, first: Column, n: Column) -> Column:
    """One of the n wordings of a kind, which stand from place ``first`` of all; hashed only where there is a choice."""
    words = F.array(*(F.lit(x) for q in QUESTIONS.values() for x in q))
    return F.get(words, first + F.when(n > 1, place(F.concat_ws("|", key.cast("string"), kind)) % n).otherwise(0).cast("int"))


def instruction_pairs(df: DataFrame, kinds: tuple[str, ...] = tuple(QUESTIONS), side: str = "t", key: str = "invoice_id") -> DataFrame:
    """(key, kind, prompt, answer) of nested records: the whole as JSON, each region as ``{region, content}``, single
    fields as ``{field, value}``, the lines as a markdown table, the sum step by step as JSON, and a sentence. What has no
    value gives no pair of its field; everything happens in the row."""
    at = lambda c: F.col(f"{side}.{c}")
    region = lambda name, content: F.to_json(F.struct(F.lit(name).alias("region"), content.alias("content")))
    field = lambda name, value: F.when(value.isNotNull(), F.to_json(F.struct(F.lit(name).alias("field"), value.alias("value"))))
    meta = F.struct(*(at(c).alias(c) for c in ("invoice_id", "issue_date", "due_date", "payment_terms")))
    items = F.coalesce(at("items"), F.array().cast(df.schema[side].dataType["items"].dataType))
    money = at("financial")
    row = lambda x: F.concat(F.lit("| "), F.concat_ws(" | ", x["description"], *(F.format_number(x[c], 2) for c in ("quantity", "unit_price", "line_total"))), F.lit(" |"))
    table = F.array_join(F.concat(F.array(F.lit("| description | quantity | unit price | total |"), F.lit("|---|---|---|---|")), F.transform(items, row)), "\n")
    total = money["subtotal"] + money["tax_total"] - money["discount_total"]
    steps = F.to_json(F.struct(*(money[c].alias(c) for c in ("subtotal", "tax_total", "discount_total")), F.round(total, 2).alias("sum"), money["grand_total"].alias("stated"), (F.abs(total - money["grand_total"]) <= 0.01).alias("agrees")))
    sentence = F.concat(F.lit("Invoice "), at("invoice_id"), F.lit(" of "), at("vendor.name"), F.lit(" for "), at("client.name"), F.lit(": "), F.size(items).cast("string"), F.lit(" items, "), F.format_number(money["grand_total"], 2), F.lit(" "), money["currency"], F.lit("."))
    answers = {
        "full_extraction": F.to_json(F.struct(*(at(c).alias(c) for c in ("invoice_id", "vendor", "client", "issue_date", "due_date", "payment_terms")), items.alias("items"), money.alias("financial_summary"))),
        "vendor_block": region("vendor_block", at("vendor")), "client_info": region("client_info", at("client")), "invoice_metadata": region("invoice_metadata", meta), "line_items": region("line_items", F.struct(items.alias("items"))), "financial_summary": region("financial_summary", money),
        "invoice_id": field("invoice_id", at("invoice_id")), "grand_total": field("grand_total", money["grand_total"]), "vendor_name": field("vendor_name", at("vendor.name")), "due_date": field("due_date", at("due_date")),
        "table": F.when(F.size(items) > 0, table), "reasoning": F.when(total.isNotNull() & money["grand_total"].isNotNull(), steps), "summary": sentence,
    }
    sizes = {k: len(q) for k, q in QUESTIONS.items()}
    first = dict(zip(sizes, accumulate(sizes.values(), initial=0)))
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(first[k]).alias("first"), F.lit(sizes[k]).alias("n"), answers[k].alias("answer")) for k in kinds))
    out = df.select(key, F.inline(pairs)).where("answer IS NOT NULL")
    return out.select(key, "kind", asked(F.col(key), F.col("kind"), F.col("first"), F.col("n")).alias("prompt"), "answer")


#: What is asked of receipts: question and the column that answers, or all.
RECEIPT_QUESTIONS = {"receipt_extraction": ("Read this receipt into JSON.", None), "receipt_total": ("What was paid in total?", "total"), "receipt_merchant": ("Which shop is this?", "merchant"), "receipt_payment": ("How was it paid?", "method")}


def receipt_pairs(fields: DataFrame, key: str = "invoice_id") -> DataFrame:
    """(key, kind, prompt, answer) of receipts' fields; a field without value is not asked for."""
    whole = F.to_json(F.struct(*(c for c in fields.columns if c != key)))
    rows = [F.struct(F.lit(k).alias("kind"), F.lit(q).alias("prompt"), (whole if c is None else F.col(c).cast("string")).alias("answer")) for k, (q, c) in RECEIPT_QUESTIONS.items()]
    return fields.select(key, F.inline(F.array(*rows))).where("answer IS NOT NULL")


def training_samples(pairs: DataFrame, image: Column, key: str = "invoice_id") -> DataFrame:
    """(key, kind, sample): each pair as a JSON line of an image and a conversation of a human and an assistant."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    talk = F.array(turn("human", F.concat(F.lit("<image>\n"), "prompt")), turn("assistant", F.col("answer")))
    return pairs.select(key, "kind", F.to_json(F.struct(image.alias("image"), talk.alias("conversations"))).alias("sample"))


def validate_samples(df: DataFrame, column: str = "sample") -> DataFrame:
    """``df`` with ``errors`` (the first that applies: no JSON, no image, no conversations, not two turns in a list, an answer
    that is no JSON) and ``warnings`` (first turn is no human, second no assistant, answer without region or content)."""
    value = F.try_parse_json(column)
    get = lambda v, path, kind="variant": F.try_variant_get(v, path, kind)
    turns = get(value, "$.conversations", "array<variant>")
    role = lambda k: get(value, f"$.conversations[{k}].role", "string")
    answer = F.try_parse_json(F.coalesce(get(value, "$.conversations[1].content", "string"), F.lit("")))
    has = lambda path: json_kind(get(answer, path)).isNotNull()
    error = (
        F.when(value.isNull(), "invalid_json").when(json_kind(get(value, "$.image")).isNull(), "missing_image").when(json_kind(get(value, "$.conversations")).isNull(), "missing_conversations")
        .when((json_kind(get(value, "$.conversations")) != "list") | (F.coalesce(F.size(turns), F.lit(0)) < 2), "invalid_conversations").when(answer.isNull(), "answer_no_json")
    )
    spoken = value.isNotNull() & (F.coalesce(F.size(turns), F.lit(0)) >= 2)
    told = F.array(
        F.when(spoken & ~role(0).eqNullSafe(F.lit("human")), "first_not_human"), F.when(spoken & ~role(1).eqNullSafe(F.lit("assistant")), "second_not_assistant"),
        F.when(answer.isNotNull() & error.isNull() & ~has("$.region"), "no_region"), F.when(answer.isNotNull() & error.isNull() & ~has("$.content"), "no_content"),
    )
    early = error.isin("invalid_json", "missing_image", "missing_conversations", "invalid_conversations")
    warnings = F.when(F.coalesce(early, F.lit(False)), F.array().cast("array<string>")).otherwise(F.filter(told, lambda x: x.isNotNull()))
    return df.withColumns({"error": error, "warnings": warnings})


def region_samples(df: DataFrame, items: DataFrame) -> DataFrame:
    """(invoice_id, region, text): vendor, line item and totals samples."""
    lines = items.groupBy("invoice_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "description"))), lambda x: x["description"]).alias("d")).select("invoice_id", F.lit("line_items").alias("region"), F.array_join("d", "; ").alias("text"))
    vendor = df.where("vendor IS NOT NULL").select("invoice_id", F.lit("vendor"), F.col("vendor"))
    totals = df.where("grand_total IS NOT NULL").select("invoice_id", F.lit("totals"), F.concat(F.col("subtotal").cast("string"), F.lit(" + "), F.col("tax").cast("string"), F.lit(" = "), F.col("grand_total").cast("string")))
    return vendor.toDF("invoice_id", "region", "text").unionAll(lines).unionAll(totals.toDF("invoice_id", "region", "text"))


def conversations(df: DataFrame, key: str) -> DataFrame:
    """(key, text): turns in order as one training text, roles named."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    return df.groupBy(key).agg(F.array_join(turns, "\n").alias("text"))


def prompt_completion(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turn, prompt, completion): each assistant turn after a user turn."""
    order = Window.partitionBy(key).orderBy("turn")
    prev = df.withColumn("prompt", F.lag("text").over(order)).withColumn("__role", F.lag("role").over(order))
    return prev.where("role = 'assistant' and __role = 'user'").select(key, "turn", "prompt", F.col("text").alias("completion"))


def validate_pairs(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """Errors (under two turns) and warnings (first is no user, second no assistant) of each conversation; a
    leading system turn is passed over. Roles are ranked within one conversation."""
    order = Window.partitionBy(key).orderBy("turn")
    spoken = df.withColumn("__s", F.min(F.when(F.col("role") != "system", F.col("turn"))).over(Window.partitionBy(key))).where("turn >= __s")
    rank = spoken.withColumn("k", F.row_number().over(order))
    out = rank.groupBy(key).agg(F.count("*").alias("turns"), F.max(F.when(F.col("k") == 1, F.col("role"))).alias("first"), F.max(F.when(F.col("k") == 2, F.col("role"))).alias("second"))
    return out.select(key, "turns", (F.col("turns") < 2).alias("too_short"), (F.col("first") != "user").alias("first_wrong"), F.coalesce(F.col("second") != "assistant", F.lit(True)).alias("second_wrong"))


def sample_each(df: DataFrame, key: str, n: int, *order: str) -> DataFrame:
    """At most n rows of each key, by hash order."""
    w = Window.partitionBy(key).orderBy(place(F.concat_ws("|", *(F.col(c).cast("string") for c in order))), *order)
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def curriculum(df: DataFrame, score: Column, threshold: float, *ties: str) -> DataFrame:
    """Samples up to the threshold, easiest first."""
    return df.withColumn("difficulty", score).where(F.col("difficulty") <= threshold).orderBy("difficulty", *ties)


def review_queue(df: DataFrame, low: float = 0.6) -> DataFrame:
    """Validated invoices to be looked at: a label of difficulty and the first issue."""
    bad = df.where(~F.col("math_ok") | (F.col("confidence") < low))
    label = F.when(F.size("issues") > 1, "hard").when(F.size("issues") == 1, "medium").otherwise("easy")
    return bad.select("invoice_id", label.alias("difficulty"), F.try_element_at("issues", F.lit(1))["code"].alias("first_issue"))


def few_shot(df: DataFrame, examples: str, text: str) -> DataFrame:
    """``prompt``: fixed examples, then the document's text."""
    return df.withColumn("prompt", F.concat_ws("\n\n", F.lit(examples), F.concat(F.lit("Document: "), F.col(text)), F.lit("Answer:")))
