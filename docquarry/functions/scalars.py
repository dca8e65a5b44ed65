"""Scalar functions of document processing as Column expressions; ``register`` makes them SQL functions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def clean_text(c: Column) -> Column:
    """White space runs to one space, control characters out, trimmed; in that order."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"[\x00-\x1f\x7f-\x9f]", ""))


def parse_number(c: Column) -> Column:
    """Digits and dots as a number, else 0; a sign is lost."""
    return F.coalesce(F.regexp_replace(c, r"[^\d.]", "").try_cast("double"), F.lit(0.0))


def normalize_currency(c: Column) -> Column:
    """As parse_number, with a minus kept."""
    return F.coalesce(F.regexp_replace(c, r"[^\d.\-]", "").try_cast("double"), F.lit(0.0))


def safe_float(c: Column) -> Column:
    """Without commas and dollar signs, null if it is no number."""
    return F.regexp_replace(c, "[,$]", "").try_cast("double")


def parse_mixed_number(c: Column, item: bool = False) -> Column:
    """1.234,56 when both marks stand; a lone comma is decimal before two digits (in ``item`` text always), else
    parts thousands. 0 for no number."""
    t = F.regexp_replace(c, r"[^\d.,\-]", "")
    comma, dot = F.contains(t, F.lit(",")), F.contains(t, F.lit("."))
    decimal_comma = F.lit(True) if item else t.rlike(r"^[^,]*,\d{2}$") | t.rlike(r"^[^,]*,[^,]{2}$")
    plain = F.when(comma & dot, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(comma & decimal_comma, F.replace(t, F.lit(","), F.lit("."))).when(comma, F.replace(t, F.lit(","), F.lit(""))).otherwise(t)
    return F.coalesce(plain.try_cast("double"), F.lit(0.0))


def amount_of(c: Column) -> Column:
    """The first amount in a text, half up to cents; null without one."""
    return F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"(-?\d+(?:\.\d{1,4})?)", 1).try_cast("decimal(18,4)").cast("decimal(18,2)")


#: ISO codes and leading symbols that amounts carry; fixed values.
CODES = ("USD", "EUR", "GBP", "JPY", "INR", "AUD", "CAD", "CNY", "CHF")
SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "A$": "AUD", "C$": "CAD"}
ALIASES = {"$": "USD", "US$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "DOLLARS": "USD", "EUROS": "EUR"}


def parse_currency(c: Column, default: str = "USD") -> Column:
    """struct(amount, currency): a code with a number after it, else a leading symbol, else bare digits."""
    t = F.upper(F.replace(F.trim(c), F.lit(","), F.lit("")))
    by_code = [F.when(F.regexp_extract(t, rf"{k}\s*(-?[\d.]+)\s*$", 1) != "", F.struct(F.regexp_extract(t, rf"{k}\s*(-?[\d.]+)\s*$", 1).try_cast("double").alias("amount"), F.lit(k).alias("currency"))) for k in CODES]
    by_symbol = [F.when(F.startswith(t, F.lit(s)) & F.replace(t, F.lit(s), F.lit("")).try_cast("double").isNotNull(), F.struct(F.replace(t, F.lit(s), F.lit("")).try_cast("double").alias("amount"), F.lit(k).alias("currency"))) for s, k in SYMBOLS.items()]
    seen = F.coalesce(*(F.when(F.contains(t, F.lit(k)), F.lit(k)) for k in reversed(CODES)), F.lit(default))
    bare = F.struct(F.regexp_replace(t, r"[^\d.\-]", "").try_cast("double").alias("amount"), seen.alias("currency"))
    return F.coalesce(*by_code, *by_symbol, bare)


def currency_alias(c: Column) -> Column:
    """The code an alias stands for; anything else as it is."""
    m = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    return F.coalesce(m[F.upper(F.trim(c))], c)


def detect_currency(c: Column) -> Column:
    """The first of USD, EUR, GBP, JPY whose sign or name a text holds."""
    return F.when(c.rlike(r"\$|USD|(?i)dollars?"), "USD").when(c.rlike(r"€|EUR|(?i)euros?"), "EUR").when(c.rlike(r"£|GBP|(?i)pounds?"), "GBP").when(c.rlike(r"¥|JPY|(?i)yen"), "JPY")


def parse_date(c: Column, formats: tuple[str, ...]) -> Column:
    """The first format that fits, in order; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)).cast("date") for f in formats))


ISO_FIRST = ("yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd")
DAY_FIRST = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "dd MMM yyyy")


def is_numeric(c: Column) -> Column:
    return c.rlike(r"^[$€£¥]?\s*-?[\d.,]+%?$")


def is_date(c: Column) -> Column:
    return c.rlike(r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2}")


def is_total_keyword(c: Column) -> Column:
    return F.lower(c).rlike(r"total|amount due|balance")


def token_overlap(a: Column, b: Column) -> Column:
    """Share of the words of a that b has; 0 without words."""
    x, y = F.array_distinct(F.split(F.lower(a), " ")), F.split(F.lower(b), " ")
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x)).otherwise(F.lit(0.0))


def json_of(c: Column) -> Column:
    """The JSON object a text holds: the text itself, a fenced block, or from the first to the last brace."""
    fence, braces = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    valid = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(valid(F.when(F.startswith(F.trim(c), F.lit("{")), c)), valid(F.nullif(fence, F.lit(""))), valid(F.nullif(braces, F.lit(""))))


def money_text(value: Column, currency: Column) -> Column:
    """$1,234.56, EUR 1,234.56, or N/A."""
    text = F.format_number(value.cast("decimal(18,2)"), 2)
    return F.when(value.isNull(), "N/A").when(currency == "USD", F.concat(F.lit("$"), text)).otherwise(F.concat(currency, F.lit(" "), text))


def tax_rate(tax: Column, subtotal: Column) -> Column:
    return F.when(subtotal > 0, tax.cast("double") / subtotal.cast("double")).otherwise(F.lit(0.0))


def relative_error(truth: Column, value: Column) -> Column:
    return F.abs(truth - value).cast("double") / F.greatest(F.abs(truth).cast("double"), F.lit(1.0))


#: Patterns of contact details; fixed values.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?\d{0,2}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}"
TAX_ID = r"(?i)(?:tax id|vat|ein)[\s:#]*([A-Z0-9-]{5,})"


def email_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, f"({EMAIL})", 1), F.lit(""))


def phone_of(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, f"({PHONE})", 1)), F.lit(""))


def tax_id_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, TAX_ID, 1), F.lit(""))


def line_total(qty: Column, price: Column, rate: Column, discount: Column) -> Column:
    """qty x price x (1 + rate / 100) - discount, half up to cents; null beyond the range of amounts."""
    money = lambda x: x.try_cast("decimal(12,2)")
    factor = (1 + rate.try_cast("decimal(5,2)") / 100).cast("decimal(8,4)")
    return F.round(money(qty) * money(price) * factor - money(discount), 2).try_cast("decimal(18,2)")


def content_key(c: Column, *more: Column) -> Column:
    """sha256 of the parts, joined by colons."""
    return F.sha2(F.concat_ws(":", c, *more).cast("binary"), 256)


def difficulty(text: Column, fields: Column) -> Column:
    """0..1 from length (of 5000, weight .3), number of fields (of 50, .3; null does not count) and whether a
    table stands in it (.4), over the weights that count."""
    length, some = F.least(F.length(text) / 5000.0, F.lit(1.0)) * 0.3, F.least(fields / 50.0, F.lit(1.0)) * 0.3
    table = F.lower(text).rlike("table|line_items")
    weights = F.lit(0.3) + F.when(fields.isNotNull(), 0.3).otherwise(0.0) + F.when(table, 0.4).otherwise(0.0)
    score = length + F.when(fields.isNotNull(), some).otherwise(0.0) + F.when(table, 0.4).otherwise(0.0)
    return F.greatest(F.least(score / weights, F.lit(1.0)), F.lit(0.0))


def curriculum_threshold(progress: float, start: float = 0.3, end: float = 1.0, schedule: str = "linear") -> float:
    if schedule == "exponential":
        value = start * (end / start) ** progress
    elif schedule == "cosine":
        value = start + (end - start) * (1 - math.cos(progress * math.pi / 2))
    else:
        value = start + (end - start) * progress
    return min(max(value, 0.0), 1.0)


#: Region types that are read as tables, formulas or charts; every other is plain text.
PROMPTS = {"table": "Table Recognition:", "line_items_table": "Table Recognition:", "line_item": "Table Recognition:", "table_header": "Table Recognition:", "table_body": "Table Recognition:", "formula": "Formula Recognition:", "chart": "Chart Recognition:", "graph": "Chart Recognition:"}


def prompt_of(c: Column) -> Column:
    m = F.create_map(*(F.lit(x) for kv in PROMPTS.items() for x in kv))
    return F.coalesce(m[F.lower(c)], F.lit("OCR:"))


def is_table_region(c: Column) -> Column:
    return prompt_of(c) == "Table Recognition:"


#: Functions that ``register`` offers to SQL: argument types and the expression above that each is.
SQL_FUNCTIONS: dict[str, tuple[dict[str, str], Callable[..., Column]]] = {
    "dq_clean_text": ({"x": "string"}, clean_text), "dq_parse_number": ({"x": "string"}, parse_number), "dq_normalize_currency": ({"x": "string"}, normalize_currency), "dq_safe_float": ({"x": "string"}, safe_float),
    "dq_parse_mixed_number": ({"x": "string"}, parse_mixed_number), "dq_parse_item_number": ({"x": "string"}, lambda x: parse_mixed_number(x, True)), "dq_amount": ({"x": "string"}, amount_of), "dq_parse_currency": ({"x": "string"}, parse_currency),
    "dq_currency_alias": ({"x": "string"}, currency_alias), "dq_detect_currency": ({"x": "string"}, detect_currency), "dq_parse_date": ({"x": "string"}, lambda x: parse_date(x, ISO_FIRST)), "dq_parse_date_day_first": ({"x": "string"}, lambda x: parse_date(x, DAY_FIRST)),
    "dq_is_numeric": ({"x": "string"}, is_numeric), "dq_is_date": ({"x": "string"}, is_date), "dq_is_total_keyword": ({"x": "string"}, is_total_keyword), "dq_token_overlap": ({"x": "string", "y": "string"}, token_overlap), "dq_json": ({"x": "string"}, json_of),
    "dq_money_text": ({"x": "double", "y": "string"}, money_text), "dq_tax_rate": ({"x": "decimal(18,2)", "y": "decimal(18,2)"}, tax_rate), "dq_relative_error": ({"x": "double", "y": "double"}, relative_error),
    "dq_email": ({"x": "string"}, email_of), "dq_phone": ({"x": "string"}, phone_of), "dq_tax_id": ({"x": "string"}, tax_id_of), "dq_line_total": ({"q": "double", "p": "double", "r": "double", "d": "double"}, line_total),
    "dq_content_key": ({"x": "string"}, content_key), "dq_difficulty": ({"x": "string", "n": "int"}, difficulty), "dq_prompt": ({"x": "string"}, prompt_of), "dq_is_table_region": ({"x": "string"}, is_table_region),
}
#: Lines of a document as SQL hands them over.
ITEMS_TYPE = "array<struct<description string, quantity double, unit_price double, line_total double>>"


def sql_of(spark: SparkSession, args: dict[str, str], make: Callable[..., Column]) -> tuple[str, str]:
    """(return type, SQL text) of an expression over arguments of the given types, as Spark resolves it."""
    frame = spark.range(0).select(*(F.lit(None).cast(t).alias(n) for n, t in args.items()))
    df = frame.select(make(*map(F.col, args)).alias("r"))
    resolved = df._jdf.queryExecution().analyzed().expressions().head().child()
    return df.schema["r"].dataType.simpleString(), resolved.sql()


def register(spark: SparkSession) -> None:
    """The scalars above as temporary SQL functions, made from the expressions themselves, and the table functions
    ``dq_items`` (lines of a document as rows) and ``dq_amounts`` (amounts in a text, by place)."""
    for name, (args, make) in SQL_FUNCTIONS.items():
        kind, body = sql_of(spark, args, make)
        spark.sql(f"create or replace temporary function {name}({', '.join(f'{n} {t}' for n, t in args.items())}) returns {kind} return {body}")
    spark.sql(f"create or replace temporary function dq_items(items {ITEMS_TYPE}) returns table(pos int, description string, quantity double, unit_price double, line_total double) return select t.pos + 1, t.i.description, t.i.quantity, t.i.unit_price, t.i.line_total from posexplode(dq_items.items) as t(pos, i)")
    amounts, (_, value) = r"regexp_extract_all(replace(dq_amounts.txt, ',', ''), '(-?\\d+(?:\\.\\d{1,4})?)', 1)", sql_of(spark, {"a": "string"}, amount_of)
    spark.sql(f"create or replace temporary function dq_amounts(txt string) returns table(pos int, amount decimal(18,2)) return select t.pos + 1, {value} from posexplode({amounts}) as t(pos, a)")
