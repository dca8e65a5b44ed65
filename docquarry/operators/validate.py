"""Arithmetic, date, presence and business validation of invoices.

Input columns: items_total (sum of the lines; null without lines), n_items, subtotal, tax, discount, total
and confidence. A missing part counts as zero in a sum; what a missing stated value means is the profile's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

D = "decimal(18,2)"


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0).cast(D))


@dataclass(frozen=True)
class Profile:
    """How an invoice's sums are held against each other.

    measure: of a difference, ``abs`` itself, ``floor`` over max(|stated|, 1), ``relative`` over the stated value (1 for
    zero; under a zero subtotal the items must agree to the cent and the total within 0.01). strict, items_strict:
    fails beyond the tolerance; otherwise already at it. base: what tax is added to, the stated ``subtotal``, ``items``
    where their sum is above 0, or what quantity, price and rate give (``recompute``: subtotal and tax are checked too).
    items, total: "error", "warning" or None, what a failed check counts as. items_if, total_if: what must be there
    (lines) or above zero (items, subtotal, total) or stated (tax) for the check. absent: a missing subtotal and total
    count as ``zero``, the ``total`` alone does, or their checks are passed over (``skip``). lines: quantity times price
    is held against each line's total. minor: a smaller difference of the total that is a warning. amounts: negative
    amounts are errors. total_zero: a missing total counts as 0 even where other missing parts are passed over.
    price_for_total: a line without a total counts by its price (``items_stated`` of ``with_line_checks``). required: a missing subtotal or total is an error. notes: warnings of no lines and of a
    confidence under the given value.
    """

    tolerance: str
    measure: str = "abs"
    strict: bool = True
    items_strict: bool = True
    items: str | None = "error"
    total: str | None = "error"
    base: str = "subtotal"
    discount: bool = False
    items_if: tuple[str, ...] = ()
    total_if: tuple[str, ...] = ()
    absent: str = "zero"
    lines: bool = False
    minor: str | None = None
    amounts: bool = False
    required: bool = False
    no_items: bool = False
    confidence: float | None = None
    total_zero: bool = False
    price_for_total: bool = False


#: Tolerances and comparisons are fixed values of the validated formats.
PROFILES = {
    "etl": Profile("0.01", items_if=("lines",), absent="total", minor="0.005"),
    "decimal": Profile("0.01", discount=True, lines=True),
    "guarded": Profile("0.01", items_if=("lines", "subtotal"), total_if=("lines", "total")),
    "model": Profile("0.02", total=None, amounts=True, no_items=True, confidence=0.7),
    "quadrant": Profile("0.01", items=None, discount=True, lines=True),
    "override": Profile("0.01", strict=False, items=None, base="items", discount=True),
    "relative": Profile("0.02", "relative", absent="skip"),
    "half_unit": Profile("0.5", total_if=("tax",), absent="skip", total_zero=True, price_for_total=True),
    "relative_floor": Profile("0.02", "floor"),
    "eval": Profile("0.02", "floor", strict=False, items="warning", discount=True, items_if=("lines",)),
    "receipt": Profile("0.01", total="warning", discount=True, items_if=("items", "subtotal"), total_if=("total", "subtotal"), no_items=True),
    "worker": Profile("0.02", items="warning"),
    "item_tax": Profile("0.01", strict=False, items_strict=False, base="recompute", discount=True),
    "optional_parts": Profile("0.01", items=None, discount=True, absent="skip", required=True),
}


def failed(difference: Column, stated: Column, p: Profile, strict: bool, zero_case: Column) -> Column:
    limit = F.lit(p.tolerance).cast("decimal(18,4)")
    beyond = (lambda a, b: a > b) if strict else (lambda a, b: a >= b)
    if p.measure == "abs":
        return beyond(difference, limit)
    if p.measure == "floor":
        return beyond(difference.cast("decimal(18,2)"), (limit * F.greatest(F.abs(stated), F.lit(1).cast(D))).cast("decimal(28,6)"))
    over = F.when(stated == 0, F.lit(1).cast(D)).otherwise(stated)
    scaled = (over > 0) & beyond(difference.cast("decimal(18,2)"), (limit * over).cast("decimal(28,6)"))
    return F.when(F.col("subtotal") == 0, zero_case).otherwise(scaled)


def with_line_checks(df: DataFrame, items: DataFrame) -> DataFrame:
    """``df`` with what its lines give: line_off (largest difference of quantity times price from a line's total),
    items_calc (sum of quantity times price), tax_calc (of that by the lines' rates), worst_line (least total),
    items_stated (sum of totals, of the price where a line has none or 0)."""
    amount = F.round(F.col("qty") * F.col("unit_price"), 2).cast(D)
    stated = F.coalesce(F.when(F.col("line_total") != 0, F.col("line_total")), F.round("unit_price", 2).cast(D), F.lit(0).cast(D))
    sums = items.groupBy("invoice_id").agg(F.max(F.abs(amount - F.col("line_total"))).alias("line_off"), F.sum(amount).cast(D).alias("items_calc"), F.sum(amount * F.col("tax_rate")).cast("decimal(28,4)").alias("tax_calc"), F.min("line_total").alias("worst_line"), F.sum(stated).cast(D).alias("items_stated"))
    return df.join(sums, "invoice_id", "left")


def validate_arithmetic(df: DataFrame, profile: str | Profile = "decimal") -> DataFrame:
    """``df`` with items_diff, total_diff, items_ok, total_ok, lines_ok, math_ok (no check failed), is_valid (none that
    counts as an error) and issues. Checks of lines and of negative lines need the columns of ``with_line_checks`` and
    are passed over without them; the recomputing profile needs them."""
    p = PROFILES[profile] if isinstance(profile, str) else profile
    no, none = F.lit(False), F.lit(0).cast(D)
    items, subtotal = zero("items_total"), zero("subtotal") if p.absent == "zero" else F.col("subtotal")
    if p.price_for_total and "items_stated" in df.columns:
        items = zero("items_stated")
    total, tax = F.col("total") if p.absent == "skip" and not p.total_zero else zero("total"), zero("tax")
    base = subtotal
    if p.base == "items":
        base = F.when(items > 0, items).otherwise(zero("subtotal"))
    elif p.base == "recompute":
        items, tax = zero("items_calc"), F.coalesce(F.col("tax_calc"), F.lit(0).cast("decimal(28,4)"))
        base = items
    expected = base + tax - (zero("discount") if p.discount else none)
    expected = F.round(expected, 2) if p.base == "recompute" else expected
    holds = {"lines": F.col("n_items") > 0, "items": items > 0, "subtotal": zero("subtotal") > 0, "total": zero("total") > 0, "tax": F.col("tax").isNotNull()}
    items_diff, total_diff = F.abs(items - subtotal), F.abs(total - expected)

    def bad(diff: Column, stated: Column, strict: bool, zero_case: Column, needs: tuple[str, ...]) -> Column:
        out = F.coalesce(failed(diff, stated, p, strict, zero_case), no)
        for name in needs:
            out = out & holds[name]
        return out

    items_bad = bad(items_diff, subtotal, p.items_strict, items_diff > 0, p.items_if) if p.items else no
    total_bad = bad(total_diff, total, p.strict, total_diff > F.lit("0.01").cast(D), p.total_if) if p.total else no
    if p.required:
        total_bad = total_bad | F.col("subtotal").isNull() | F.col("total").isNull()
    limit = F.lit(p.tolerance).cast("decimal(18,4)")
    lines_bad = F.coalesce(F.col("line_off") > limit, no) if p.lines and "line_off" in df.columns else no
    tax_bad = F.abs(tax - zero("tax")) >= limit if p.base == "recompute" else no
    negative = no
    if p.amounts:
        worst = F.col("worst_line") if "worst_line" in df.columns else none
        negative = (zero("subtotal") < 0) | (zero("total") < 0) | F.coalesce(worst < 0, no)
    minor = F.coalesce((total_diff > F.lit(p.minor).cast("decimal(18,4)")) & ~total_bad, no) if p.minor else no
    empty = F.col("n_items") == 0 if p.no_items else no
    unsure = F.coalesce(F.col("confidence") < p.confidence, no) if p.confidence is not None else no
    error = lines_bad | tax_bad | negative | (items_bad & F.lit(p.items == "error")) | (total_bad & F.lit(p.total == "error"))
    issue = lambda bad, kind, code, diff: F.when(bad, F.struct(F.lit(code).alias("code"), F.lit(kind).alias("severity"), diff.cast("double").alias("difference")))
    found = [
        issue(lines_bad, "error", "LINE_MISMATCH", F.col("line_off") if "line_off" in df.columns else none), issue(items_bad, p.items, "SUBTOTAL_MISMATCH", items_diff), issue(tax_bad, "error", "TAX_MISMATCH", F.abs(tax - zero("tax"))),
        issue(total_bad, p.total, "TOTAL_MISMATCH", total_diff), issue(negative, "error", "NEGATIVE_AMOUNT", none), issue(minor, "warning", "MINOR_DIFFERENCE", total_diff), issue(empty, "warning", "NO_ITEMS", none), issue(unsure, "warning", "LOW_CONFIDENCE", none),
    ]
    issues = F.filter(F.array(*found), lambda x: x.isNotNull())
    return df.withColumns({"items_diff": items_diff, "total_diff": total_diff, "items_ok": ~items_bad, "total_ok": ~total_bad, "lines_ok": ~lines_bad, "math_ok": ~(items_bad | total_bad | lines_bad | tax_bad), "is_valid": ~error, "issues": issues})


def floor_confidences(df: DataFrame) -> DataFrame:
    """Field confidences of a validated invoice: 0.95 for a sum that holds, else 0.5; overall 0.90, else 0.65."""
    field = lambda ok: F.when(F.col(ok), 0.95).otherwise(0.5)
    return df.withColumns({"subtotal_confidence": field("items_ok"), "total_confidence": field("total_ok"), "overall_confidence": F.when(F.col("math_ok"), 0.90).otherwise(0.65)})


def correct_arithmetic(df: DataFrame, rate: str = "0.10") -> DataFrame:
    """Subtotal from the lines, tax from the rate where missing, total from both; ``notes`` names changes."""
    subtotal = F.coalesce("items_total", zero("subtotal"))
    tax = F.coalesce(F.col("tax"), F.round(subtotal * F.lit(rate).cast("decimal(4,2)"), 2).cast(D))
    total = (subtotal + tax).cast(D)
    differs = lambda a, b: ~F.col(a).eqNullSafe(b)
    notes = F.filter(F.array(F.when(differs("subtotal", subtotal), "subtotal"), F.when(F.col("tax").isNull(), "tax"), F.when(differs("total", total), "total")), lambda x: x.isNotNull())
    return df.withColumns({"subtotal": subtotal, "tax": tax, "total": total, "notes": notes})


def validate_dates(df: DataFrame, as_of: str, years: float = 10) -> DataFrame:
    """due_before_issue, in_future and too_old against the given day; years of 365.25 days."""
    day = F.lit(as_of).cast("date")
    flag = lambda x: F.coalesce(x, F.lit(False))
    out = {"due_before_issue": flag(F.col("due_date") < F.col("issue_date")), "in_future": flag(F.col("issue_date") > day), "too_old": flag(F.datediff(day, "issue_date") / 365.25 > years)}
    return df.withColumns(out).withColumn("dates_ok", ~(F.col("due_before_issue") | F.col("in_future") | F.col("too_old")))


def validate_required(df: DataFrame, columns: list[str], falsy: bool = True) -> DataFrame:
    """``missing``: names of required columns that are null and, with ``falsy``, empty or zero."""
    def gone(c: str) -> Column:
        empty = F.col(c).cast("string").isin("", "0", "0.0", "0.00") if falsy else F.lit(False)
        return F.col(c).isNull() | F.coalesce(empty, F.lit(False))

    names = F.array(*(F.when(gone(c), F.lit(c)) for c in columns)) if columns else F.array().cast("array<string>")
    return df.withColumn("missing", F.filter(names, lambda x: x.isNotNull()))


#: JSON kinds of the first words of a VARIANT's schema.
KINDS = {"BIGINT": "number", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number", "STRING": "string", "BOOLEAN": "boolean", "ARRAY": "list", "OBJECT": "object", "VOID": "null"}


def json_kind(value: Column) -> Column:
    """number, string, boolean, list, object, null of a VARIANT; NULL where there is no value."""
    # the schema is made once: within a lambda each branch of a WHEN would make it again
    word = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), word), F.when(value.isNotNull(), "other"))


def validate_types(df: DataFrame, column: str, paths: dict[str, str]) -> DataFrame:
    """For each path of a JSON column: whether its value is present and of the JSON kind (``json_kind``); a number in
    quotes is no number."""
    value = F.try_parse_json(column)
    return df.withColumns({f"{path}_ok": F.coalesce(json_kind(F.try_variant_get(value, f"$.{path}", "variant")) == kind, F.lit(False)) for path, kind in paths.items()})


def type_errors(df: DataFrame, column: str, numbers: tuple[str, ...] = ("subtotal", "tax", "grand_total"), within: str = "financial_summary", items: str = "line_items", item_numbers: tuple[str, ...] = ("unit_price", "line_total"), key: str = "invoice_id") -> DataFrame:
    """(key, path, want, got) of what a JSON document holds in the wrong kind: amounts that are no numbers, a list of lines
    that is none, lines that are no objects, numbers of lines that are none; lines by their place from 0. What is absent
    is passed over; text that is no JSON is one error at the root."""
    at = lambda v, path: F.try_variant_get(v, path, "variant")
    error = lambda path, want, got: F.struct(path.alias("path"), F.lit(want).alias("want"), got.alias("got"))
    wrong = lambda path, want, got: F.when(got != want, error(path, want, got))
    # by steps, generated, so that each text is parsed once and each kind found once
    df = df.select(key, F.col(column).alias("__text"), F.explode(F.array(F.try_parse_json(column))).alias("__v"))
    lines = F.try_variant_get("__v", f"$.{items}", "array<variant>")
    df = df.select(key, "__text", "__v", F.explode(F.array(lines)).alias("__l"))
    names = [f"k{i}" for i in range(len(item_numbers))]
    inner = F.transform("__l", lambda x: F.struct(x.alias("v"), *(json_kind(at(x, f"$.{n}")).alias(k) for k, n in zip(names, item_numbers, strict=True))))
    df = df.select(key, "__text", "__v", "__l", F.explode(F.array(inner)).alias("__i"))
    # a list is one by its elements, an object by its members: the schema of the whole is made for others alone
    of_list = F.when(F.col("__l").isNotNull(), "list").otherwise(json_kind(at(F.col("__v"), f"$.{items}")))
    kinds = F.transform("__i", lambda s: F.struct(F.when(F.coalesce(*(s[k] for k in names)).isNotNull(), "object").otherwise(json_kind(s["v"])).alias("own"), *(s[k].alias(k) for k in names)))
    heads = F.struct(of_list.alias("list"), *(json_kind(at(F.col("__v"), f"$.{within}.{n}")).alias(n) for n in numbers))
    df = df.select(key, (F.col("__text").isNotNull() & F.col("__v").isNull()).alias("__bad"), F.explode(F.array(heads)).alias("__h"), F.coalesce(kinds, F.array().cast(f"array<struct<own:string,{','.join(f'{k}:string' for k in names)}>>")).alias("__k"))
    found = [wrong(F.lit(f"{within}.{n}"), "number", F.col("__h")[n]) for n in numbers] + [wrong(F.lit(items), "list", F.col("__h")["list"]), F.when(F.col("__bad"), error(F.lit("$"), "json", F.lit("text")))]

    def of(s: Column, i: Column) -> Column:
        path = F.concat(F.lit(f"{items}["), i.cast("string"), F.lit("]"))
        return F.array(wrong(path, "object", s["own"]), *(wrong(F.concat(path, F.lit(f".{n}")), "number", s[k]) for k, n in zip(names, item_numbers, strict=True)))

    every = F.concat(F.array(*found), F.flatten(F.transform("__k", of)))
    return df.select(key, F.inline(F.filter(every, lambda x: x.isNotNull())))


def validate_business(df: DataFrame, max_rate: float = 0.30, max_id: int = 50) -> DataFrame:
    """negative amounts, a tax rate over the limit, an id over its length."""
    rate = F.when(zero("subtotal") > 0, F.col("tax").cast("double") / F.col("subtotal").cast("double"))
    flags = {
        "negative": (zero("subtotal") < 0) | (zero("tax") < 0) | (zero("total") < 0),
        "high_tax": F.coalesce(rate > max_rate, F.lit(False)),
        "long_id": F.length(F.col("invoice_id").cast("string")) > max_id,
    }
    return df.withColumns(flags)


def validate_statistical(df: DataFrame, value: str = "total", by: str = "vendor", limit: float = 2.0) -> DataFrame:
    """z-score of a value among those of its group (population deviation); ``outlier`` beyond the limit.

    Sums go by a group-wise aggregation and come back by a join, so a vendor of any size is pre-aggregated."""
    x = F.col(value).cast("decimal(18,2)")
    sums = df.groupBy(by).agg(F.count(x).alias("__n"), F.sum(x).cast("double").alias("__s"), F.sum((x * x).cast("decimal(38,4)")).cast("double").alias("__q"))
    mean = F.col("__s") / F.col("__n")
    deviation = F.sqrt(F.greatest(F.col("__q") / F.col("__n") - mean * mean, F.lit(0.0)))
    z = F.when(deviation > 0, (F.col(value).cast("double") - mean) / deviation).otherwise(F.lit(0.0))
    return df.join(sums, by).withColumn("z", z).withColumn("outlier", F.coalesce(F.abs("z") > limit, F.lit(False))).drop("__n", "__s", "__q")


def validate_document(df: DataFrame, as_of: str, profile: str = "decimal", low: float = 0.85, required: tuple[str, ...] = (), numbers: tuple[str, ...] = ()) -> DataFrame:
    """(invoice_id, field, issue, severity) of every finding of the checks above: sums, dates, business rules, presence
    of the ``required`` columns and whether the ``numbers`` are such by type (text is none, whatever it says)."""
    df = validate_required(validate_business(validate_dates(validate_arithmetic(df, profile), as_of)), list(required), falsy=False)
    found = lambda bad, field, issue, severity: F.when(bad, F.struct(F.lit(field).alias("field"), F.lit(issue).alias("issue"), F.lit(severity).alias("severity")))
    issues = F.array(
        found(~F.col("items_ok"), "subtotal", "SUBTOTAL_MISMATCH", "error"), found(~F.col("total_ok"), "total", "TOTAL_MISMATCH", "error"), found(F.col("due_before_issue"), "due_date", "DUE_BEFORE_ISSUE", "error"),
        found(F.col("in_future"), "issue_date", "FUTURE_DATE", "warning"), found(F.col("too_old"), "issue_date", "TOO_OLD", "warning"), found(F.col("negative"), "amount", "NEGATIVE", "error"),
        found(F.col("high_tax"), "tax", "HIGH_TAX", "warning"), found(F.col("n_items") == 0, "line_items", "NO_ITEMS", "warning"), found(F.col("confidence") < low, "confidence", "LOW_CONFIDENCE", "warning"),
        *(found(F.array_contains("missing", c), c, "MISSING", "error") for c in required), *(found(F.col(c).isNotNull(), c, "NOT_A_NUMBER", "error") for c in numbers if not isinstance(df.schema[c].dataType, T.NumericType)),
    )
    return df.select("invoice_id", F.inline(F.filter(issues, lambda x: x.isNotNull())))


def needs_review(df: DataFrame, low: float = 0.6) -> DataFrame:
    """Rows whose arithmetic failed or whose confidence is low."""
    return df.where(~F.col("math_ok") | (F.col("confidence") < low))


def pass_rate(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("documents"), F.count_if("math_ok").alias("passed"), (F.count_if("math_ok") / F.count("*")).alias("pass_rate"))


def duplicate_items(items: DataFrame) -> DataFrame:
    """Lines whose description stands earlier in the same invoice."""
    order = Window.partitionBy("invoice_id", "description").orderBy("pos")
    return items.where("description <> ''").withColumn("occurrence", F.row_number().over(order)).where("occurrence > 1")
