"""Nested predictions against nested truth, by their schemas.

A row holds both sides as structs (``t`` and ``p``). What is compared is worked out from the two struct types when
the plan is made; at run time everything happens inside the row, arrays of lines included, so that documents are
never joined again or exploded before something is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.operators.mining import letter_likeness, number_likeness

#: Words in a field's name that say how it is compared; fixed values of the published measure.
NUMBER_WORDS = ("amount", "price", "total", "quantity", "rate")
DATE_WORDS = ("date", "time")
#: Fields of each block; fixed values of the published measures.
VENDOR = ("name", "address", "city", "state", "postal_code", "email")
METADATA = ("invoice_id", "issue_date", "due_date", "payment_terms")
ITEM = ("description", "quantity", "unit_price", "line_total")
FINANCIAL = ("subtotal", "tax_total", "discount_total", "grand_total", "currency")
#: Weights of the blocks in the field-weighted score; fixed values.
BLOCK_WEIGHTS = {"vendor_block": 1.5, "client_info": 1.5, "invoice_metadata": 1.5, "financial_summary": 2.0, "line_item_table": 2.5}


def folded(x: Column) -> Column:
    """Text without outer space and case; missing as empty."""
    return F.lower(F.trim(F.coalesce(x.cast("string"), F.lit(""))))


def kind_of(name: str, kind: T.DataType | None) -> str:
    """number, date or text, by the name of a field first and by its type."""
    low = name.lower()
    if any(w in low for w in NUMBER_WORDS) or isinstance(kind, T.NumericType):
        return "number"
    return "date" if any(w in low for w in DATE_WORDS) or isinstance(kind, (T.DateType, T.TimestampType)) else "text"


def leaf_matches(t: Column, p: Column, kind: str) -> Column:
    """Equal but for case and outer space; numbers also within .01, dates also by their digits alone."""
    a, b = folded(t), folded(p)
    number = lambda x: F.regexp_replace(x, "[^0-9.-]", "").try_cast("double")
    if kind == "number":
        return (a == b) | F.coalesce(F.abs(number(a) - number(b)) < 0.01, F.lit(False))
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
    return ((a == b) | (digits(a) == digits(b))) if kind == "date" else a == b


def leaves(t: Column | None, p: Column | None, t_type: T.DataType | None, p_type: T.DataType | None, path: Column, name: str) -> list[Column]:
    """Arrays of (path, field, kind, truth, predicted, matches) for the leaves of either side."""
    kind = t_type if t_type is not None else p_type
    if isinstance(kind, T.StructType):
        own = {f.name: f.dataType for f in t_type} if isinstance(t_type, T.StructType) else {}
        other = {f.name: f.dataType for f in p_type} if isinstance(p_type, T.StructType) else {}
        out = []
        for f in [*own, *(x for x in other if x not in own)]:
            at = lambda side, types, f=f: side[f] if side is not None and f in types else None
            out += leaves(at(t, own), at(p, other), own.get(f), other.get(f), F.concat(path, F.lit(f".{f}")), f)
        return out
    if isinstance(kind, T.ArrayType):
        size = lambda x: F.coalesce(F.size(x), F.lit(0)) if x is not None else F.lit(0)
        size_of = F.greatest(*(F.greatest(size(x), F.lit(0)) for x in (t, p)))
        places = F.filter(F.sequence(F.lit(0), F.greatest(size_of - 1, F.lit(0))), lambda i: i < size_of)
        element = lambda x: x.elementType if isinstance(x, T.ArrayType) else None

        def of(i: Column) -> Column:
            inner = [F.get(x, i) if x is not None else None for x in (t, p)]
            return F.concat(*leaves(*inner, element(t_type), element(p_type), F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), name))

        return [F.flatten(F.transform(places, of))]
    how = kind_of(name, kind)
    t = F.lit(None).cast("string") if t is None else t
    p = F.lit(None).cast("string") if p is None else p
    leaf = F.struct(path.alias("path"), F.lit(name).alias("field"), F.lit(how).alias("kind"), t.cast("string").alias("truth"), p.cast("string").alias("predicted"), leaf_matches(t, p, how).alias("matches"))
    return [F.filter(F.array(leaf), lambda x: x["truth"].isNotNull() | x["predicted"].isNotNull())]


def compared(df: DataFrame, truth: str = "t", predicted: str = "p") -> Column:
    """One array of all leaves that either side has; what is missing on both is not there."""
    kinds = [df.schema[c].dataType for c in (truth, predicted)]
    names = [f.name for f in kinds[0]] + [f.name for f in kinds[1] if f.name not in kinds[0].names]
    parts = []
    for n in names:
        sides = [(F.col(f"{c}.{n}"), k[n].dataType) if n in k.names else (None, None) for c, k in zip((truth, predicted), kinds, strict=True)]
        parts += leaves(sides[0][0], sides[1][0], sides[0][1], sides[1][1], F.lit(n), n)
    return F.concat(*parts)


def leaf_accuracy(df: DataFrame, key: str = "invoice_id") -> DataFrame:
    """right, counted and accuracy of each document over all its leaves (0 without any)."""
    out = df.select(key, compared(df).alias("__x")).select(key, F.size(F.filter("__x", lambda x: x["matches"])).alias("right"), F.size("__x").alias("counted"))
    return out.withColumn("accuracy", F.when(F.col("counted") > 0, F.col("right") / F.col("counted")).otherwise(F.lit(0.0)))


def accuracy_by_field(df: DataFrame) -> DataFrame:
    """(field, kind, right, counted, accuracy) over all documents; one aggregation."""
    rows = df.select(F.inline(compared(df)))
    out = rows.groupBy("field", "kind").agg(F.count_if("matches").alias("right"), F.count("*").alias("counted"))
    return out.withColumn("accuracy", F.col("right") / F.col("counted"))


# ---------------------------------------------------------------------------------------------- blocks


def close(t: Column, p: Column) -> Column:
    return F.coalesce(F.abs(t.cast("double") - p.cast("double")) < 0.01, t.isNull() & p.isNull())


def share(matches: list[Column]) -> Column:
    return sum((x.cast("int") for x in matches), F.lit(0)) / F.lit(len(matches))


def block_accuracies(df: DataFrame) -> DataFrame:
    """vendor_block, client_info, invoice_metadata and financial_summary of each row (t, p): the share of the
    truth's fields that are read right. Missing on both sides is agreement."""
    same = lambda block, names: [folded(F.col(f"t.{block}{n}")) == folded(F.col(f"p.{block}{n}")) for n in names]
    client = [f.name for f in df.schema["t"].dataType["client"].dataType]
    money = [close(F.col(f"t.financial.{n}"), F.col(f"p.financial.{n}")) for n in FINANCIAL[:4]]
    return df.withColumns({"vendor_block": share(same("vendor.", VENDOR)), "client_info": share(same("client.", client)), "invoice_metadata": share(same("", METADATA)), "financial_summary": share([*money, *same("financial.", FINANCIAL[4:])])})


def cells_of(t: Column, p: Column) -> Column:
    """(rows, cells right, cells) of the lines that both sides have."""
    def right(a: Column, b: Column) -> Column:
        ok = [folded(a["description"]) == folded(b["description"]), *(close(a[c], b[c]) for c in ITEM[1:])]
        return sum((x.cast("int") for x in ok), F.lit(0))

    pairs = F.least(F.size(t), F.size(p))
    zipped = F.zip_with(F.slice(t, 1, pairs), F.slice(p, 1, pairs), right)
    return F.struct(pairs.alias("rows"), F.aggregate(zipped, F.lit(0), lambda s, x: s + x).alias("right"), (pairs * len(ITEM)).alias("cells"))


def weighted_scores(df: DataFrame) -> DataFrame:
    """The field-weighted score of each row: blocks by ``BLOCK_WEIGHTS``, the table as .3 of the row count and .7 of
    the cells of rows that both have; 1 for two empty tables, 0 for one."""
    empty = F.array().cast(df.schema["t"].dataType["items"].dataType)
    t, p = F.coalesce("t.items", empty), F.coalesce("p.items", empty)
    cells = cells_of(t, p)
    table = (F.size(t) == F.size(p)).cast("double") * 0.3 + cells["right"] / cells["cells"] * 0.7
    table = F.when((F.size(t) == 0) & (F.size(p) == 0), 1.0).when((F.size(t) == 0) | (F.size(p) == 0), 0.0).otherwise(table)
    df = block_accuracies(df).withColumn("line_item_table", table)
    total = sum((F.col(c) * w for c, w in BLOCK_WEIGHTS.items()), F.lit(0.0))
    return df.withColumn("score", total / sum(BLOCK_WEIGHTS.values()))


def overlap_share(t: Column, p: Column) -> Column:
    """Share of the truth's distinct words that the prediction has."""
    words = lambda x: F.array_distinct(F.filter(F.split(folded(x), r"\s+"), lambda w: w != ""))
    return F.size(F.array_intersect(words(t), words(p))) / F.greatest(F.size(words(t)), F.lit(1))


def region_accuracies(df: DataFrame) -> DataFrame:
    """vendor_block (name, address by words, contact), client_invoice_info (4 fields) and financial_summary (4
    numbers, terms, currency) of each row, and their mean. Of the truth's phone, email and tax id one must stand in
    the predicted contact, if the truth has any."""
    t, p = (lambda x: F.col(f"t.{x}")), (lambda x: F.col(f"p.{x}"))
    place = F.concat_ws(" ", F.concat(t("vendor.address"), F.lit(",")), F.concat(t("vendor.city"), F.lit(",")), t("vendor.country"), t("vendor.postal_code"))
    told = [t(f"vendor.{c}") for c in ("phone", "email", "tax_id")]
    found = [F.coalesce(F.contains(folded(p("vendor.contact")), folded(x)) & (folded(x) != ""), F.lit(False)) for x in told]
    none = F.coalesce(*told).isNull()
    vendor = [folded(t("vendor.name")) == folded(p("vendor.name")), overlap_share(place, p("vendor.address")) > 0.7, found[0] | found[1] | found[2] | none]
    info = [folded(t(c)) == folded(p(c)) for c in METADATA[:3]] + [folded(t("client.name")) == folded(p("client.name"))]
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    money = [F.abs(zero(t(f"financial.{c}")) - zero(p(f"financial.{c}"))) < 0.01 for c in FINANCIAL[:4]]
    terms = (folded(t("payment_terms")) == folded(p("payment_terms"))) | (overlap_share(t("payment_terms"), p("payment_terms")) > 0.7)
    money += [terms, folded(t("financial.currency")) == folded(p("financial.currency"))]
    df = df.withColumns({"vendor_block": share(vendor), "client_invoice_info": share(info), "financial_summary": share(money)})
    return df.withColumn("accuracy", (F.col("vendor_block") + F.col("client_invoice_info") + F.col("financial_summary")) / 3)


# ---------------------------------------------------------------------------------------------- errors


def error(element: str, kind: str, confidence: Column, when: Column, item: Column | None = None) -> Column:
    item = F.lit(None).cast("int") if item is None else item
    return F.when(when, F.struct(item.alias("item_pos"), F.lit(element).alias("element"), F.lit(kind).alias("error"), confidence.cast("double").alias("confidence")))


def text_errors(t: Column, p: Column, element: str, item: Column | None = None) -> list[Column]:
    a, b = folded(t), folded(p)
    like = F.when(b == a, F.lit(1.0)).otherwise(F.coalesce(letter_likeness(a, b), F.lit(0.0)))
    return [error(element, "missing_field", F.lit(0.0), b == "", item), error(element, "incorrect_value", like, (b != "") & (b != a), item)]


def number_errors(t: Column, p: Column, element: str, item: Column | None = None) -> list[Column]:
    off = F.coalesce(F.abs(p.cast("double") - t.cast("double")) > 0.01, F.lit(False))
    return [error(element, "missing_field", F.lit(0.0), p.isNull(), item), error(element, "incorrect_value", number_likeness(t, p), off, item)]


def document_errors(df: DataFrame, compat: bool = False) -> Column:
    """All errors of a row (t, p) as one array: 6 vendor fields, 4 of the document, line count, 4 fields of each line
    that both have, 5 amounts, and a predicted total that its own parts don't give (wrong_format).

    ``compat`` takes the truth for a missing predicted amount and passes over a wrong currency, as the published
    measure does."""
    found = [x for f in VENDOR for x in text_errors(F.col(f"t.vendor.{f}"), F.col(f"p.vendor.{f}"), f"vendor_{f}")]
    found += [x for f in METADATA for x in text_errors(F.col(f"t.{f}"), F.col(f"p.{f}"), f)]
    money = lambda side, f: F.col(f"{side}.financial.{f}")
    for f in FINANCIAL[:4]:
        found += number_errors(money("t", f), F.coalesce(money("p", f), money("t", f)) if compat else money("p", f), f)
    currency = F.coalesce(money("p", "currency"), money("t", "currency")) if compat else money("p", "currency")
    found += text_errors(money("t", "currency"), currency, "currency")[: 1 if compat else 2]
    parts = money("p", "subtotal") + money("p", "tax_total") - money("p", "discount_total")
    found.append(error("grand_total", "wrong_format", F.lit(0.0), F.coalesce(F.abs(parts - money("p", "grand_total")) > 0.01, F.lit(False))))
    empty = F.array().cast(df.schema["t"].dataType["items"].dataType)
    t, p = F.coalesce("t.items", empty), F.coalesce("p.items", empty)
    found.append(error("line_items", "misaligned_table", F.lit(0.0), F.size(t) != F.size(p)))
    pairs = F.least(F.size(t), F.size(p))
    both = F.zip_with(F.slice(t, 1, pairs), F.slice(p, 1, pairs), lambda a, b: F.struct(a.alias("t"), b.alias("p")))
    zipped = F.transform(both, lambda x, i: F.struct(x["t"].alias("t"), x["p"].alias("p"), (i + 1).alias("i")))

    def line(x: Column) -> Column:
        own = text_errors(x["t"]["description"], x["p"]["description"], "line_item_description", x["i"])
        for f in ITEM[1:]:
            own += number_errors(x["t"][f], x["p"][f], f"line_item_{f}", x["i"])
        return F.filter(F.array(*own), lambda e: e.isNotNull())

    return F.concat(F.filter(F.array(*found), lambda e: e.isNotNull()), F.flatten(F.transform(zipped, line)))


def mine_errors(df: DataFrame, key: str = "invoice_id", compat: bool = False) -> DataFrame:
    """(key, item_pos, element, error, confidence) of each row (t, p); nothing is joined or shuffled."""
    return df.select(key, F.inline(document_errors(df, compat)))
