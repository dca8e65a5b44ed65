"""Tolerances at their edges, and missing parts."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from docquarry.operators import validate as V

SCHEMA = "invoice_id long, items_total decimal(18,2), n_items long, subtotal decimal(18,2), tax decimal(18,2), discount decimal(18,2), total decimal(18,2), confidence double"


def invoice(spark, items="100.00", sub="100.00", tax="10.00", discount="0.00", total="110.00", n=2):
    m = lambda x: None if x is None else D(x)
    return spark.createDataFrame([(1, m(items), n, m(sub), m(tax), m(discount), m(total), 0.9)], SCHEMA)


@pytest.mark.parametrize(
    ("profile", "total", "ok"),
    [
        ("decimal", "110.01", True), ("decimal", "110.02", False), ("model", "999.00", True), ("override", "110.01", False), ("override", "110.00", True),
        ("half_unit", "110.50", True), ("half_unit", "110.51", False), ("relative", "112.24", True), ("relative", "112.25", False), ("eval", "112.24", True),
        ("worker", "110.02", True), ("worker", "110.03", False), ("receipt", "500.00", True),
    ],
)
def test_total_edges(spark, profile, total, ok):
    assert V.validate_arithmetic(invoice(spark, total=total), profile).first()["is_valid"] is ok


def test_missing_parts_count_as_zero(spark):
    r = V.validate_arithmetic(invoice(spark, items=None, sub=None, tax=None, total=None, n=0)).first()
    assert r["math_ok"] and r["issues"] == []
    r = V.validate_arithmetic(invoice(spark, tax=None, total="100.00")).first()
    assert r["math_ok"]


def test_all_zero_is_right_under_relative(spark):
    assert V.validate_arithmetic(invoice(spark, "0.00", "0.00", "0.00", "0.00", "0.00", 0), "relative").first()["math_ok"]
    assert not V.validate_arithmetic(invoice(spark, "1.00", "0.00", "0.00", "0.00", "0.00", 1), "relative").first()["items_ok"]


def test_mismatch_goes_to_review(spark):
    df = V.validate_arithmetic(invoice(spark, total="50.00"), "relative")
    assert V.needs_review(df).count() == 1
    assert df.first()["issues"][0]["code"] == "TOTAL_MISMATCH"


def test_correction_names_what_it_changes(spark):
    r = V.correct_arithmetic(invoice(spark, sub="90.00", tax=None)).first()
    assert (r["subtotal"], r["tax"], r["total"]) == (D("100.00"), D("10.00"), D("110.00"))
    assert r["notes"] == ["subtotal", "tax"]


def test_dates(spark):
    df = spark.createDataFrame([(1, "2024-01-10", "2024-01-05"), (2, "2031-01-01", None), (3, "1999-01-01", "2024-01-01")], "i int, a string, b string")
    df = df.select("i", F.col("a").cast("date").alias("issue_date"), F.col("b").cast("date").alias("due_date"))
    r = {x["i"]: (x["due_before_issue"], x["in_future"], x["too_old"]) for x in V.validate_dates(df, "2024-06-01").collect()}
    assert r == {1: (True, False, False), 2: (False, True, False), 3: (False, False, True)}


#: (profile, items, lines, subtotal, tax, discount, total, valid, arithmetic right): written out from the validated
#: formats, one case on each side of a limit and the cases of missing parts.
CASES = [
    # 2 x 100 + 1 x 300, tax 50; items against the subtotal; total against the sum
    ("decimal", "500.00", 2, "500.00", "50.00", None, "550.00", True, True), ("decimal", "200.00", 1, "300.00", "0.00", None, "300.00", False, False),
    ("decimal", "100.00", 1, "100.00", "10.00", None, "150.00", False, False), ("decimal", None, 0, "100.00", "0.00", "0.00", "100.00", False, False), ("decimal", "100.00", 1, "100.00", "10.00", "5.00", "105.00", True, True),
    # sums of lines count where they are above 0, else the stated subtotal; discount is taken off; 0.01 is too much
    ("override", None, 0, "100.00", "10.00", "0.00", "110.00", True, True), ("override", "100.00", 1, "90.00", "10.00", "5.00", "105.00", True, True),
    ("override", "100.00", 1, "90.00", "10.00", "0.00", "100.00", False, False), ("override", "100.00", 1, "100.00", "10.00", "0.00", "110.01", False, False),
    # relative to the total, at least 1; discount is taken off; a zero total needs a sum below 0.02
    ("eval", "100.00", 1, "100.00", "10.00", "5.00", "105.00", True, True), ("eval", "98.00", 1, "98.00", "0.00", "0.00", "100.00", False, False), ("eval", "98.01", 1, "98.01", "0.00", "0.00", "100.00", True, True),
    ("eval", None, 0, "0.01", "0.00", "0.00", "0.00", True, True), ("eval", None, 0, "0.02", "0.00", "0.00", "0.00", False, False), ("eval", "50.00", 1, "100.00", "0.00", "0.00", "100.00", True, False),
    # both checks only with lines, and of amounts above 0
    ("guarded", None, 0, "100.00", "10.00", "0.00", "500.00", True, True), ("guarded", "100.00", 1, "100.01", "10.00", "0.00", "110.01", True, True), ("guarded", "100.00", 1, "100.02", "10.00", "0.00", "110.02", False, False), ("guarded", "100.00", 1, "0.00", "10.00", "0.00", "0.00", True, True),
    # items within 0.02; negative amounts fail
    ("model", "100.02", 1, "100.00", "0.00", "0.00", "1.00", True, True), ("model", "100.03", 1, "100.00", "0.00", "0.00", "1.00", False, False), ("model", "-5.00", 1, "-5.00", "0.00", "0.00", "1.00", False, True),
    # a line check and the sum; lines need not add up
    ("quadrant", "1.00", 1, "100.00", "10.00", "5.00", "105.01", True, True), ("quadrant", "1.00", 1, "100.00", "10.00", "5.00", "105.02", False, False),
    # half a unit; without a tax the total is not held against anything
    ("half_unit", "100.50", 1, "100.00", "1.00", None, "101.50", True, True), ("half_unit", "100.51", 1, "100.00", "1.00", None, "101.00", False, False), ("half_unit", "100.00", 1, "100.00", None, None, "900.00", True, True), ("half_unit", None, 0, None, "1.00", None, "900.00", True, True), ("half_unit", "100.00", 1, "100.00", "10.00", None, None, False, False), ("half_unit", None, 0, "0.20", "0.20", None, None, True, True),
    # relative to the stated values; a zero subtotal is exact
    ("relative", "130.00", 2, "130.00", "13.00", None, "143.00", True, True), ("relative", "100.00", 1, "100.00", "10.00", None, "50.00", False, False), ("relative", None, 0, "0.00", "0.00", None, "0.00", True, True), ("relative", None, 0, "0.00", "0.00", None, "0.02", False, False),
    ("relative", "102.00", 1, "100.00", "0.00", None, "100.00", True, True), ("relative", "102.01", 1, "100.00", "0.00", None, "100.00", False, False), ("relative", None, 0, "100.00", "0.00", None, "100.00", False, False),
    ("relative_floor", "20.00", 2, "20.00", "2.00", None, "22.00", True, True), ("relative_floor", "10.00", 1, "20.00", "0.00", None, "20.00", False, False), ("relative_floor", "0.02", 1, "0.00", "0.00", None, "0.00", True, True), ("relative_floor", "0.03", 1, "0.00", "0.00", None, "0.00", False, False),
    # a wrong total is a warning, discount taken off; items only where both are above 0
    ("receipt", "100.00", 1, "100.00", "10.00", "5.00", "105.00", True, True), ("receipt", "100.00", 1, "100.00", "10.00", "5.00", "110.00", True, False), ("receipt", "100.00", 1, "100.02", "0.00", "0.00", "100.02", False, False), ("receipt", None, 0, "100.00", "0.00", "0.00", "100.00", True, True),
    # wrong items are a warning
    ("worker", "90.00", 1, "100.00", "0.00", None, "100.02", True, False), ("worker", "100.00", 1, "100.00", "0.00", None, "100.03", False, False),
    # subtotal and total must be stated; tax and discount may be missing
    ("optional_parts", None, 0, "100.00", None, None, "100.01", True, True), ("optional_parts", None, 0, "100.00", None, None, "100.02", False, False), ("optional_parts", None, 0, None, "1.00", None, "1.00", False, False), ("optional_parts", None, 0, "1.00", None, None, None, False, False),
    # a difference of a cent is a warning, more an error; no check of items without lines, none without a subtotal
    ("etl", "1000.00", 2, "1000.00", "100.00", None, "1100.00", True, True), ("etl", "1000.00", 2, "1000.00", "100.00", None, "1100.01", True, True), ("etl", "1000.00", 2, "1000.00", "100.00", None, "2000.00", False, False), ("etl", None, 0, "10.00", "0.00", None, "10.00", True, True), ("etl", None, 0, None, "1.00", None, "9.00", True, True),
]


def test_every_profile_against_written_cases(spark):
    assert {c[0] for c in CASES} | {"item_tax"} == set(V.PROFILES)
    m = lambda x: None if x is None else D(x)
    for profile in {c[0] for c in CASES}:
        own = [c for c in CASES if c[0] == profile]
        df = spark.createDataFrame([(k, m(c[1]), c[2], m(c[3]), m(c[4]), m(c[5]), m(c[6]), 0.9) for k, c in enumerate(own)], SCHEMA)
        got = {r["invoice_id"]: (r["is_valid"], r["math_ok"]) for r in V.validate_arithmetic(df, profile).collect()}
        assert {k: got[k] for k in got} == {k: c[7:] for k, c in enumerate(own)}, profile


def test_lines_are_held_against_quantity_and_price(spark):
    items = spark.createDataFrame([(1, 2.0, 50.0, D("100.00"), D("0.10")), (2, 2.0, 50.0, D("100.01"), D("0.10")), (3, 2.0, 50.0, D("100.02"), D("0.10"))], "invoice_id long, qty double, unit_price double, line_total decimal(18,2), tax_rate decimal(4,2)")
    df = spark.createDataFrame([(i, D(t), 1, D(t), D("10.00"), D("0.00"), D(t) + 10, 0.9) for i, t in ((1, "100.00"), (2, "100.01"), (3, "100.02"))], SCHEMA)
    checked = V.with_line_checks(df, items)
    for profile in ("decimal", "quadrant"):
        assert {r["invoice_id"]: r["lines_ok"] for r in V.validate_arithmetic(checked, profile).collect()} == {1: True, 2: True, 3: False}
    # recomputed from quantity, price and rate: subtotal 100, tax 10, total 110, each below 0.01 off
    assert {r["invoice_id"]: (r["items_ok"], r["total_ok"], r["is_valid"]) for r in V.validate_arithmetic(checked, "item_tax").collect()} == {1: (True, True, True), 2: (False, False, False), 3: (False, False, False)}


def test_warnings_are_named(spark):
    codes = lambda profile, **k: [x["code"] for x in V.validate_arithmetic(invoice(spark, **k), profile).first()["issues"]]
    assert codes("etl", total="110.01") == ["MINOR_DIFFERENCE"] and codes("etl", total="110.02") == ["TOTAL_MISMATCH"]
    assert codes("receipt", items=None, n=0) == ["NO_ITEMS"]
    assert codes("model", total="-1.00") == ["NEGATIVE_AMOUNT"]


def test_confidences_follow_the_checks(spark):
    row = lambda **k: V.floor_confidences(V.validate_arithmetic(invoice(spark, **k), "relative_floor")).first()[-3:]
    assert tuple(row()) == (0.95, 0.95, 0.90) and tuple(row(total="200.00")) == (0.95, 0.5, 0.65)


def test_a_line_without_total_counts_by_its_price(spark):
    items = spark.createDataFrame([(1, 2.0, 50.0, None, None), (1, 1.0, 7.0, D("0.00"), None), (2, 2.0, 50.0, D("100.00"), None)], "invoice_id long, qty double, unit_price double, line_total decimal(18,2), tax_rate decimal(4,2)")
    df = spark.createDataFrame([(1, None, 2, D("57.00"), D("0.00"), None, D("57.00"), 0.9), (2, D("100.00"), 1, D("100.60"), D("0.00"), None, D("100.60"), 0.9)], SCHEMA)
    got = {r["invoice_id"]: (r["items_ok"], r["is_valid"]) for r in V.validate_arithmetic(V.with_line_checks(df, items), "half_unit").collect()}
    assert got == {1: (True, True), 2: (False, False)}


#: (document, errors as path, want, got): from the validated format.
TYPED = [
    ('{"financial_summary": {"subtotal": 1, "tax": 0.5, "grand_total": 1.5e0}, "line_items": [{"unit_price": 1, "line_total": 2}]}', []),
    ('{"financial_summary": {"subtotal": "12", "tax": null, "grand_total": true}}', [("financial_summary.grand_total", "number", "boolean"), ("financial_summary.subtotal", "number", "string"), ("financial_summary.tax", "number", "null")]),
    ('{"line_items": "none"}', [("line_items", "list", "string")]), ('{"line_items": {"a": 1}}', [("line_items", "list", "object")]), ('{"line_items": []}', []), ("{}", []), (None, []), ('{"line', [("$", "json", "text")]),
    ('{"line_items": [{"unit_price": "1"}, "text", 3, {"line_total": []}, {"unit_price": 2}]}', [("line_items[0].unit_price", "number", "string"), ("line_items[1]", "object", "string"), ("line_items[2]", "object", "number"), ("line_items[3].line_total", "number", "list")]),
]


def test_json_types(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(TYPED)], "invoice_id int, body string")
    got: dict = {k: [] for k in range(len(TYPED))}
    for r in V.type_errors(df, "body").collect():
        got[r["invoice_id"]].append((r["path"], r["want"], r["got"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: e for k, (_, e) in enumerate(TYPED)}
    props = spark.createDataFrame([('{"n": "12", "s": 5}',), ('{"n": 12, "s": "x"}',), ("{}",), (None,)], "props string")
    assert [tuple(r)[1:] for r in V.validate_types(props, "props", {"n": "number", "s": "string"}).collect()] == [(False, False), (True, True), (False, False), (False, False)]


def test_text_is_no_number_by_type(spark):
    df = invoice(spark).withColumns({"client": F.lit("12"), "client_id": F.lit(12), "vendor": F.lit("v"), "issue_date": F.lit("2024-01-01").cast("date"), "due_date": F.lit(None).cast("date")})
    issues = [(r["field"], r["issue"]) for r in V.validate_document(df, "2024-06-01", numbers=("client", "client_id")).collect()]
    assert ("client", "NOT_A_NUMBER") in issues and ("client_id", "NOT_A_NUMBER") not in issues


def test_each_json_text_is_parsed_once(spark):
    df = spark.createDataFrame([(1, '{"financial_summary": {"tax": "1"}, "line_items": [{}, {"unit_price": "2"}, 5, null]}'), (2, "{"), (3, '{"line_items": "x"}'), (4, "{}"), (5, None)], "invoice_id long, body string")
    out = V.type_errors(df, "body")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    assert sorted(map(tuple, out.collect())) == [
        (1, "financial_summary.tax", "number", "string"), (1, "line_items[1].unit_price", "number", "string"), (1, "line_items[2]", "object", "number"), (1, "line_items[3]", "object", "null"), (2, "$", "json", "text"), (3, "line_items", "list", "string"),
    ]
