"""Nested predictions against nested truth: cases by hand from the published measures."""

import pytest
from pyspark.sql import functions as F

from docquarry.operators import compare as C
from docquarry.operators import evaluate as E
from docquarry.operators import mining as N
from docquarry.plans import views as W

VENDOR = "struct<name string, address string, city string, state string, postal_code string, email string, country string, phone string, tax_id string, contact string>"
SIDE = f"struct<vendor {VENDOR}, client struct<name string>, invoice_id string, issue_date string, due_date string, payment_terms string, items array<struct<description string, quantity double, unit_price double, line_total double>>, financial struct<subtotal double, tax_total double, discount_total double, grand_total double, currency string>>"

GOOD = {
    "vendor": {"name": "Acme", "address": "1 Road", "city": "Bern", "state": "BE", "postal_code": "3000", "email": "a@b.ch", "country": "CH", "phone": "555", "tax_id": "T1", "contact": "tel 555"},
    "client": {"name": "Bob"}, "invoice_id": "I-1", "issue_date": "2024-01-02", "due_date": "2024-02-01", "payment_terms": "Net 30",
    "items": [{"description": "Nut", "quantity": 2.0, "unit_price": 1.5, "line_total": 3.0}, {"description": "Bolt", "quantity": 1.0, "unit_price": 7.0, "line_total": 7.0}],
    "financial": {"subtotal": 10.0, "tax_total": 1.0, "discount_total": 0.0, "grand_total": 11.0, "currency": "EUR"},
}


def changed(**parts):
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in GOOD.items()}
    for k, v in parts.items():
        out[k] = {**out[k], **v} if isinstance(v, dict) else v
    return out


def frame(spark, *predicted, truth=GOOD):
    return spark.createDataFrame([(k, truth, p) for k, p in enumerate(predicted)], f"invoice_id long, t {SIDE}, p {SIDE}")


def errors(spark, p, truth=GOOD, compat=False):
    return sorted((r.item_pos, r.element, r.error, round(r.confidence, 4)) for r in C.mine_errors(frame(spark, p, truth=truth), compat=compat).na.fill(0, ["item_pos"]).collect())


def test_no_error_in_what_is_right(spark):
    same = changed(vendor={"name": " ACME "}, payment_terms="net 30")
    assert errors(spark, GOOD) == errors(spark, same) == []


def test_every_field_of_every_block(spark):
    for f in C.VENDOR:
        assert errors(spark, changed(vendor={f: None})) == [(0, f"vendor_{f}", "missing_field", 0.0)]
        assert errors(spark, changed(vendor={f: GOOD["vendor"][f] + "zz"}))[0][:3] == (0, f"vendor_{f}", "incorrect_value")
    for f in C.METADATA:
        assert errors(spark, changed(**{f: ""})) == [(0, f, "missing_field", 0.0)]
    # letters a c m e against a c m: 3 of 4 are shared
    assert errors(spark, changed(vendor={"name": "acm"})) == [(0, "vendor_name", "incorrect_value", 0.75)]
    for f in C.FINANCIAL[:4]:
        got = errors(spark, changed(financial={f: None}))
        assert (0, f, "missing_field", 0.0) in got and errors(spark, changed(financial={f: None}), compat=True) == []
    assert errors(spark, changed(financial={"currency": None})) == [(0, "currency", "missing_field", 0.0)]
    assert errors(spark, changed(financial={"currency": "USD"}), compat=True) == []


def test_amounts_and_their_sum(spark):
    # 1 - |12 - 11| / 11, and 10 + 1 - 0 is not 12
    assert errors(spark, changed(financial={"grand_total": 12.0})) == [(0, "grand_total", "incorrect_value", round(1 - 1 / 11, 4)), (0, "grand_total", "wrong_format", 0.0)]
    assert errors(spark, changed(financial={"grand_total": 11.005})) == []


def test_lines(spark):
    item = GOOD["items"]
    assert errors(spark, changed(items=item[:1])) == [(0, "line_items", "misaligned_table", 0.0)]
    off = [{**item[0], "quantity": 3.0, "description": "Nuts"}, {**item[1], "unit_price": None}]
    assert errors(spark, changed(items=off)) == [(1, "line_item_description", "incorrect_value", 0.75), (1, "line_item_quantity", "incorrect_value", 0.5), (2, "line_item_unit_price", "missing_field", 0.0)]
    assert errors(spark, changed(items=None))[0][1] == "line_items" and errors(spark, changed(items=[]), truth=changed(items=None)) == []


def test_blocks_and_weights(spark):
    r = C.weighted_scores(frame(spark, GOOD, changed(vendor={"name": "x", "city": "y"}, items=GOOD["items"][:1]), changed(items=[]))).orderBy("invoice_id").collect()
    assert r[0].score == 1.0 and (r[1].vendor_block, r[1].line_item_table) == (4 / 6, 0.7)
    assert r[1].score == pytest.approx((4 / 6 * 1.5 + 1.5 + 1.5 + 2.0 + 0.7 * 2.5) / 9)
    assert r[2].line_item_table == 0.0
    both = C.weighted_scores(frame(spark, changed(items=[]), truth=changed(items=[]))).first()
    assert both.line_item_table == 1.0


def test_region_rules(spark):
    address = "1 Road, Bern, CH 3000"
    p = changed(vendor={"address": address, "contact": "mail A@B.CH"}, payment_terms="30 net", financial={"subtotal": None})
    r = C.region_accuracies(frame(spark, p, truth=changed(financial={"subtotal": 0.0}))).first()
    assert (r.vendor_block, r.client_invoice_info, r.financial_summary) == (1.0, 1.0, 1.0)
    r = C.region_accuracies(frame(spark, changed(vendor={"address": "Bern", "contact": "none"}, payment_terms="Net 60"))).first()
    assert r.vendor_block == 1 / 3 and r.financial_summary == 5 / 6


def test_leaves_by_name_and_type(spark):
    df = spark.createDataFrame([(1, {"unit_price": "$1,234.50", "issue_date": "2024/01/02", "note": "A"}, {"unit_price": "1234.505", "issue_date": "2024-01-02", "note": "b", "extra": 1})], "invoice_id int, t struct<unit_price string, issue_date string, note string>, p struct<unit_price string, issue_date string, note string, extra int>")
    got = {r.path: (r.field, r.kind, r.matches) for r in df.select(F.inline(C.compared(df))).collect()}
    assert got == {"unit_price": ("unit_price", "number", True), "issue_date": ("issue_date", "date", True), "note": ("note", "text", False), "extra": ("extra", "number", False)}
    nested = frame(spark, changed(items=[{**GOOD["items"][0], "quantity": 9.0}]))
    paths = {r.path: r.matches for r in nested.select(F.inline(C.compared(nested))).collect()}
    assert paths["items[0].quantity"] is False and paths["items[1].description"] is False and paths["items[0].unit_price"] is True and paths["vendor.city"] is True
    assert "Exchange" not in C.leaf_accuracy(nested)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("truth", "predicted", "score"), [
    ("", "", 1.0), ("<table></table>", "", 1.0), ("<tr><td>a</td><td>b</td></tr>", "<tr><td>a</td><td>b</td></tr>", 1.0),
    ("<tr><td>a</td><td>b</td></tr>", "<tr><td>a</td><td>b</td></tr><tr></tr>", 0.5), ("<tr><td>a</td><td>b</td></tr>", "<tr class='x'><th>a</th></tr>", 0.75),
    ("<tr>\n<td>a</td>\n</tr><tr></tr>", "", 0.0), ("", "<tr><td>a</td></tr><tr></tr>", -0.5),
])
def test_markup(spark, truth, predicted, score):
    df = spark.createDataFrame([(truth, predicted)], "t string, p string")
    assert df.select(E.markup_score(F.col("t"), F.col("p"))).first()[0] == score


@pytest.mark.parametrize(("t", "p", "score"), [(0, 0, 1.0), (0, 2, 0.0), (4, 4, 1.0), (4, 8, 0.0), (4, 5, 0.75), (4, 3, 0.75), (2, 9, 0.0)])
def test_items_count(spark, t, p, score):
    counts = spark.createDataFrame([(t, p, 0, 0, 0, 0, 0)], "truth_rows long, predicted_rows long, rows long, same_description long, same_qty long, same_total long, like_description long")
    assert E.table_score(counts, "items").first()["score"] == score


def test_rollup_levels_and_examples(spark):
    rows = spark.createDataFrame([(k % 3, None, "total" if k % 2 else "vendor_name", "missing_field" if k % 5 else "incorrect_value", k / 10) for k in range(10)], "invoice_id int, item_pos int, element string, error string, confidence double")
    got = {(r["level"], r["name"]): r for r in N.error_rollup(rows, details=4).collect()}
    assert got["all", ""]["n"] == 10 and got["all", ""]["low"] == 5 and [e["invoice_id"] for e in got["all", ""]["examples"]] == [0, 0, 0, 0]
    assert got["error", "incorrect_value"]["n"] == 2 and got["element", "total"]["n"] == 5 and got["sample", "0"]["n"] == 4 and got["sample", "1"]["examples"] is None


def test_plans_of_records(spark, data):
    """Lines are read once and gathered by one exchange; nothing is aligned by a join."""
    from docquarry.queries import QUERIES

    for name in ("e4_documents_even", "m1_errors", "e4_documents_blocks"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("lineitem.parquet") == 1 and plan.count("Exchange hashpartitioning") <= 6, name
    for df in (C.mine_errors(W.records(spark, data)), C.weighted_scores(W.records(spark, data)), C.leaf_accuracy(W.records(spark, data))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("lineitem.parquet") == 1 and plan.count("Exchange hashpartitioning") <= 6 and "Window" not in plan and "NestedLoop" not in plan


def test_line_totals_a_cent_apart_agree_as_in_sql(spark, data, tmp_path):
    """The first of two lines is not read, so that 57095.29 meets 57095.30: a cent, though more than .01 as doubles."""
    import duckdb

    from docquarry.queries import ORACLE_SQL, QUERIES

    tables = {t: f"{data}/{t}.parquet" for t in "region nation customer supplier part orders lineitem".split()}
    spark.read.parquet(tables["orders"]).where("o_orderkey = 10").write.parquet(f"{tmp_path}/orders.parquet")
    line = spark.read.parquet(tables["lineitem"]).limit(1).withColumn("l_orderkey", F.lit(10).cast("long"))
    two = [line.withColumns({"l_linenumber": F.lit(k), "l_quantity": F.lit(q), "l_extendedprice": F.lit(p)}) for k, q, p in ((1, 5.0, 57095.29), (2, 7.0, 57095.30))]
    two[0].unionByName(two[1]).write.parquet(f"{tmp_path}/lineitem.parquet")
    tables |= {t: f"{tmp_path}/{t}.parquet/*.parquet" for t in ("orders", "lineitem")}
    for t in set(tables) - {"orders", "lineitem"}:
        spark.read.parquet(tables[t]).write.parquet(f"{tmp_path}/{t}.parquet")
    duck = duckdb.connect()
    for t, path in tables.items():
        duck.sql(f"create view {t} as select * from '{path}'")
    for name in ("e4_documents_even", "e4_documents_field"):
        want = duck.sql(f"select invoice_id, overall from ({ORACLE_SQL[name]})").fetchall()
        assert [(r.invoice_id, r.overall) for r in QUERIES[name](spark, str(tmp_path)).collect()] == want and len(want) == 1
