"""Confidence, layout, extraction, metrics and plans on small inputs."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docquarry.functions import scalars as S
from docquarry.operators import confidence as C
from docquarry.operators import datasets as DS
from docquarry.operators import evaluate as E
from docquarry.operators import extract as X
from docquarry.operators import layout as L
from docquarry.operators import metrics as M
from docquarry.operators import mining as N
from docquarry.operators import project as P
from docquarry.plans import views as W


def vote(spark, *rows):
    df = spark.createDataFrame([(1, i, v, c) for i, (v, c) in enumerate(rows)], "k int, pos int, value string, confidence double")
    return C.vote(df, "k").first()


def test_single_candidate_is_taken_as_it_is(spark):
    r = vote(spark, ("TEST", 0.9))
    assert (r["value"], r["confidence"]) == ("TEST", 0.9)


def test_agreement_raises_confidence(spark):
    r = vote(spark, ("INV-001", 0.9), ("INV-001", 0.85), ("inv-001", 0.8))
    assert r["value"] == "INV-001" and r["confidence"] == pytest.approx(0.85 + 0.06)


def test_disagreement_divides_by_all(spark):
    r = vote(spark, ("INV-001", 0.9), ("INV-002", 0.6))
    assert r["value"] == "INV-001" and r["confidence"] == pytest.approx(0.45)


def test_numbers_in_any_form_agree_and_nulls_count(spark):
    r = vote(spark, ("$100.50", 0.9), ("100.50", 0.85), ("100.5", 0.95), (None, 0.9))
    assert r["agreeing"] == 3 and r["candidates"] == 4 and r["confidence"] == pytest.approx(2.7 / 4 + 0.06)
    assert vote(spark, (None, 0.9), (None, 0.1))["confidence"] == 0.0


def regions(spark, rows):
    return spark.createDataFrame([(1, i, t, x, y, 10, 10, 0.9) for i, (t, x, y) in enumerate(rows)], "invoice_id int, region_id int, text string, x int, y int, w int, h int, confidence double")


def test_rows_by_mean_follow_the_row(spark):
    df = regions(spark, [("a", 50, 0), ("b", 0, 8), ("c", 20, 14), ("d", 0, 40)])
    assert [r["region_ids"] for r in L.rows_by_mean(df).orderBy("row").collect()] == [[1, 2, 0], [3]]


def test_rows_by_gap_skip_blanks(spark):
    df = regions(spark, [("a", 0, 0), (" ", 0, 11), ("b", 0, 12), ("c", 0, 23)])
    assert {r["text"]: r["row"] for r in L.rows_by_gap(df).collect()} == {"a": 0, "b": 1, "c": 1}


def test_tokens_take_the_box_they_overlap_most(spark):
    tokens = regions(spark, [("t", 0, 0), ("far", 500, 500)])
    boxes = spark.createDataFrame([(1, "b", 0, 0, 10, 12), (1, "a", 0, 0, 10, 30), (1, "c", 190, 190, 210, 210)], "invoice_id int, box string, x1 int, y1 int, x2 int, y2 int")
    assert [(r["region_id"], r["box"]) for r in L.assign(tokens, boxes).collect()] == [(0, "b")]


def test_line_items_stand_near_the_first_numbers(spark):
    # a page 400 wide; numbers at x 40; what is far from all of them is no line item
    cells = [("10.00", 40, 400), ("Nut", 60, 405), ("Far", 180, 405), ("20.00", 40, 430), ("end", 390, 900), ("30.00", 40, 700), ("Bolt", 40, 500)]
    got = {r["text"]: r["part"] for r in L.quadrants(regions(spark, cells)).collect()}
    assert got["Nut"] == got["10.00"] == "line_items" and got["Far"] is None and got["Bolt"] is None
    many = [(f"{k}.00", 40, 300 + 60 * k) for k in range(12)] + [("Late", 40, 300 + 60 * 11), ("Tall", 300, 2000)]
    got = {r["text"]: r["part"] for r in L.quadrants(regions(spark, many)).collect()}
    assert got["9.00"] == "line_items" and got["11.00"] is None and got["Late"] is None


def test_nearness_is_below_the_distance(spark):
    cells = [("5", 0, 0), ("at", 50, 0), ("in", 49, 0)]
    assert sorted(r["text"] for r in L.near_numbers(regions(spark, cells)).collect()) == ["5", "in"]


def test_a_page_is_gathered_once(spark, data):
    from docquarry.queries import QUERIES

    for name in ("j4_assign_tokens", "j5_near_numbers", "x4_semantic_layout", "w6_quadrants"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 4 and plan.count("lineitem.parquet") == 1 and "Window" not in plan, name


def test_content_by_kind(spark):
    df = regions(spark, [("Title", 0, 0), ("b", 100, 198), ("a", 0, 196), ("c", 0, 240), ("foot", 0, 400)])
    got = {r["region_type"]: (r["n"], r["content"], r["tokens"]) for r in L.semantic_layout(df).collect()}
    assert got["table"][:2] == (3, "a | b\nc") and got["header"][1] == "Title" and got["footer"][2] == [4]
    kinds = df.withColumn("kind", F.when(F.col("text") == "Title", "Vendor").when(F.col("text") == "foot", "nonsense").otherwise("line_items"))
    got = {r["region_type"]: r["content"] for r in L.semantic_layout(kinds, zone=False).collect()}
    assert got == {"vendor_block": "Title", "text_block": "foot", "line_items_table": "a | b\nc"}


def test_table_under_its_header(spark):
    def table(*rows):
        cells = [(1, 100 * r + c, t, x, 30 * r, w, 20, 1.0) for r, row in enumerate(rows) for c, (t, x, w) in enumerate(row)]
        return spark.createDataFrame(cells, "invoice_id int, region_id int, text string, x int, y int, w int, h int, confidence double")

    head = [("Item", 0, 80), ("Price", 100, 60), ("Qty", 200, 40), ("Amount", 300, 60)]
    got = X.items_named(table(head, [("Nut", 10, 30), ("1.234,50", 110, 50), ("2", 215, 10), ("2.469,00", 300, 60)], [("Bolt", 0, 30), ("7,25", 120, 40), ("x", 200, 10)], [("only", 0, 20), ("3", 210, 10)])).orderBy("row").collect()
    assert [(r.description, r.quantity, r.unit_price, r.total, r.line_total) for r in got] == [("Nut", 2.0, 1234.5, 2469.0, 2469.0), ("Bolt", None, 7.25, None, None)]
    # a cell over no header takes the header of its place
    got = X.items_named(table(head, [("Cap", -60, 10), ("4", 110, 10), ("3", 205, 10)])).first()
    assert (got.description, got.unit_price, got.quantity, got.line_total) == ("Cap", 4.0, 3.0, 12.0)


def test_named_items_are_found_in_the_row_of_their_page(spark, data):
    from docquarry.operators import layout as L
    from docquarry.plans.storage import named_table
    from docquarry.queries import QUERIES

    plan = QUERIES["x2_items_header_named"](spark, data)._jdf.queryExecution().executedPlan().toString()
    # lines are gathered once; their cells are neither laid out as rows nor gathered
    assert plan.count("lineitem.parquet") == 1 and plan.count("ObjectHashAggregate(") <= 2 and "Union" not in plan and "SortAggregate" not in plan
    pages = named_table(spark, data).where("invoice_id < 500")
    assert pages.count() and {tuple(r) for r in X.items_named(pages).collect()} == {tuple(r) for r in X.items_named(pages.select("invoice_id", F.inline("cells"))).collect()}
    # a title that holds the words of two columns, and one without text
    cells = [(1, k, t, 100 * (k % 10), 30 * (k // 10), 50, 20, 1.0) for k, t in ((0, "Article Item"), (1, "Price Total"), (2, None), (10, "Nut"), (11, "3.00"), (12, "7"))]
    df = spark.createDataFrame(cells, "invoice_id int, region_id int, text string, x int, y int, w int, h int, confidence double")
    assert [tuple(r) for r in X.items_named(L.pages(df)).collect()] == [(1, 40, "Nut", None, 3.0, 3.0, 3.0)]


def box_rows(cells, tolerance=10):
    """Rows of regions by the running mean, in plain Python."""
    rows = []
    for cy, x, k in sorted(((y + h / 2) // 1, x, k) for k, (_, x, y, _, h) in enumerate(cells)):
        if rows and abs(cy - sum(c for c, _, _ in rows[-1]) / len(rows[-1])) <= tolerance:
            rows[-1].append((cy, x, k))
        else:
            rows.append([(cy, x, k)])
    return [[k for _, k in sorted((x, k) for _, x, k in row)] for row in rows]


@pytest.mark.parametrize("seed", range(4))
def test_rows_by_mean_and_their_items_equal_plain_folds(spark, seed):
    import random
    import re

    rng = random.Random(seed)
    words = ["Nut", "Bolt M8", "12", "3", "1,234.50", "7.25", "0.99 each", "x 2", "$ 4.00", "0"]
    cells = [(rng.choice(words), rng.randrange(0, 400), rng.randrange(0, 300), 30, rng.choice([8, 20, 21])) for _ in range(60)]
    df = spark.createDataFrame([(1, k, t, x, y, w, h, k / 100) for k, (t, x, y, w, h) in enumerate(cells)], "invoice_id int, region_id int, text string, x int, y int, w int, h int, confidence double")
    rows = L.rows_by_mean(df)
    want = box_rows(cells)
    assert [r["region_ids"] for r in rows.orderBy("row").collect()] == want
    items = {}
    for n, row in enumerate(want):
        texts = [cells[k][0] for k in row]
        amounts = [float(m[1]) for t in texts if (m := re.search(r"(-?\d+\.\d{2})", t.replace(",", "")))]
        wholes = [int(m[1]) for t in texts if (m := re.search(r"\b(\d+)\b", t)) and int(m[1]) > 0]
        if amounts:
            names = [t for t in texts if not re.fullmatch(r"[-\d.,\s$€£]+", t)]
            qty = wholes[0] if wholes else None
            items[n] = (names[0] if names else None, qty, amounts[-1], min(k / 100 for k in row))
    got = {r["row"]: (r["description"], r["qty"], float(r["line_total"]), r["confidence"]) for r in X.items_of_box_rows(rows, df).collect()}
    assert got == items


def test_last_line_wins_and_subtotal_counts_as_total(spark):
    lines = spark.createDataFrame([(1, 1, "Acme Inc"), (1, 2, "Invoice #: INV-7"), (1, 3, "Total 12.00"), (1, 4, "Subtotal 9.00")], "invoice_id int, line_no int, text string")
    r = X.extract_fields(lines, "heuristic").first()
    assert (r["invoice_number"], r["total"], r["subtotal"], r["vendor"]) == ("INV-7", 9.0, 9.0, "Acme Inc")


def test_percentile_is_the_next_place(spark):
    df = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "ms double")
    r = M.percentiles(df, "ms").first()
    assert (r["p50"], r["p95"], r["n"]) == (3.0, 4.0, 4)


def test_error_class_priority(spark):
    rows = [(1, 100.0, 110.0, 1, 2), (2, 100.0, 101.0, 1, 2), (3, 100.0, 100.0, 1, 1)]
    df = spark.createDataFrame(rows, "invoice_id int, t_total double, p_total double, t_rows int, p_rows int")
    df = df.withColumns({c: F.lit(v) for c, v in {"t_currency": "USD", "p_currency": "EUR", "t_date": "d", "p_date": "d", "t_vendor": "v", "p_vendor": "v"}.items()})
    got = {r["invoice_id"]: (r["error_class"], r["severity"]) for r in N.classify_errors(df).collect()}
    assert got == {1: ("TOTAL_MISMATCH", 5), 2: ("TABLE_STRUCTURE_ERROR", 4), 3: ("CURRENCY_ERROR", 3)}


def test_empty_extraction_never_contains(spark):
    df = spark.createDataFrame([("Acme", "")], "t_vendor string, p_vendor string").withColumns({"t_currency": F.lit("USD"), "p_currency": F.lit("USD"), "t_date": F.lit("d"), "p_date": F.lit("d"), "t_total": F.lit(1.0), "p_total": F.lit(1.0)})
    assert E.field_accuracy(df, "contains").first()["vendor_ok"] is False


def test_redaction_reaches_nested_text(spark):
    df = spark.sql("select 1 id, 'a@b.org' t, named_struct('p', '555-123-4567') s, array('4111 1111 1111 1111', '123-45-6789') l")
    r = P.redacted(df, "id").first()
    assert (r["t"], r["s"]["p"], r["l"]) == ("[REDACTED]", "[REDACTED]", ["[REDACTED]", "[REDACTED]"])


@pytest.mark.parametrize(("text", "value"), [("1.234,56", 1234.56), ("12,50", 12.5), ("1,234", 1234.0), ("-7.5", -7.5), ("x", 0.0)])
def test_mixed_numbers(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(S.parse_mixed_number(F.col("t"))).first()[0] == value


def test_plans_stay_in_the_engine(spark, data):
    from docquarry.queries import QUERIES

    for name in ("v1_arithmetic_decimal", "x1_fields_heuristic", "w1_rows_by_mean", "m1_errors", "a8_vote"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan, name
    plan = W.invoices(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan and plan.count("FileScan") <= 8


def test_nested_loop_free_layout(spark, data):
    from docquarry.queries import QUERIES

    for name in ("j4_assign_tokens", "j5_near_numbers"):
        assert "NestedLoop" not in QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString(), name


@pytest.mark.parametrize(("profile", "ok"), [("blocks", False), ("regions", False), ("contained_in", False), ("three_fields", True)])
def test_a_cent_off_is_judged_as_the_measure_says(spark, profile, ok):
    df = spark.createDataFrame([("Acme", " acme ", "USD", "USD", "2024-01-01", "2024-01-01", Decimal("10.00"), Decimal("10.01"))], "t_vendor string, p_vendor string, t_currency string, p_currency string, t_date string, p_date string, t_total decimal(18,2), p_total decimal(18,2)")
    r = E.field_accuracy(df, profile).first()
    assert r["total_ok"] is ok
    assert E.field_accuracy(df, "paths_exact").first()["vendor_ok"] is True


def test_the_whole_right_half_is_the_client(spark):
    rows = [(1, 1, "left", 0, 0, 100, 20), (1, 2, "right", 700, 500, 100, 20), (1, 3, "12.00", 100, 400, 50, 20), (1, 4, "13.00", 100, 900, 50, 20)]
    df = spark.createDataFrame(rows, "invoice_id long, region_id int, text string, x int, y int, w int, h int")
    assert {r["region_id"]: r["part"] for r in L.quadrants(df).collect()} == {1: "vendor", 2: "client", 3: "line_items", 4: "line_items"}


def test_split_and_sample_against_plain_python(spark):
    import hashlib

    keys = list(range(500)) * 2
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, pos long")
    first = lambda x: int(hashlib.md5(str(x).encode()).hexdigest()[:8], 16)
    place = lambda x: first(x) % 100
    want = {k: "train" if place(k) < 80 else "validation" if place(k) < 90 else "test" for k in keys}
    assert {(r["k"], r["split"]) for r in DS.split(df, "k", {"train": 80, "validation": 10, "test": 10}).collect()} == set(want.items())
    rows = [(k % 7, k) for k in range(60)]
    by = {}
    for a, b in rows:
        by.setdefault(a, []).append((first(f"{a}|{b}"), b))
    want = {(a, b) for a, x in by.items() for _, b in sorted(x)[:2]}
    assert {tuple(r) for r in DS.sample_each(spark.createDataFrame(rows, "k long, pos long"), "k", 2, "k", "pos").collect()} == want


def test_text_fields_by_pattern_order(spark):
    texts = [
        (1, "Invoice # INV-77 Vendor: Acme Supplies & Co 12 High St Date: 03/04/2024 Total: $1,200.00 Subtotal $1,000.00 USD"),
        (2, "Blue Harbor Trading Invoice 5 due 1-2-24, then 03/04/2024"),
        (3, "ref #AB12CD34 of no bill"),
        (4, ""),
        (5, None),
    ]
    got = {r["k"]: (r["invoice_number"], r["vendor"], r["date"], r["total"]) for r in X.extract_text(spark.createDataFrame(texts, "k long, text string")).collect()}
    assert got[1] == ("INV-77", "Acme Supplies & Co", "03/04/2024", 1200.0)
    assert got[2] == ("5", "Blue Harbor Trading", "1-2-24", None)
    assert got[3] == ("AB12CD34", None, None, None)
    assert got[4][:3] == got[5][:3] == (None, None, None)


def test_two_models_against_one_truth(spark):
    money = "decimal(18,2)"
    head = ", ".join(f"{s}_vendor string, {s}_currency string, {s}_date string, {s}_total {money}" for s in "tpb")
    truth = ("Acme", "USD", "2024-01-01", Decimal("10.00"))
    wrong = ("Other", "EUR", "2023-01-01", Decimal("11.00"))
    half = ("acme ", "EUR", "2024-01-01", Decimal("10.01"))
    rows = [(1, *truth, *truth, *half), (2, *truth, *wrong, *truth), (3, *truth, *half, *wrong)]
    df = spark.createDataFrame(rows, f"k long, {head}")
    got = {r["k"]: tuple(r)[1:] for r in E.compare_models(df, "blocks", "k").collect()}
    assert got == {1: (0.5, 1.0, 0.5, "completed"), 2: (1.0, 0.0, -1.0, "failed"), 3: (0.0, 0.5, 0.5, "partial")}


def test_region_text_fields(spark):
    docs = {
        1: ["INVOICE", "ACME SUPPLY CO", "Invoice # A-9", "2024-01-05", "due 2024-02-04", "Sales Tax: $5.00", "Amount due: $1,105.00 EUR"],
        2: ["Page 1", " River Mills ", "", "paid 12.50 and 7.25"],
        3: [""],
    }
    rows = [(k, i + 1, x) for k, x in docs.items() for i, x in enumerate(x)]
    got = {r["k"]: tuple(r)[1:] for r in X.extract_region_text(spark.createDataFrame(rows, "k long, line_no int, text string"), "k").collect()}
    assert got[1][:-1] == ("ACME", "2024-01-05", "2024-02-04", "EUR", 1105.0, None, 5.0, "ACME SUPPLY CO")
    assert got[2] == (None, None, None, "USD", 12.5, None, None, "River Mills", [12.5, 7.25, 1.0])
    assert got[3] == (None, None, None, "USD", None, None, None, None, [])


def test_percentiles_against_plain_python(spark):
    import random

    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), float(rnd.choice([rnd.randrange(40), rnd.randrange(10**6), 7]))) for _ in range(3000)] + [("c", 1.5), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")

    def plain(values):
        x = sorted(values)
        return (len(x), x[0], x[-1], *(x[min(len(x) * p // 100, len(x) - 1)] for p in (50, 95, 99)))

    columns = ("n", "least", "most", "p50", "p95", "p99")
    want = {g: plain([v for k, v in rows if k == g and v is not None]) for g in ("a", "b", "c", None)}
    for cuts in (2, 64):
        assert {r["g"]: tuple(r[c] for c in columns) for r in M.percentiles(df, "v", by=("g",), cuts=cuts).collect()} == want
    assert tuple(M.percentiles(df, "v").first()[c] for c in columns) == plain([v for _, v in rows if v is not None])
    assert [tuple(r) for r in M.percentiles(df.where("v > 1e9"), "v").collect()] == [(None,) * 7]


def test_pages_are_made_in_the_row_of_their_invoice(spark, data):
    """Lines are gathered once; the regions of a page are neither gathered nor sorted again, which spilled on large tables."""
    from docquarry.queries import QUERIES

    for name in ("x4_semantic_layout", "j4_assign_tokens", "f15_overlap", "w6_quadrants", "w6_quadrants_of_numbers", "j5_near_numbers"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ObjectHashAggregate(") <= 2 and "SortAggregate(" not in plan, name


def test_page_items_are_made_in_the_row_of_their_invoice(spark, data):
    """Regions are neither laid out and gathered again nor joined with themselves."""
    from docquarry.queries import QUERIES

    for name in ("x2_items_box_rows", "x1_fields_boxes", "x2_items_gap_rows", "w1_rows_by_mean"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("lineitem.parquet") == 1 and plan.count("ObjectHashAggregate(") <= 2 and "SortAggregate(" not in plan and "Window" not in plan, name


def test_rows_of_pages_equal_rows_of_regions(spark):
    cells = [("Nut", 0, 0), ("2", 50, 3), (" ", 60, 30), ("1,200.50", 90, 5), ("NaN", 10, 40), ("3", 5, 41), ("Bolt", 30, 42), ("-4.25", 80, 44)]
    df = regions(spark, cells)
    gap = {r["row"]: tuple(r)[2:] for r in X.items_of_rows(L.cells_by_gap(df)).collect()}
    assert repr(gap) == repr({r["row"]: tuple(r)[2:] for r in sorted(X.items_of_rows(L.rows_by_gap(df)).collect(), key=lambda r: r["row"])})
    assert gap[0] == ("Nut", 2.0, 2.0, 1200.5, 0.9) and gap[1][0] == "Bolt"
    got = sorted(map(tuple, X.items_of_box_rows(L.cells_by_mean(df)).collect()))
    assert got == sorted(map(tuple, X.items_of_box_rows(L.rows_by_mean(df), df).collect())) and len(got) == 2


def test_four_shapes_are_read_in_one_pass(spark, data):
    from docquarry.queries import QUERIES

    plan = QUERIES["s17_layouts"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and plan.count("ObjectHashAggregate(") <= 2


def test_regions_are_parsed_from_one_reading_of_the_page(spark, data):
    from docquarry.queries import QUERIES

    plan = QUERIES["x5_parse_regions"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1


def zoned_by_hand(cells):
    """(zones by name, cell by cell share of each zone) of one page of (text, x, y, w, h)."""
    height = max(y + h for _, _, y, _, h in cells)
    zone = ["header" if y < height * 0.3 else "footer" if y > height * 0.7 else "table" for _, _, y, _, _ in cells]
    boxes = {}
    for z in sorted(set(zone)):
        own = [c for c, at in zip(cells, zone, strict=True) if at == z]
        boxes[z] = (min(c[1] for c in own), min(c[2] for c in own), max(c[1] + c[3] for c in own), max(c[2] + c[4] for c in own))

    def share(c, b):
        both = max(min(c[1] + c[3], b[2]) - max(c[1], b[0]), 0) * max(min(c[2] + c[4], b[3]) - max(c[2], b[1]), 0)
        union = c[3] * c[4] + (b[2] - b[0]) * (b[3] - b[1]) - both
        return both / union if union > 0 else 0.0

    return zone, [{z: share(c, b) for z, b in boxes.items()} for c in cells]


#: Pages whose zones stand clear of one another, whose zones meet, of one zone, and with boxes of no area.
ZONED_PAGES = [
    [("a", 0, 0, 40, 20), ("b", 0, 200, 40, 20), ("c", 60, 203, 90, 20), ("d", 0, 400, 40, 20)],
    [("a", 0, 0, 40, 20), ("tall", 100, 10, 40, 300), ("b", 0, 200, 160, 20), ("c", 90, 290, 60, 90), ("d", 0, 330, 400, 60), ("e", 120, 300, 10, 10)],
    [("only", 5, 0, 40, 20)],
    [("a", 0, 0, 0, 20), ("b", 0, 200, 40, 0), ("c", 0, 210, 40, 20), ("d", 0, 400, 40, 20)],
]


def placed_pages(spark, pages):
    rows = [(k, i, t, x, y, w, h, 0.9) for k, cells in enumerate(pages) for i, (t, x, y, w, h) in enumerate(cells)]
    return spark.createDataFrame(rows, "invoice_id long, region_id int, text string, x int, y int, w int, h int, confidence double")


def test_tokens_of_layout_against_plain_python(spark):
    got = {(r["invoice_id"], r["region_type"]): (r["n"], r["tokens"]) for r in L.semantic_layout(placed_pages(spark, ZONED_PAGES)).collect()}
    want = {}
    for k, cells in enumerate(ZONED_PAGES):
        zone, shares = zoned_by_hand(cells)
        for z in set(zone):
            told = [i for i, s in enumerate(shares) if max(s.values()) > 0 and min(s, key=lambda n: (-s[n], n)) == z]
            want[k, z] = (zone.count(z), told)
    assert got == want


def test_layout_content_is_joined_once(spark, data):
    """Text was added to a growing string cell by cell, and each cell compared with the boxes of all zones and rounded by way of a decimal."""
    from docquarry.queries import QUERIES

    plan = QUERIES["x4_semantic_layout"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "bround(" not in plan and not any("aggregate(sort_array(own" in line for line in plan.splitlines())
    df = placed_pages(spark, [[("a", 0, 0, 40, 20), (None, 0, 200, 40, 20), ("c", 60, 203, 90, 20), ("d", 0, 400, 40, 20)]])
    assert {r["region_type"]: r["content"] for r in L.semantic_layout(df).collect()} == {"header": "a", "table": None, "footer": "d"}


def test_overlap_is_compiled(spark, data):
    """The overlap of a cell and a box ran within lambdas, which are interpreted, and up to four times for each pair."""
    from docquarry.queries import QUERIES

    for name in ("j4_assign_tokens", "f15_overlap"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "greatest(" in plan and not any("greatest(" in line and "lambdafunction(" in line for line in plan.splitlines()), name


@pytest.mark.parametrize("least", [0.0, 0.02, 0.3])
def test_tokens_of_zones_against_plain_python(spark, least):
    got = {(r["invoice_id"], r["region_id"]): (r["box"], r["iou"]) for r in L.assigned(L.zoned_pages(placed_pages(spark, ZONED_PAGES)), least).collect()}
    want = {}
    for k, cells in enumerate(ZONED_PAGES):
        for i, s in enumerate(zoned_by_hand(cells)[1]):
            best = min(s, key=lambda z: (-s[z], z))
            if s[best] > least:
                want[k, i] = (best, s[best])
    assert got == want


def test_shares_of_zones_against_plain_python(spark):
    got = {(r["invoice_id"], r["region_id"]): (r["footer"], r["header"], r["table"]) for r in L.shares_of_zones(L.zoned_pages(placed_pages(spark, ZONED_PAGES))).collect()}
    assert got == {(k, i): (s.get("footer"), s.get("header"), s.get("table")) for k, cells in enumerate(ZONED_PAGES) for i, s in enumerate(zoned_by_hand(cells)[1])}


def numbered_pages():
    """Pages of (text, x, y, w, h) with more numbers than the first ten, in columns and rows of odd heights."""
    import random

    rnd = random.Random(7)
    pages = []
    for n in (0, 1, 12, 60):
        numbers = [(f"{k}.50", 40 + rnd.randrange(300), 200 + rnd.randrange(40 * n), 30, rnd.choice([10, 20, 31])) for k in range(n)]
        words = [(rnd.choice(["nut", "bolt", "tax", "Total"]), 20 + rnd.randrange(380), rnd.randrange(400 + 40 * n), 30, rnd.choice([10, 45])) for k in range(40)]
        pages.append([*numbers, *words, ("end", 900, 100, 10, 10)])
    return pages


@pytest.mark.parametrize("first", [None, 10, 3])
def test_line_items_against_plain_python(spark, first):
    got = {(r["invoice_id"], r["region_id"]) for r in L.quadrants(placed_pages(spark, numbered_pages()), first).where("part = 'line_items'").collect()}
    want = set()
    for k, cells in enumerate(numbered_pages()):
        width, height = max(x + w for _, x, _, w, _ in cells), max(y + h for _, _, y, _, h in cells)
        numbers = [c for _, _, _, c in sorted((c[2], c[1], i, c) for i, c in enumerate(cells) if c[0].endswith(".50"))]
        at = lambda c: (c[1] + c[3] / 2, c[2] + c[4] / 2)
        for i, c in enumerate(cells):
            x, y = at(c)
            inside = bool(numbers) and min(n[2] for n in numbers) <= y <= max(n[2] + n[4] for n in numbers)
            near = any((x - at(n)[0]) ** 2 + (y - at(n)[1]) ** 2 < 2500 for n in numbers[:first])
            if not (x < width * 0.5 and y < height * 0.3) and x <= width * 0.5 and inside and near:
                want.add((k, i))
    assert got == want and len(want) > 5


def test_line_items_are_near_any_number_of_the_page(spark, data, monkeypatch):
    """What stood near the eleventh number of a page, or a later one, was no line item."""
    from docquarry.queries import QUERIES

    cells = [("Vendor", 40, 0, 100, 20), *((f"{k}.00", 40, 300 + 60 * k, 100, 20) for k in range(30)), ("Late", 60, 300 + 60 * 29, 100, 20), ("Far", 200, 300 + 60 * 29, 100, 20), ("Tall", 600, 2200, 100, 20)]
    page = L.pages(placed_pages(spark, [cells]))
    monkeypatch.setattr(W, "region_pages", lambda *_: page)
    got = {r["region_id"]: r["part"] for r in QUERIES["w6_quadrants_of_numbers"](spark, data).collect()}
    # the vendor's part ends at 0.3 of the height
    assert [got[k] for k in range(1, 32)] == ["vendor" if 300 + 60 * k + 10 < 666 else "line_items" for k in range(30)] + ["line_items"] and got[32] is None


def test_words_of_parts_are_looked_up_without_patterns(spark, data):
    from docquarry.queries import QUERIES

    plan = QUERIES["w6_quadrants_of_numbers"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE(__t" not in plan and L.CLIENT_WORDS not in plan and L.TAX_WORDS not in plan


def test_parts_of_fields_are_near_any_number_of_the_page(spark, data, monkeypatch):
    """A region near the eleventh number of a page, or a later one, was not placed."""
    from docquarry.queries import QUERIES

    cells = [("Vendor: A", 40, 0, 100, 20), *((f"{k}.00", 40, 300 + 60 * k, 100, 20) for k in range(30)), ("Far", 200, 300 + 60 * 29, 100, 20), ("Tall", 600, 2200, 100, 20)]
    page = L.pages(placed_pages(spark, [cells]))
    monkeypatch.setattr(W, "region_pages", lambda *_: page)
    assert [(r["vendor"], r["placed"]) for r in QUERIES["x1_fields_quadrant"](spark, data).collect()] == [("Vendor: A", 32)]


def test_rows_by_mean_keep_where_they_begin(spark, data):
    """The fold over a page copied the regions of its rows with each step."""
    from docquarry.queries import QUERIES

    plan = QUERIES["x2_items_box_rows"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "starts" in plan and "done" not in plan
    cells = [[(f"t{k}", (k * 37) % 200, (k * k * 3) % 400, 10, 10 + k % 3) for k in range(120)], [], [("one", 0, 0, 10, 10)]]
    want = []
    for k, page in enumerate(cells):
        members = sorted(((y * 2 + h) // 2, x, i) for i, (_, x, y, _, h) in enumerate(page))
        rows = []
        for m in members:
            if rows and abs(m[0] - sum(r[0] for r in rows[-1]) / len(rows[-1])) <= 10:
                rows[-1].append(m)
            else:
                rows.append([m])
        want += [(k, n, [i for _, i in sorted((x, i) for _, x, i in r)]) for n, r in enumerate(rows)]
    assert sorted((r["invoice_id"], r["row"], r["region_ids"]) for r in L.rows_by_mean(placed_pages(spark, cells)).collect()) == want


def test_zones_of_pages_with_places_of_no_height_or_above_the_page(spark):
    """Zones are runs of the cells in reading order, unless a place has no height or all of the page lies above its top."""
    rows = [(1, 0, "a", 0, None, 10, 10), (1, 1, "b", 0, 0, 10, 10), (1, 2, "c", 0, 50, 10, 10), (1, 3, "d", 0, 90, 10, 10), (2, 0, "e", 0, -90, 10, 10), (2, 1, "f", 0, -40, 10, 10), (2, 2, "g", 0, -20, 10, 10)]
    df = spark.createDataFrame(rows, "invoice_id long, region_id int, text string, x int, y int, w int, h int")
    got = {r["invoice_id"]: {z: [c["text"] for c in r[f"{z}_cells"]] for z in L.ZONES} for r in L.zoned_pages(df).collect()}
    want = {k: {z: [] for z in L.ZONES} for k in (1, 2)}
    for r in L.zones(df).orderBy("invoice_id", F.col("y").asc_nulls_first()).collect():
        want[r["invoice_id"]][r["zone"]].append(r["text"])
    assert got == want and got[1]["table"] == ["a", "c"]


def test_pages_are_cut_as_their_lines(spark, data):
    got = L.pages(W.regions(spark, data)).select("invoice_id", F.explode("cells").alias("c")).select("invoice_id", "c.*")
    from docquarry.plans.documents import bare

    cells = W.region_pages(spark, data).select("invoice_id", F.explode("cells").alias("c")).select("invoice_id", "c.*")
    assert got.exceptAll(cells).isEmpty() and cells.exceptAll(got).isEmpty()
    plain = bare(spark, data).select("invoice_id", F.explode("cells.text").alias("text"))
    want = cells.select("invoice_id", F.regexp_replace("text", "^(Qty|Unit|Total) ", "").alias("text"))
    assert plain.exceptAll(want).isEmpty() and want.exceptAll(plain).isEmpty()


def test_pages_of_clear_rows_need_no_fold(spark):
    """The fold stands behind a condition: rows apart by more than the tolerance, none of them higher than it, are cut where they part."""
    lines = [[(f"{r}.{c}", 90 * c, 30 * r + (7 * r + 3 * c) % 5, 40, 20) for r in range(9) for c in range(4)], [("a", 0, 0, 10, 10), ("b", 50, 10, 10, 10), ("c", 90, 20, 10, 10), ("d", 90, 31, 10, 10)]]
    rows = L.rows_by_mean(placed_pages(spark, lines))
    got = {(r["invoice_id"], r["row"]): r["region_ids"] for r in rows.collect()}
    assert got == {**{(0, r): [4 * r + c for c in range(4)] for r in range(9)}, (1, 0): [0, 1], (1, 1): [2], (1, 2): [3]}
    assert any("CASE WHEN exists(" in line and "aggregate(" in line for line in rows._jdf.queryExecution().executedPlan().toString().splitlines())
