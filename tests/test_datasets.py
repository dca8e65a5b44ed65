"""Training pairs of every kind and the checks of training samples: cases by hand."""

import json

from pyspark.sql import functions as F

from docquarry.operators import datasets as D
from docquarry.operators import extract as X
from test_compare import GOOD, changed, frame


def pairs(spark, truth=GOOD):
    return {r.kind: r for r in D.instruction_pairs(frame(spark, GOOD, truth=truth)).collect()}


def test_every_kind_has_its_answer(spark):
    got = pairs(spark)
    assert set(got) == set(D.QUESTIONS) and all(got[k].prompt in D.QUESTIONS[k] for k in got)
    whole = json.loads(got["full_extraction"].answer)
    assert whole["vendor"]["name"] == "Acme" and len(whole["items"]) == 2 and whole["financial_summary"]["grand_total"] == 11.0
    for region, part in (("vendor_block", "city"), ("client_info", "name"), ("invoice_metadata", "payment_terms"), ("line_items", "items"), ("financial_summary", "currency")):
        answer = json.loads(got[region].answer)
        assert answer["region"] == region and part in answer["content"]
    assert json.loads(got["grand_total"].answer) == {"field": "grand_total", "value": 11.0} and json.loads(got["vendor_name"].answer)["value"] == "Acme"
    assert got["table"].answer.splitlines()[2:] == ["| Nut | 2.00 | 1.50 | 3.00 |", "| Bolt | 1.00 | 7.00 | 7.00 |"]
    assert json.loads(got["reasoning"].answer) == {"subtotal": 10.0, "tax_total": 1.0, "discount_total": 0.0, "sum": 11.0, "stated": 11.0, "agrees": True}
    assert got["summary"].answer == "Invoice I-1 of Acme for Bob: 2 items, 11.00 EUR."


def test_what_is_not_there_is_not_asked(spark):
    got = pairs(spark, changed(due_date=None, items=None, financial={"grand_total": None}))
    assert not {"due_date", "grand_total", "table", "reasoning", "summary"} & set(got) and "line_items" in got
    assert json.loads(pairs(spark, changed(financial={"grand_total": 12.0}))["reasoning"].answer)["agrees"] is False


def test_lines_cross_one_shuffle_and_answers_are_read_once(spark, data):
    from docquarry.queries import QUERIES

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["d1_pairs_by_kind"](spark, data)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the customer is known before the lines are joined, not found by a shuffle of them
    assert 0 < plan.index("Join [invoice_id#") < plan.index("Join [o_custkey#")
    assert plan.count("from_json(") == 1 and "get_json_object(" not in plan


def test_receipt_pairs(spark):
    fields = spark.createDataFrame([(1, "Shop", 4.5, None), (2, None, None, "CASH")], "invoice_id int, merchant string, total double, method string")
    got = {(r.invoice_id, r.kind): r.answer for r in D.receipt_pairs(fields).collect()}
    assert got[1, "receipt_total"] == "4.5" and got[2, "receipt_payment"] == "CASH" and (2, "receipt_total") not in got and json.loads(got[1, "receipt_extraction"]) == {"merchant": "Shop", "total": 4.5}


def sample(**change):
    turns = [{"role": "human", "content": "<image>\nRead."}, {"role": "assistant", "content": '{"region": "a", "content": {}}'}]
    return json.dumps({"image": "a.png", "conversations": turns, **change})


def turn(role, content):
    return {"role": role, "content": content}


#: (sample, error, warnings): written out from the format.
SAMPLES = [
    (sample(), None, []), (None, "invalid_json", []), ('{"image"', "invalid_json", []), ('{"conversations": []}', "missing_image", []), ('{"image": "a"}', "missing_conversations", []),
    (sample(conversations="text"), "invalid_conversations", []), (sample(conversations=[turn("human", "x")]), "invalid_conversations", []), (sample(conversations=[turn("human", "x"), turn("assistant", "plain")]), "answer_no_json", []),
    (sample(conversations=[turn("user", "x"), turn("bot", "{}")]), None, ["first_not_human", "second_not_assistant", "no_region", "no_content"]), (sample(conversations=[turn("bot", "x"), turn("assistant", "")]), "answer_no_json", ["first_not_human"]),
    (sample(conversations=[turn("human", "x"), turn("assistant", '{"region": "a"}')]), None, ["no_content"]),
]


def test_sample_checks(spark):
    df = spark.createDataFrame([(k, s) for k, (s, _, _) in enumerate(SAMPLES)], "k int, sample string")
    got = {r.k: (r.error, r.warnings) for r in D.validate_samples(df).collect()}
    assert got == {k: (e, w) for k, (_, e, w) in enumerate(SAMPLES)}
    made = D.training_samples(D.instruction_pairs(frame(spark, GOOD), ("vendor_block", "summary")), F.lit("a.png"))
    assert {r.kind: (r.error, r.warnings) for r in D.validate_samples(made).collect()} == {"vendor_block": (None, []), "summary": ("answer_no_json", [])}


def test_documents_without_items_are_reviewed(spark):
    from docquarry.plans.documents import parsed, reviewed

    rows = [(1, 1, "Invoice # A-1"), (1, 2, "Date: 2024-01-02"), (2, 1, "nothing at all"), (3, 1, "Invoice #: B"), (3, 2, "Nut  Qty 1  Unit 5.00  Total 5.00"), (3, 3, "Subtotal 5.00"), (3, 4, "Tax 0.00"), (3, 5, "Total 9.00")]
    df = parsed(spark.createDataFrame(rows, "invoice_id int, line_no int, text string"))
    got = {r.invoice_id: (r.n_items, r.needs_review) for r in reviewed(df, F.col("overall")).collect()}
    assert got == {1: (0, False), 2: (0, True), 3: (1, True)}


def test_lines_of_pages(spark):
    from docquarry.operators import layout as L

    cells = [(1, 1, "b", 50, 11, 10, 20, 1.0), (1, 0, "a", 0, 10, 10, 20, 1.0), (1, 2, "c", 0, 60, 10, 20, 1.0)]
    df = spark.createDataFrame(cells, "invoice_id int, region_id int, text string, x int, y int, w int, h int, confidence double")
    assert [(r.line_no, r.text) for r in X.lines_of_pages(L.pages(df)).orderBy("line_no").collect()] == [(20, "a  b"), (70, "c")]
