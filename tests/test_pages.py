"""Fields of pages, read in their row, against the same fields of lines."""

import random

import pytest

from docquarry.operators import extract as X

WORDS = "Walmart walmart Store # St# 42 VISA Visa mastercard amex Discover cash CASH tendered Change change Subtotal SUBTOTAL Tax tax 8.5% Sales Total TOTAL Grand Amount due amt , 1,234.50 12.00 7 3/5/24 11/15/2023 04:32 pm 16:32:10 Nov 15, 2023-11-15 5-Mar-2024 (555) 010-1234 Main Street Ave road Blvd first Receipt REC# No. 17 Cashier: anna7 Reg# Register: r3 debit Credit İx K invoice date page".split()


def documents(n, seed=5):
    r = random.Random(seed)
    line = lambda: "" if r.random() < 0.1 else " " * r.randint(0, 2) + " ".join(r.choice(WORDS) for _ in range(r.randint(1, 5)))
    return [(k, [line() for _ in range(r.choice((1, 2, 5, 12, 25, 40)))]) for k in range(n)] + [(n, [""]), (n + 1, [None, "Total 3.00", None])]


@pytest.mark.parametrize("profile", sorted(X.PROFILES))
def test_pages_give_the_fields_of_their_lines(spark, profile):
    pages = spark.createDataFrame(documents(300), "invoice_id int, page array<string>")
    lines = pages.selectExpr("invoice_id", "posexplode(page) as (line_no, text)").selectExpr("invoice_id", "line_no + 1 line_no", "text")
    read = X.store_receipts if profile == "store_receipt" else lambda df: X.extract_fields(df, profile)
    a, b = read(pages), read(lines)
    assert a.columns == b.columns and a.schema.simpleString() == b.schema.simpleString()
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert "Exchange" not in a._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["x1_fields_receipt", "x1_fields_store_receipt", "d1_receipt_pairs"])
def test_receipts_are_read_in_their_row(spark, data, name):
    from docquarry.queries import QUERIES

    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    # lines are gathered once, and nothing is sorted or gathered after that
    assert plan.count("Aggregate(") <= 2 and "Window" not in plan and "SortAggregate" not in plan
