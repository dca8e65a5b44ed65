"""SQL functions, table functions and the hook for a user's model."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docquarry.functions import scalars as S
from docquarry.operators.hooks import scored

TEXTS = [
    None, "", "  a\t b\x07 ", "$1,234.50", "1.234,56", "-7.5", "12,50", "EUR 99.10", "€5", "12/31/2024", "2024-02-30", "31/12/2024", "Total due", "a@b.org", "+1 (555) 123-4567", "VAT: CH12345", 'x {"a": 1} y',
    '```json\n{"b": [2]}\n```', "table of line_items", "line_item", "US$", "it's 100%", "back\\slash 'quoted' \"text\"", "¥ 1000 yen", "1,000,000",
]


def values(spark, kind):
    if kind == "string":
        return TEXTS
    return [None, 0, 1, -3, 50] if kind == "int" else [None, 0.0, 1.005, -2.5, 1234567.891]


def test_sql_functions_are_the_expressions(spark):
    S.register(spark)
    assert len(S.SQL_FUNCTIONS) >= 25
    for name, (args, make) in S.SQL_FUNCTIONS.items():
        kinds = list(args.values())
        n = max(len(values(spark, k)) for k in kinds)
        rows = [tuple(values(spark, k)[(i * (j + 1)) % len(values(spark, k))] for j, k in enumerate(kinds)) for i in range(n)]
        plain = {"string": "string", "int": "int"}
        df = spark.createDataFrame(rows, ", ".join(f"{a} {plain.get(k, 'double')}" for a, k in args.items())).select(*(F.col(a).cast(k).alias(a) for a, k in args.items()))
        got = df.select(make(*map(F.col, args)).alias("column"), F.expr(f"{name}({', '.join(args)})").alias("sql")).collect()
        assert [r["column"] for r in got] == [r["sql"] for r in got], name
        assert any(r["sql"] is not None for r in got), name
    assert spark.sql("select dq_money_text(dq_parse_currency('EUR 1,234.5').amount, dq_parse_currency('EUR 1,234.5').currency) m").first().m == "EUR 1,234.50"


def test_table_functions(spark):
    S.register(spark)
    rows = spark.sql("""select d.id, i.* from values (1, array(named_struct('description', 'Nut', 'quantity', 2d, 'unit_price', 1.5d, 'line_total', 3d), named_struct('description', 'Bolt', 'quantity', 1d, 'unit_price', cast(null as double), 'line_total', 7d))), (2, array()), (3, null) as d(id, items), lateral dq_items(items) i""").collect()
    assert [tuple(r) for r in rows] == [(1, 1, "Nut", 2.0, 1.5, 3.0), (1, 2, "Bolt", 1.0, None, 7.0)]
    amounts = spark.sql("select a.pos, a.amount from values ('2 x 1,200.50 = 2401'), (null) as d(txt), lateral dq_amounts(txt) a").collect()
    assert [(r.pos, float(r.amount)) for r in amounts] == [(1, 2.0), (2, 1200.5), (3, 2401.0)]


def test_scorer_hook(spark):
    df = spark.createDataFrame([(k, "w" * k, k / 2) for k in range(50)], "id long, text string, size double").repartition(3)
    good = lambda: lambda b: pd.DataFrame({"score": b["text"].str.len() * 1.0, "label": b["text"].str.len() % 2 == 0})
    out = scored(df, good, ["text"], "score double, label boolean", ["id"])
    assert out.columns == ["id", "score", "label"] and {(r.id, r.score, r.label) for r in out.collect()} == {(k, float(k), k % 2 == 0) for k in range(50)}
    assert scored(df.where("false"), good, ["text"], "score double, label boolean", ["id"]).count() == 0
    # inputs and kept columns may be the same; the order of the model's columns is its own
    both = scored(df, lambda: lambda b: pd.DataFrame({"b": b["id"], "a": b["size"]}), ["id", "size"], "a double, b long", ["id", "text"])
    assert {(r.id, r.a, r.b) for r in both.collect()} == {(k, k / 2, k) for k in range(50)}


@pytest.mark.parametrize(("model", "message"), [
    (lambda b: pd.DataFrame({"score": [1.0]}), "rows for"), (lambda b: pd.DataFrame({"points": b["id"]}), "columns"), (lambda b: pd.DataFrame({"score": ["high"] * len(b)}), "no numbers"), (lambda b: 1.0, "float rows"),
])
def test_a_model_that_breaks_its_schema_is_refused(spark, model, message):
    df = spark.range(10).coalesce(1)
    with pytest.raises(Exception, match=message):
        scored(df, lambda: model, ["id"], "score double").collect()


def test_columns_are_checked_before_anything_runs(spark):
    with pytest.raises(ValueError, match="not there"):
        scored(spark.range(1), lambda: None, ["nothing"], "score double")
    with pytest.raises(ValueError, match="kept and scored"):
        scored(spark.range(1), lambda: None, ["id"], "ID double", ["id"])
