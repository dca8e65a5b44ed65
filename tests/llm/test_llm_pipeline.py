"""The pipeline against its stages, and the names that must be there."""

import corpus_pipeline
from docquarry.llm import queries
from docquarry.llm.common import materialize, table


def test_pipeline_equals_its_stages(spark, data):
    docs, sizes = table(spark, data, "documents"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, data), f"test{k}")
        sizes.append(docs.count())
        assert k == 4 or docs.columns == columns
    assert sizes[0] >= sizes[1] >= sizes[2] and sizes[3] == sizes[4]
    got = corpus_pipeline.run(spark, data).toPandas().sort_values("start").reset_index(drop=True)
    assert got.equals(docs.toPandas().sort_values("start").reset_index(drop=True))


def test_all_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_stages_take_edge_cases(spark, docs, none, data):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        rows = out.collect()
        assert k == 4 or (out.columns == docs.columns and set(rows) <= set(docs.collect()))
        assert stage(spark, none, data).count() == 0


def test_near_copies_are_told_apart_by_text(spark, docs):
    """Of a repeated id one text is a copy of another document and goes; the other stays."""
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").select("doc_id", "text").collect()
    assert [r["text"] for r in kept if r["doc_id"] == 14] == ["one of a kind here"]
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [-5, 1, 4, 7, 9, 10, 11, 12, 14]
