"""SentencePiece ids and decoded texts by chunks equal those of the library for whole texts."""

import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from docquarry.llm import pieces
from docquarry.llm.queries import op11_sentencepiece, piece_model


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


def plain(library, text):
    ids = library.encode(text or "", add_eos=True)
    return ids, library.decode(ids)


@pytest.mark.parametrize("block_bytes", [8 << 20, 2000])
def test_equals_the_library(spark, library, block_bytes):
    rng = random.Random(3)
    parts = [" ", "  ", "\t", "\n", "▁", "▁▁", "a", "the", "é", "é", "中", "🙂", "\x00", "​", "　", ".", "hello", "   ", "ﬁ", "1", "<s>", "</s>", "<unk>", "<0x41>", " " * 40]
    texts = [None, "", " ", "▁", "a", "x" * 5000, "word " * 4000, *("".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(1500))]
    rows = pieces.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), piece_model(), block_bytes).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        assert (list(r.ids), r.decoded) == plain(library, texts[r.doc_id])


def test_cases(spark, docs, none, rows, library):
    found = sorted((str(r.doc_id), list(r.ids), r.decoded) for r in pieces.encoded(docs, piece_model()).collect())
    assert found == sorted((str(i), *plain(library, t)) for i, t, *_ in rows)
    assert pieces.encoded(none, piece_model()).collect() == []
    text_ids = pieces.encoded(docs.withColumn("doc_id", F.col("doc_id").cast("string")), piece_model())
    assert text_ids.schema["doc_id"].dataType.simpleString() == "string" and text_ids.count() == len(rows)


def test_bytes_that_are_no_text(spark, library):
    raw = [b"a\xff b", b"\xe4\xb8 x", b"ok \xf0\x9f"]
    df = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(raw)], "doc_id int, b binary").selectExpr("doc_id", "cast(b as string) text")
    for r in pieces.encoded(df, piece_model()).collect():
        assert list(r.ids) == [*library.encode(raw[r.doc_id]), library.eos_id()] and r.decoded == library.decode(list(r.ids))


def test_models_with_other_rules_get_whole_texts(library):
    model = pieces.Model(piece_model())
    assert model.apart
    model.apart = False
    import numpy as np

    texts = [b"one two", b"", b"  three"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    data, edges, first = model.cut(data, offsets)
    chunks = [data[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    assert chunks == [b"one two", b"  three"] and first.tolist() == [0, 1, 1, 2]
    assert [np.frombuffer(r[0], np.int32).tolist() for r in model.segment(chunks)] == [library.encode("one two"), library.encode("  three")]


def test_each_chunk_of_a_block_is_segmented_once(monkeypatch):
    import numpy as np

    model, asked = pieces.Model(piece_model()), []
    segment = model.segment
    monkeypatch.setattr(model, "segment", lambda chunks: asked.extend(chunks) or segment(chunks))
    text = b"the same words " * 500
    for _ in range(2):
        model.encode(np.frombuffer(text * 2, np.uint8), np.array([0, len(text), 2 * len(text)]))
    assert sorted(asked) == [b" ", b" same", b" the", b" words"]


def test_query(spark, data, library):
    want = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = op11_sentencepiece(spark, data).collect()
    assert len(rows) == len(want)
    for r in rows:
        ids, text = plain(library, want[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
