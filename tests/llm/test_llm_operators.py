"""The ten operators against brute force, at their edges, and their queries over a given table."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from docquarry.llm import blocks, common, contexttree, decontaminate, embeddings, language, mixing, nearcopies, neardup, quality, queries, substrings, text, tokens, toxicity


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# --------------------------------------------------------------------------------------------- words


def test_words_hashes_and_windows():
    rng = np.random.default_rng(1)
    for _ in range(60):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice(list("ab \t\né"), rng.integers(0, 40))) for _ in range(rng.integers(0, 7))]
        words = text.Words(*text.texts_of(pa.array(texts, pa.string())))
        expect = [brute.SPACED.findall(t or "") for t in texts]
        flat = [w for x in expect for w in x]
        assert [bytes(words.data[a:b]).decode() for a, b in zip(words.start, words.end, strict=True)] == flat
        assert words.counts.tolist() == [len(x) for x in expect]
        seen = {}
        for w, h in zip(flat, words.hashes().tolist(), strict=True):
            assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)
        at, h = words.windows(3, words.hashes())
        grams = [tuple(x[i : i + 3]) for x in expect for i in range(len(x) - 2)]
        assert len(grams) == len(h) and len(set(h.tolist())) == len(set(grams))
        line, ends, _ = text.joined(words)
        assert [bytes(line[a:b]).decode() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [" ".join(x) for x in expect]


def test_components(spark):
    edges = [(5, 1), (5, 9), (9, 12), (12, 40), (7, 8), (8, 8), (100, 99), (99, 98), (98, 97)]
    got = dict(rows_of(common.connected_components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {1: 1, 5: 1, 9: 1, 12: 1, 40: 1, 7: 7, 8: 7, 97: 97, 98: 97, 99: 97, 100: 97}
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert set(common.connected_components(chain).toPandas().component) == {0}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_storage_is_the_shared_folder(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


# ------------------------------------------------------------------------------- 1, 2, 9: classifiers


def test_quality_edges(docs, none, labels):
    out = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(out) == docs.select("doc_id").distinct().count()
    assert quality.quality_scores(docs, labels).count() == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out.values())
    assert all(r["held_out"] == (brute.fold(i, 3) == 1) for i, r in out.items())
    assert quality.quality_scores(none, labels).count() == 0
    assert {r["score"] for r in quality.quality_scores(docs, labels.where("1 = 0")).collect()} == {0.5}


def test_quality_learns(spark, data):
    good = [f"{w} house stands near a quiet river and people walk along number {i}" for i, w in enumerate(["old", "new", "red", "big"] * 30)]
    bad = [f"$$$ buy!!! ### win{i} &&& cash!!! $$$ click*** %%% now###" for i in range(120)]
    model = quality.CompressionClassifier([(i, t, y) for i, (t, y) in enumerate(pair for both in zip([(g, 1) for g in good], [(b, 0) for b in bad], strict=True) for pair in both)])
    score = model.scores(pa.array(["an old house stands near a river", "!!! win99 $$$ ### cash!!! ***", "", None]))
    assert score[0] > 0.5 > score[1] and score[2] == score[3]
    kept = quality.good_documents(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() > 0


def test_language_edges(docs, none):
    out = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.languages(docs).collect()]
    assert len(out) == docs.count()
    by = {i: (x, s) for i, x, s in out}
    assert all(by[i] == ("und", 0.0) for i in (1, 2, 3, 11)) and by[10][0] != "und"
    assert all(0 <= s <= 1 for _, _, s in out)
    assert language.languages(none).count() == 0
    assert {r["lang_pred"] for r in language.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_accuracy_on_held_out(spark, data):
    known = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    out = language.languages(spark.read.parquet(f"{data}/documents.parquet")).where("held_out").join(known, "doc_id").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.9


def test_toxicity_edges(docs, none, labels):
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["score"] == 0 for r in out if r["doc_id"] in (1, 2, 3))
    assert toxicity.toxicity(none, labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(docs, labels.where("1 = 0")).collect()} == {0.0}


def test_toxicity_finds_the_sentence():
    calm = ["We met at noon. The lake was still", "Rain fell. They stayed at home", "A good day. Bread and cheese", "He reads a book. She sings"]
    rows = [(i, calm[i % 4] + f" part {i}.", 0) for i in range(60)] + [(100 + i, f"{calm[i % 4]}. You utter moron{'' if i % 2 else 's'}! {calm[(i + 1) % 4]}.", 1) for i in range(60)]
    model = toxicity.NoisyOr(rows)
    batch = pa.array(["The lake was still. You are morons! Bread and cheese.", "The lake was still.", ""])
    ((_, s, odds, score),) = model.sentence_scores(batch)
    assert score[0] > 0.5 > score[1] and score[2] == 0
    assert odds.tolist().index(max(odds)) == 1 and s.spans()[0][1] == 20


# ---------------------------------------------------------------------------------------- 3: vectors


def links_of(vectors, labels, threshold=0.93):
    def vector(v):
        if v is None or not len(v) or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, float)
        return a / np.sqrt((a * a).sum())

    unit = [vector(v) for v in vectors]
    return lambda i, j: i != j and labels[i] is not None and labels[i] == labels[j] and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= threshold


def test_embeddings_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    vectors = [(base[i % 40] + rng.normal(size=8) * rng.choice([0.05, 0.25, 0.6])).astype(np.float32).tolist() for i in range(300)]
    vectors += [vectors[0]] * 12 + [[0.0] * 8, None, [], [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1e-30] * 8, [1e30] * 8, [1.0, 2.0, 3.0]]
    labels = [int(x) for x in rng.integers(0, 3, len(vectors) - 1)] + [None]
    df = spark.createDataFrame([(i, v, k) for i, (v, k) in enumerate(zip(vectors, labels, strict=True))], "vec_id long, embedding array<float>, label int").selectExpr("*", "1 n_links", "2 rep", "3 m")
    linked = links_of(vectors, labels)
    n = [sum(linked(i, j) for j in range(len(vectors))) for i in range(len(vectors))]
    part = brute.components(list(range(len(vectors))), linked)
    for block, words in ((2048, 4), (16, 4), (40, 16), (2048, 64), (16, 256)):
        monkeypatch.setattr(embeddings, "BLOCK", block)
        monkeypatch.setattr(embeddings, "LEAST_WORDS", words)
        got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
        found = sum(r["n_links"] for r in got.values())
        assert found >= 0.97 * sum(n) and all(got[i]["n_links"] <= n[i] for i in got)
        assert sum(got[i]["component_id"] == part[i] for i in got) >= 0.97 * len(got)
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert embeddings.near_duplicates(df.where("1 = 0")).count() == 0
    assert {r["n_links"] for r in embeddings.near_duplicates(df.where("vec_id > 311 and vec_id < 316")).collect()} == {0}


def shaped(kind):
    rng = np.random.default_rng(11)
    if kind == "low_rank":
        return rng.normal(size=(700, 4)) @ rng.normal(size=(4, 48))
    if kind == "one_half":
        base = np.repeat(rng.normal(size=(20, 48)), 35, 0)
        base[:, :24] += rng.normal(size=(700, 24)) * 0.45
        return base
    base, out = rng.normal(size=(14, 48)), []
    for b in base:
        turn = rng.normal(size=(3, 48))
        out.append(b + np.linalg.norm(b) * 0.2 * rng.normal(size=(50, 3)) @ (turn / np.linalg.norm(turn, axis=1)[:, None]))
    return np.concatenate(out)


@pytest.mark.parametrize("kind", ["low_rank", "one_half", "clustered"])
def test_links_of_data_of_few_dimensions_are_found(spark, kind, monkeypatch):
    """Recall through the grid of 4 to 256 codewords; the safe bound is exact."""
    v = shaped(kind)
    u = embeddings.unit(v)
    near = u @ u.T >= 0.93
    np.fill_diagonal(near, False)
    for words in (4, 16, 64, 256):
        grid = embeddings.MultiIndex(u[::2], words, 0.93)
        home = grid.home(u)
        bounds = grid.bounds(u)
        visits = bounds[0][:, home[0]] + bounds[1][:, home[1]] <= grid.stop
        found = near & (visits | visits.T)
        assert found.sum() >= 0.99 * near.sum()
        safe = embeddings.MultiIndex(u[::2], words, 0.93, recall=1.0)
        assert safe.stop == safe.safe and (near <= (bounds[0][:, home[0]] + bounds[1][:, home[1]] <= safe.stop)).all()
    df = spark.createDataFrame([(k, x.tolist(), 1) for k, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(embeddings, "LEAST_WORDS", 16)
    part = brute.components(list(range(len(v))), lambda i, j: near[i, j])
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, recall=1.0).collect()}
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in range(len(v))] == list(zip(near.sum(axis=1).tolist(), part, strict=True))


@pytest.mark.parametrize("kind", ["string", "int", "double"])
def test_ids_of_other_types(spark, docs, rows, kind):
    """op3, op10, the near-copy stage and op5 on ids that are no longs."""
    own = docs.withColumn("doc_id", F.col("doc_id").cast(kind))
    want = {"string": "string", "int": "bigint", "double": "double"}[kind]
    vectors = spark.createDataFrame([(5, [1.0, 0.0], 1), (40, [1.0, 0.01], 1), (None, [0.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    got = embeddings.near_duplicates(vectors.withColumn("vec_id", F.col("vec_id").cast(kind)))
    assert got.schema["component_id"].dataType.simpleString() == want
    first = "40" if kind == "string" else 5
    assert {(r["vec_id"], r["component_id"], r["kept"]) for r in got.collect()} == {(f(5), first, f(5) == first), (f(40), first, f(40) == first), (None, None, False)} if (f := {"string": str, "int": int, "double": float}[kind]) else None
    prints = neardup.near_duplicates(own)
    assert prints.schema["component_id"].dataType.simpleString() == want and prints.count() == len(rows)
    assert nearcopies.groups(own).schema["component_id"].dataType.simpleString() == want
    assert nearcopies.one_of_each(own).columns == own.columns
    scored = contexttree.scores(own).collect()
    learned = {r["doc_id"]: r["n_tokens"] for r in scored if r["doc_id"] is not None and not r["held_out"]}
    assert sum(r["n_tokens"] for r in scored if r["doc_id"] is not None and not r["held_out"]) == scored[0]["train_tokens"] and learned


def test_repeated_ids_fetch_their_own_texts(spark):
    """Rows that share one id: a near-copy stage reads each text once."""
    base = [[f"w{(k * 37 + x) % 5000}" for x in range(60)] for k in range(30)]
    rows = [(7, " ".join(w)) for w in base] + [(7, " ".join([*w[:58], "x", "y"])) for w in base]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    classes = nearcopies.numbered(nearcopies.prints_of(df))
    assert nearcopies.texts_for(df, classes.select("set"), classes).count() == 60
    assert nearcopies.one_of_each(df).count() == 30


def test_sets_that_share_a_key_stay_apart(spark):
    rows = [(k, 1, 9, c, 3, 0, [1], [1]) for k, c in ((1, 5), (2, 5), (3, 6), (4, -6))]
    prints = spark.createDataFrame(rows, "doc_id long, text_hash long, key long, check long, n long, fp long, prefix array<long>, sketch array<int>")
    got = nearcopies.numbered(prints).collect()
    assert len(got) == 3 and len({r["set"] for r in got}) == 3 and {r["set"] for r in got if r["check"] == -6} == {9}


def test_windows_with_one_hash_are_told_apart():
    keys, check = np.array([5, 5, 7, 5, 7], np.uint64), np.array([1, 2, 3, 1, 3], "<u4")
    order, first = substrings.grouped(keys, check)
    assert np.diff(np.append(first, 5)).tolist() == [2, 1, 2] and keys[order].tolist() == [5, 5, 5, 7, 7]


def test_traversal_visits_ascending_and_all_within_the_bound():
    rng = np.random.default_rng(2)
    u = embeddings.unit(rng.normal(size=(200, 10)))
    grid = embeddings.MultiIndex(u, 16, 0.93)
    rows_, cells = grid.visits(u)
    one, two = grid.bounds(u)
    every = one[:, :, None] + two[:, None, :]
    for k in range(len(u)):
        own = cells[rows_ == k]
        bounds = every[k].ravel()[own]
        assert (np.diff(bounds) >= 0).all() and set(own) == set(np.flatnonzero(every[k].ravel() <= grid.stop))


def test_repeated_and_missing_ids(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (None, [0.0, 1.0], 1), (None, [1.0, 1.0], 1), (7, [0.0, 1.0], 2)]
    got = Counter(map(tuple, embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()))
    assert got == Counter([(5, 1, 2, False), (5, 1, 5, True), (2, 1, 2, True), (None, 1, 5, False), (None, 0, None, False), (7, 0, 7, True)])


def test_embeddings_query_recall(spark, data):
    got = queries.op3_embedding_near_dedup(spark, data).toPandas().set_index("vec_id")
    v = spark.read.parquet(f"{data}/embeddings.parquet").toPandas()
    linked = links_of([list(x) for x in v.embedding], v.label.tolist())
    n = [sum(linked(i, j) for j in range(len(v))) for i in range(len(v))]
    assert (got.loc[v.vec_id].n_links.to_numpy() <= np.array(n)).all() and got.n_links.sum() >= 0.9 * sum(n)


# ----------------------------------------------------------------------------------- 4: substrings


def test_substrings_match_brute_force(spark, docs, none, rows, monkeypatch):
    monkeypatch.setattr(blocks, "SHARD_BYTES", 50_000)
    monkeypatch.setattr(blocks.pack, "__defaults__", (20_000,))
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    out = substrings.without_repeats(docs).select("doc_id", "n_words", n, F.sha2(F.col("kept").cast("binary"), 256))
    expect = brute.without_repeats([r[1] for r in rows])
    assert Counter(rows_of(out)) == Counter((r[0], *e) for r, e in zip(rows, expect, strict=True))
    assert substrings.without_repeats(none).count() == 0


def test_removed_intervals_are_maximal(spark):
    shared = [f"w{i}" for i in range(80)]
    df = spark.createDataFrame([(1, " ".join(["x", *shared, "y"])), (2, " ".join(shared))], "doc_id long, text string")
    got = {r["doc_id"]: [(x["a"], x["b"]) for x in r["removed"]] for r in substrings.without_repeats(df).collect()}
    assert got == {1: [(1, 81)], 2: [(0, 80)]}


# --------------------------------------------------------------------------------- 5: context trees


def brute_tree(texts, trained):
    depth, counts = contexttree.DEPTH, {}

    def steps(t):
        b = b"\0" * depth + " ".join(brute.SPACED.findall(brute.low(t))).encode() + b"\n"
        for k in range(depth, len(b)):
            for j in range(8):
                yield b[k - depth : k], (1 << j) | (b[k] >> (8 - j)), (b[k] >> (7 - j)) & 1

    for t in (t for t, x in zip(texts, trained, strict=True) if x):
        for c, node, bit in steps(t):
            for d in range(depth + 1):
                counts.setdefault((d, c[depth - d :], node), [0, 0])[bit] += 1
    lg = math.lgamma
    kt = {n: lg(a + 0.5) + lg(b + 0.5) - 2 * lg(0.5) - lg(a + b + 1) for n, (a, b) in counts.items()}
    weighted, below = {}, {}
    for n in sorted(counts, key=lambda n: -n[0]):
        weighted[n] = kt[n] if n[0] == depth else np.logaddexp(kt[n], below[n]) - math.log(2)
        if n[0]:
            up = (n[0] - 1, n[1][1:], n[2])
            below[up] = below.get(up, 0.0) + weighted[n]
    out = []
    for t in texts:
        total = 0.0
        for c, node, bit in steps(t):
            p = None
            for d in range(depth, -1, -1):
                n = (d, c[depth - d :], node)
                if n in counts:
                    a, b = counts[n]
                    one, stop = (b + 0.5) / (a + b + 1), math.exp(kt[n] - math.log(2) - weighted[n]) if d < depth else 1.0
                    p = one if p is None else stop * one + (1 - stop) * p
            p = 0.5 if p is None else p
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def test_context_tree_matches_brute_force(docs, none, rows, monkeypatch):
    monkeypatch.setattr(blocks, "SHARD_BYTES", 300)
    monkeypatch.setattr(blocks.pack, "__defaults__", (400,))
    some = [r for r in rows if r[0] != 9]
    trained = [r[0] is not None and brute.fold(r[0], 10) != 0 for r in some]
    words = [brute.SPACED.findall(brute.low(r[1])) for r in some]
    seen = Counter(w for x, t in zip(words, trained, strict=True) if t for w in x)
    seen[None] = sum(trained)
    n, v = sum(seen.values()), len(seen)
    expect = sorted(zip([r[0] if r[0] is not None else -99 for r in some], brute_tree([r[1] for r in some], trained), words, strict=True), key=lambda x: x[:2])
    got = sorted(contexttree.scores(docs.where("doc_id is null or doc_id <> 9")).collect(), key=lambda r: (r["doc_id"] if r["doc_id"] is not None else -99, r["score"]))
    assert len(got) == len(expect)
    for r, (i, score, w) in zip(got, expect, strict=True):
        assert (r["doc_id"] if r["doc_id"] is not None else -99) == i
        assert r["score"] == pytest.approx(score, rel=1e-5) and r["n_tokens"] == len(w) + 1 and r["train_tokens"] == n
        assert r["base_score"] == pytest.approx(sum(math.log10((seen.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, None]), rel=1e-9)
        assert r["n_known"] == sum(seen.get(x, 0) > 0 for x in [*w, None]) and r["held_out"] == (r["doc_id"] is not None and brute.fold(r["doc_id"], 10) == 0)
    assert contexttree.scores(none).count() == 0


def test_context_tree_is_a_distribution():
    pairs = np.array([contexttree.streams(text.Words(*text.texts_of(pa.array(["abra cadabra"]))))[0]]).ravel()
    keys, n = blocks.distinct(pairs)
    levels = contexttree.shard_levels(keys, n)
    low = levels[-1]
    import pandas as pd

    top = contexttree.Top(pd.DataFrame({"node": low.parents(), "a": low.a, "b": low.b, "below": low.weighted}).groupby("node", as_index=False).sum())
    for context in (pairs[3] >> np.uint64(8), np.uint64(0x7A7A7A7A7A)):
        every = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert np.exp2(contexttree.log_probabilities(every, levels, top)).sum() == pytest.approx(1)


# --------------------------------------------------------------------------------------- 6: tokens


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 777)
    packed = tokens.pack(ids, bits)
    assert len(packed) == -(-777 * bits // 8)
    assert (tokens.unpack(packed, bits, 0, 777) == ids).all() and (tokens.unpack(packed, bits, 333, 600) == ids[333:600]).all()


def test_units_encode_as_whole_texts():
    use = tokens.encoder(queries.vocabulary())
    rng = np.random.default_rng(3)
    alphabet = [*"aAbzZ'sStTlLvVeEmM.,!?-_()<|>$%&#@ \t\n\x0b\x0c\r0123éÉñçßüÜ×÷ſǺ中文🙂İıΣσ=\"~^*\x00\x7f²½", "́", "̸", " ", " ", "<|endoftext|>", "<|EndOfText|>", "<|STARTOFTEXT|>", "<|startoftext|>", "'ll"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 25))) for _ in range(8000)]
    ids, at = use.encode(*text.texts_of(pa.array(texts)))
    for i, x in enumerate(use.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == [*x.ids, 1], texts[i]


def test_any_vocabulary_encodes_as_its_library():
    """A cased vocabulary has other rules: whole texts go to the library."""
    import public_tokenizers

    use = tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not use.units and tokens.encoder(queries.vocabulary()).units
    texts = ["Hello World", "hello world", "", "  Tabs\tAND  <|endoftext|> \n", "中文🙂 Été"]
    ids, at = use.encode(*text.texts_of(pa.array([*texts, None])), end=None)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [x.ids for x in use.tokenizer.encode_batch([*texts, ""], add_special_tokens=False)]


def test_token_files(spark, docs, none, rows):
    path = common.new_path(spark, "test-tokens")
    got = tokens.tokenized(docs, queries.vocabulary(), path).orderBy("start").collect()
    use, start = tokens.encoder(queries.vocabulary()), 0
    for r, row in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        ids = [*use.tokenizer.encode(row[1] or "", add_special_tokens=False).ids, 1]
        assert tuple(r) == (row[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    (one,) = tokens.token_ids(spark, path, 4)
    assert one.tolist() == [*use.tokenizer.encode(rows[3][1], add_special_tokens=False).ids, 1]
    assert len(tokens.token_ids(spark, path, 12)) == 2 and tokens.token_ids(spark, path, 77) == []
    assert tokens.tokenized(none, queries.vocabulary()).count() == 0


# ------------------------------------------------------------------------------------------ 7: mix


def test_sainte_lague_gives_highest_quotients(spark):
    rng = np.random.default_rng(2)
    rows = [(g, k, float(v), int(s)) for g, s in enumerate((0, 1, 7, 50, 333)) for k, v in enumerate(rng.exponential(size=9) ** 3 * (np.arange(9) != 4))]
    got = {(r["g"], r["k"]): r["quota"] for r in mixing.sainte_lague(spark.createDataFrame(rows, "g int, k int, v double, s long"), ["g"], "k", "v", "s").collect()}
    for g in range(5):
        votes, seats = {k: v for gg, k, v, _ in rows if gg == g}, next(s for gg, _, _, s in rows if gg == g)
        expect = Counter(k for _, k in sorted((-v / (2 * i + 1), k) for k, v in votes.items() for i in range(seats) if v > 0)[:seats])
        assert {k: got[g, k] for k in votes} == {k: expect.get(k, 0) for k in votes}


def test_targets_reshare_excess(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), ("d", 0)], "key string, source_size long")
    got = {r["key"]: r["target"] for r in mixing.source_targets(df, (3, 1, 2), 1.5, 2.0).collect()}
    assert got["a"] == 20 and got["d"] == 0 and sum(got.values()) == pytest.approx(1.5 * 2010)
    assert got["c"] == pytest.approx(2 * got["b"]) and got["b"] == pytest.approx(2995 / 3)
    got = {r["key"]: r["target"] for r in mixing.source_targets(df, (3, 1, 2), 1.6, 2.0).collect()}
    assert (got["a"], got["c"]) == (20, 2000) and got["b"] == pytest.approx(3216 - 2020)
    got = {r["key"]: r["target"] for r in mixing.source_targets(df, (3, 1, 2), 5.0, 2.0).collect()}
    assert (got["a"], got["b"], got["c"], got["d"]) == (20, 2000, 2000, 0)


def test_mix_edges(docs, none, rows):
    out = mixing.mixed_documents(docs).collect()
    again = mixing.mixed_documents(docs.repartition(7)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again)) and len(out) == len(rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    sizes = Counter()
    for r in rows:
        sizes[r[0], len(brute.SPACED.findall(r[1] or ""))] += 1
    assert Counter((r["doc_id"], r["size"]) for r in out) == sizes
    assert mixing.mixed_documents(none).count() == 0
    copies = mixing.mixed_copies(docs)
    assert set(copies.collect()) <= set(docs.collect())
    assert copies.columns == docs.columns and copies.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 4


def test_mix_reaches_targets(spark, data):
    out = queries.op7_source_mix(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source"), "doc_id").toPandas()
    for _, g in out.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= max(0.02 * g.target.iloc[0], 64) and g["size"].sum() == g.source_size.iloc[0]


def test_mix_runs_no_python(docs):
    plan = mixing.mixed_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


# ------------------------------------------------------------------------------ 8: decontamination


def bench(spark, rows):
    items = [(1, " ".join(brute.ALNUM.findall(brute.low(rows[3][1]))[4:30])), (2, "WORD"), (3, None), (4, "..."), (5, "lazy dog and"), (6, " ".join(f"word{i}" for i in range(20, 33))), (6, "quick Brown"), (None, "no id")]
    return spark.createDataFrame(items, "item_id long, text string"), [("" if i is None else i, t) for i, t in items]


@pytest.mark.parametrize("size", [1 << 26, 60])
def test_contamination_matches_brute_force(spark, docs, none, rows, size):
    table, items = bench(spark, rows)
    out = decontaminate.contaminated_documents(docs, table, index_bytes=size).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    expect = brute.contamination([r[1] for r in rows], items)
    assert Counter(rows_of(out)) == Counter((r[0], *e, e[1] > 0) for r, e in zip(rows, expect, strict=True))
    assert decontaminate.contaminated_documents(none, table).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contaminated_documents(docs, table.where("1 = 0")).collect())
    clean = decontaminate.clean_documents(docs, table)
    kept = {r for r, e in zip(rows, expect, strict=True) if e[1] == 0}
    assert clean.columns == docs.columns and clean.count() == sum(e[1] == 0 for e in expect) and {tuple(r)[:4] for r in clean.collect()} == kept


@pytest.mark.parametrize("size", [1 << 20, 100])
def test_every_shared_window_is_found(spark, size):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 80))) for _ in range(150)]
    items = [(i, " ".join(t.split()[rng.integers(0, 20) :][:12])) for i, t in enumerate(texts[:40])]
    items += [(100 + i, t) for i, t in enumerate(dict(items).values())] + [(0, "w1 w2 w3 again"), (200, "w5"), (201, "w7 w8")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(rows_of(decontaminate.contaminated_documents(df, spark.createDataFrame(items, "item_id long, text string"), index_bytes=size).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256")))
    assert got == [(i, *e) for i, e in enumerate(brute.contamination(texts, items))]


# --------------------------------------------------------------------------------------- 10: SimHash


def test_simhash_matches_brute_force(spark, docs, none, rows):
    ids, texts = [r[0] for r in rows if r[0] is not None], [r[1] for r in rows if r[0] is not None]
    prints = [brute.fingerprint(t) for t in texts]
    part = brute.components(ids, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    out = rows_of(neardup.near_duplicates(docs).where("doc_id is not null"))
    assert Counter(out) == Counter((i, f"{p:016x}", c) for i, p, c in zip(ids, prints, part, strict=True))
    assert neardup.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("hot", "block"), [(48, 2048), (2, 16)])
def test_links_are_complete(spark, hot, block, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", hot)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 1 << 62, 12)]
    prints = sorted({b ^ sum(1 << int(k) for k in rng.choice(62, rng.integers(0, 5), replace=False)) for b in base for _ in range(40)})
    df = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "__fp long, __rep long")
    part = brute.components(list(range(len(prints))), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    got = dict(rows_of(common.connected_components(neardup.links(df))))
    assert [got.get(i, i) for i in range(len(prints))] == part


def test_thresholds_leave_no_gap():
    fp = np.random.default_rng(0).integers(0, 1 << 62, 500)
    plan = neardup.Plan(fp, 10**9)
    t = plan.thresholds(fp)
    assert ((t + 1).sum(axis=1) == 3).all() and sorted(b for g in plan.groups for b in g) == list(range(64))
