"""Scores, the mix and the pipeline against plain Python over whole tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from docquarry.llm import language, mixing, quality, queries, toxicity
from docquarry.llm.common import table


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r["doc_id"]: r for r in table(spark, data, "documents").collect()}


def labelled(spark, data, label, mod, held):
    seen = defaultdict(set)
    for r in table(spark, data, "labels").collect():
        if r["doc_id"] is not None and r[label] in (0, 1) and brute.fold(r["doc_id"], mod) != held:
            seen[r["doc_id"]].add(r[label])
    return {i: min(v) for i, v in seen.items() if len(v) == 1}


# ------------------------------------------------------------------------------------- what is learned from


@pytest.mark.parametrize(("label", "mod", "held"), [("quality", 3, 1), ("toxic", 5, 0)])
def test_sample_is_every_eligible_text_within_its_bounds(spark, data, texts, label, mod, held):
    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    draw = lambda most, longest, in_all: quality.labelled_sample(docs, labels, label, mod, held, most, longest, in_all)
    every = {(texts[i]["text"], y) for i, y in labelled(spark, data, label, mod, held).items() if i in texts and texts[i]["text"] is not None}
    size = lambda t: len(t.encode())
    assert {(t, y) for _, t, y in draw(10**6, 1 << 30, 1 << 40)} == every
    assert {(t, y) for _, t, y in draw(10**6, 2000, 1 << 40)} == {x for x in every if size(x[0]) <= 2000}
    for some in (draw(3, 4000, 1 << 40), draw(10**6, 4000, 9000)):
        assert {(t, y) for _, t, y in some} <= every and some == sorted(some)
    assert max(Counter(y for *_, y in draw(3, 4000, 1 << 40)).values()) == 3
    assert all(sum(size(t) for _, t, y in draw(10**6, 4000, 9000) if y == v) <= 9000 for v in (0, 1))


def test_sample_leaves_out_what_is_in_doubt(spark):
    docs = spark.createDataFrame([(2, "a b"), (2, "a b"), (2, "c"), (3, "x"), (6, "y"), (None, "z"), (8, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 1), (2, 1), (3, 0), (3, 1), (6, 0), (None, 1), (8, 1), (99, 1), (6, None)], "doc_id long, quality int")
    got = quality.labelled_sample(docs, labels, "quality", 10**9, -1, 100, 1000, 10**6)
    assert sorted(x[1:] for x in got) == [("a b", 1), ("c", 1), ("y", 0)]


# --------------------------------------------------------------------------------------------------- scores


def test_quality_query_equals_two_plain_compressions(spark, data, texts):
    model = quality.fit(table(spark, data, "documents"), table(spark, data, "labels"))
    plain = dict(write_content_size=False, write_checksum=False, write_dict_id=False)
    bad, good = (zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), **plain) for d in model.dictionaries)
    got = queries.op1_quality_compression(spark, data).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(list(texts))
    for r in got:
        raw = (texts[r["doc_id"]]["text"] or "").encode()
        parts = [raw[k : k + quality.PIECE] for k in range(0, len(raw), quality.PIECE)]
        x = sum(len(bad.compress(p)) - len(good.compress(p)) for p in parts) / max(len(raw), 1)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(model.slope * x + model.bias))), abs=2e-3)
        assert r["held_out"] == (brute.fold(r["doc_id"], 3) == 1) and r["predicted"] == int(r["score"] >= 0.5)


def plain_grams(text):
    s = "".join(c if c.isalpha() else " " for c in brute.low(text))
    for n in language.GRAMS:
        for k in range(len(s) - n + 1):
            if s[k : k + n].strip(" "):
                h = n
                for c in s[k : k + n]:
                    h = (h ^ ord(c)) * 0x9E3779B1 & 0xFFFFFFFF
                    h ^= h >> 15
                yield h % language.BUCKETS


def test_language_query_equals_plain_naive_bayes(spark, data, texts):
    grams = {i: list(plain_grams(r["text"])) for i, r in texts.items()}
    counts, priors = defaultdict(Counter), Counter()
    for i, r in texts.items():
        if brute.fold(i, 3) != 1 and r["lang"] is not None and r["text"] is not None:
            counts[r["lang"]].update(grams[i])
            priors[r["lang"]] += 1
    all_n = {x: sum(c.values()) + language.SMOOTH * language.BUCKETS for x, c in counts.items()}
    for r in queries.op2_language(spark, data).collect():
        text = texts[r["doc_id"]]["text"] or ""
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        logs = {x: math.log(priors[x] / sum(priors.values())) + sum(math.log((counts[x][g] + language.SMOOTH) / all_n[x]) for g in grams[r["doc_id"]]) for x in priors}
        best = max(sorted(logs), key=logs.get)
        assert r["lang_pred"] == best and r["score"] == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), abs=1e-2)
        assert r["held_out"] == (brute.fold(r["doc_id"], 3) == 1)


def plain_sentences(raw):
    """(start, end, words) of the sentences of a text, in bytes."""
    out, last = [], None
    for m in re.finditer(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", bytes(c + 32 if 65 <= c <= 90 else c for c in raw)):
        line = sum(raw[: m.start() + 1].count(x) for x in (b".", b"!", b"?", b"\n"))
        if line != last:
            out.append([m.start(), m.end(), []])
        out[-1][1] = m.end()
        out[-1][2].append(m.group())
        last = line
    return out


def test_toxicity_query_equals_plain_noisy_or(spark, data, texts):
    model = toxicity.fit(table(spark, data, "documents"), table(spark, data, "labels"))
    some = [w for r in texts.values() for w in brute.ALNUM.findall(brute.low(r["text"]))]
    some = sorted({w.encode()[:n] for w in some for n in (4, 5, 6, 10**9)})
    data_, offsets = np.frombuffer(b"".join(some), np.uint8), np.append(0, np.cumsum([len(x) for x in some]))
    bucket = dict(zip(some, (toxicity.span_hashes(data_, offsets[:-1], offsets[1:]) & np.uint64(toxicity.BUCKETS - 1)).astype(int).tolist(), strict=True))
    for r in queries.op9_toxicity(spark, data).collect():
        raw = (texts[r["doc_id"]]["text"] or "").encode()
        if len(raw) > 20_000:
            continue
        clean, odds = 1.0, []
        for a, b, words in plain_sentences(raw):
            parts = [w for w in words] + [w[:n] for w in words for n in toxicity.BEGINNINGS if len(w) > n]
            odds.append((a, b, model.bias + sum(float(model.weight[bucket[p]]) for p in parts)))
            clean *= 1 / (1 + math.exp(odds[-1][2]))
        assert r["score"] == pytest.approx(1 - clean, abs=1e-6) and r["held_out"] == (brute.fold(r["doc_id"], 5) == 0)
        if r["predicted"]:
            top = max(o for *_, o in odds)
            assert [(s["start"], s["end"]) for s in r["sentences"]] == [(a, b) for a, b, o in odds if o >= 0 or o == top]
        else:
            assert r["sentences"] == []


# ------------------------------------------------------------------------------------------------------ mix


def plain_seats(votes, seats, most):
    wins = sorted((-v / (2 * i + 1), k) for k, v in votes.items() for i in range(min(most[k], seats)) if v > 0)[:seats]
    n = Counter(k for _, k in wins)
    return {k: n[k] for k in votes}


def plain_mix(spark, df, shard_words, block=8, seed=7):
    rows = [tuple(r) for r in mixing.placed(df.select("doc_id", "source", "text"), F.struct("doc_id", "text"), seed).collect()]
    size = Counter()
    for key, _, n, _ in rows:
        size[key] += n
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(sorted(size))}
    target, left, full = {}, 1.5 * sum(size.values()), set()
    while True:
        level = left / max(sum(weight[k] for k in size if k not in full), 1e-9)
        over = [k for k in size if k not in full and level * weight[k] > 2 * size[k]]
        if not over:
            break
        full |= set(over)
        left -= sum(2 * size[k] for k in over)
    target = {k: 2 * size[k] if k in full else level * weight[k] for k in size}
    block = max(1, min(block, int(min((t for t in target.values() if t > 0), default=8 * block) // block)))
    blocks = plain_seats(target, round(sum(target.values()) / block), {k: -(-2 * size[k] // block) for k in size})
    starts = {(r["k"], r["s"]): r["h"] for r in spark.createDataFrame([(k, s) for k in size for s in range(64)], "k string, s int").select("k", "s", F.xxhash64("k", "s", F.lit(seed)).alias("h")).collect()}
    out = []
    for key in size:
        shards = 2 ** math.ceil(math.log2(max(size[key] / shard_words, 1)))
        inside = defaultdict(list)
        for r in rows:
            if r[0] == key:
                inside[r[1] % shards].append(r)
        n = {s: sum(r[2] for r in x) for s, x in inside.items()}
        most = {s: -(-2 * n[s] // block) for s in n}
        quota = plain_seats(n, sum(most.values()) if target[key] >= 2 * size[key] else blocks[key], most)
        for s, x in inside.items():
            words = min(quota[s] * block, 2 * n[s])
            circle = [i for i, r in enumerate(sorted(x, key=lambda r: (r[1], r[2]))) for _ in range(r[2])]
            taken = Counter({i: words // n[s] * r[2] for i, r in enumerate(sorted(x, key=lambda r: (r[1], r[2])))} if n[s] else {})
            first = starts[key, s] % -(-n[s] // block) * block if n[s] else 0
            taken.update(circle[(first + j) % n[s]] for j in range(words % n[s] if n[s] else 0))
            out += [(r[3]["doc_id"], r[2], size[key], round(target[key], 6), taken[i]) for i, r in enumerate(sorted(x, key=lambda r: (r[1], r[2])))]
    return Counter(out)


@pytest.mark.parametrize("shard_words", [40, 1 << 17])
def test_mix_equals_plain_mix(spark, docs, shard_words):
    tiny = spark.createDataFrame([(i, "a b c", "s") for i in range(200)] + [(7, "w " * (i % 9), "t") for i in range(40)] + [(None, "v " * i, None) for i in range(12)], "doc_id long, text string, source string")
    for df in (tiny, docs.where("doc_id is null or doc_id <> 9").select("doc_id", "text", "source")):
        for part in (df, df.repartition(5, F.rand(3))):
            got = Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.mixed_documents(part, shard_words=shard_words).collect())
            assert got == plain_mix(spark, df, shard_words)


@pytest.mark.parametrize(("n", "words", "sources"), [(200, 3, 1), (100, 10, 2), (1, 3, 1), (5000, 2, 3), (300, 2, 300), (90, 3, 90), (40, 1, 40)])
def test_small_sources_reach_their_targets(spark, n, words, sources):
    df = spark.createDataFrame([(i, "w " * words, f"s{i % sources}") for i in range(n)], "doc_id long, text string, source string")
    every = mixing.mixed_documents(df, shard_words=500).toPandas()
    every = every.join(df.toPandas().set_index("doc_id").source, "doc_id")
    out = every.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("size", "sum"))
    assert (abs(out.taken - out.target) <= (8 if sources < 4 else 1)).all() and (out.taken <= 2 * out["size"]).all() and (out.taken > 0).all()
    assert abs(out.taken.sum() - 1.5 * out["size"].sum()) <= 8


@pytest.mark.parametrize("seed", [1, 2])
def test_capped_apportionment_gives_highest_quotients(spark, seed):
    rng, rows = np.random.default_rng(seed), []
    for g in range(40):
        n = int(rng.integers(1, 9))
        seats = int(rng.integers(0, 120))
        rows += [(g, k, float(v), seats, int(c)) for k, (v, c) in enumerate(zip(rng.exponential(size=n) ** 3 * (rng.random(n) > 0.15), rng.integers(0, 30, n), strict=True))]
    got = {(r["g"], r["k"]): r["quota"] for r in mixing.sainte_lague(spark.createDataFrame(rows, "g int, k int, v double, s long, c long"), ["g"], "k", "v", "s", "c").collect()}
    for g in range(40):
        own = [r for r in rows if r[0] == g]
        assert {r[1]: got[g, r[1]] for r in own} == plain_seats({r[1]: r[2] for r in own}, own[0][3], {r[1]: r[4] for r in own})


# ------------------------------------------------------------------------------------------------- pipeline


def test_pipeline_equals_plain_stages(spark, data, texts):
    """Every stage on a table of its own: kept ids by plain Python, then the mix and the files."""
    docs = table(spark, data, "documents")
    stages = dict(corpus_pipeline.STAGES)
    model = quality.fit(docs, table(spark, data, "labels"))
    score = dict(zip(texts, model.scores(pa.array([r["text"] for r in texts.values()], pa.string())), strict=True))
    good = {i for i, s in score.items() if s >= 0.5}
    out = stages["quality"](spark, docs, data)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(good)

    ids = sorted(good)
    words = {i: brute.SPACED.findall(brute.low(texts[i]["text"])) for i in ids}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set() for i, w in words.items()}
    part = brute.components(ids, lambda i, j: 5 * len(sets[ids[i]] & sets[ids[j]]) >= 4 * len(sets[ids[i]] | sets[ids[j]]))
    single = sorted(set(part))
    out = stages["near_duplicates"](spark, out, data)
    assert sorted(r["doc_id"] for r in out.collect()) == single

    items = [("" if r["item_id"] is None else str(r["item_id"]), r["text"]) for r in table(spark, data, "benchmark").collect()]
    clean = [i for i, found in zip(single, brute.contamination([texts[i]["text"] for i in single], items), strict=True) if found[1] == 0]
    out = stages["decontamination"](spark, out, data)
    assert sorted(r["doc_id"] for r in out.collect()) == clean

    taken = {r["row"]["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(mixing.placed(out, F.struct(*out.columns), 7)).collect()}
    copies = Counter({i: math.floor(t / n + 0.5) for i, (t, n) in taken.items() if n})
    mixed = stages["mixing"](spark, out, data)
    assert Counter(r["doc_id"] for r in mixed.collect()) == +copies

    from docquarry.llm import tokens

    use, start = tokens.encoder(queries.vocabulary()).tokenizer, 0
    for r in sorted(stages["token_ids"](spark, mixed, data).collect(), key=lambda r: r["start"]):
        found = [*use.encode(texts[r["doc_id"]]["text"] or "", add_special_tokens=False).ids, 1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(found), zlib.crc32(np.array(found, "<u4").tobytes()))
        start += len(found)
    assert Counter(r["doc_id"] for r in stages["token_ids"](spark, mixed, data).collect()) == +copies
