"""Near copies and wider distances against brute force."""

import numpy as np
import pytest

import brute
import corpus_pipeline
from docquarry.llm import common, nearcopies, neardup


def shingles(text):
    w = brute.SPACED.findall(brute.low(text))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


@pytest.fixture(scope="module")
def copies():
    rng, out = np.random.default_rng(5), []
    line = [f"common{k}" for k in range(12)]
    for _ in range(14):
        base = [f"w{x}" for x in rng.integers(0, 5000, rng.choice([3, 8, 40, 150, 600]))]
        for _ in range(9):
            w = list(base)
            for _ in range(rng.integers(0, max(2, len(w) // 30))):
                w[rng.integers(0, len(w))] = f"x{rng.integers(0, 10**6)}"
            out.append(" ".join(w + (line if rng.random() < 0.5 else [])))
    return [*out, None, "", " \t", out[0].upper()]


@pytest.mark.parametrize(("hot", "block", "often"), [(8, 512, 0.002), (2, 8, 0.0005)])
def test_stage_matches_brute_force(spark, copies, hot, block, often, monkeypatch):
    monkeypatch.setattr(nearcopies, "HOT", hot)
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    monkeypatch.setattr(nearcopies, "OFTEN", often)
    sets = [shingles(t) for t in copies]
    ids = list(range(100, 100 + len(sets)))
    part = brute.components(ids, lambda i, j: similar(sets[i], sets[j]))
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in zip(ids, copies, strict=True)], "doc_id long, text string, lang string, source string, n_chars int")
    got = dict(map(tuple, nearcopies.groups(df).collect()))
    assert [got[i] for i in ids] == part
    kept = corpus_pipeline.drop_near_copies(spark, df, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(part))


@pytest.mark.parametrize("distance", [3, 5])
def test_wider_distances_are_complete(spark, distance):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 1 << 62, 12)]
    prints = sorted({b ^ sum(1 << int(k) for k in rng.choice(62, rng.integers(0, 7), replace=False)) for b in base for _ in range(20)})
    df = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "__fp long, __rep long")
    part = brute.components(list(range(len(prints))), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= distance)
    got = dict(map(tuple, common.connected_components(neardup.links(df, distance)).collect()))
    assert [got.get(i, i) for i in range(len(prints))] == part


@pytest.mark.parametrize("task", [4, 50, 1 << 18])
def test_components_of_chains_hubs_and_repeats(spark, task, monkeypatch):
    monkeypatch.setattr(common, "TASK_EDGES", task)
    rng = np.random.default_rng(9)
    names = [int(x) for x in rng.permutation(400)]
    edges = [(names[i], names[i + 1]) for i in range(60)] + [(names[70], names[i]) for i in range(71, 200)] + [(names[i], names[j]) for i, j in rng.integers(200, 400, (90, 2))]
    edges = [edges[i] for i in rng.permutation(len(edges))] + edges[:20] + [(5, 5), (None, 3)]
    linked = {frozenset(e) for e in edges if None not in e}
    nodes = sorted({x for e in linked if len(e) > 1 for x in e})
    part = brute.components(nodes, lambda i, j: frozenset((nodes[i], nodes[j])) in linked)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    assert dict(map(tuple, common.connected_components(df).collect())) == dict(zip(nodes, part, strict=True))
    assert common.connected_components(df.where("1 = 0")).count() == 0
