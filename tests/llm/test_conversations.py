"""Repaired conversations equal those of trying every sequence of edits, and of a plain search over texts."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from docquarry.llm import conversations as C
from docquarry.llm.queries import ORACLE_SQL, op13_conversation_repair

ROLES = re.compile("(s?(ua)+)?")
BLANK = " \t\n\x0b\x0c\r"


def every_way(rows):
    """(cost, audit, lines) by trying everything: ``rows`` are (role, text, what)."""
    best = None
    gaps = ["", "u", "a", "ua", "au", "uu", "aa"]
    ways = [[("D", 4, None)] + ([("K", 3 * (w == "cut"), r), ("R", 3 + 3 * (w == "cut"), "user"), ("R", 3 + 3 * (w == "cut"), "assistant")] if w in ("", "cut") else []) for r, _, w in rows]
    for own in itertools.product(*ways):
        for put in itertools.product(gaps, repeat=len(rows) + 1):
            said, cost, audit, lines = "", 0, "", []
            for k, inserts in enumerate(put):
                for x in inserts:
                    said, cost, audit = said + x, cost + 3, audit + "I"
                    lines.append({"u": "user:", "a": "assistant:"}[x])
                if k < len(rows):
                    letter, c, role = own[k]
                    cost, audit = cost + c, audit + letter
                    if role is not None:
                        said += role[:1] or " "
                        lines.append(f"{role}:{rows[k][1]}")
            if ROLES.fullmatch(said) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, lines
    return best


def plain(rows):
    """(cost, audit, lines), row by row: the cheapest, then first text of edits to each state."""
    then = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    states = {"": (0, "", ())}
    for role, text, what in rows:
        new = {}
        for q, (cost, audit, lines) in states.items():
            for _ in range(3):
                found = [(q, cost + 4, audit + "D", lines)]
                if what in ("", "cut"):
                    more = 3 * (what == "cut")
                    if role[:1] == then[q] or (role[:1] == "s" and q == ""):
                        found.append((role[0], cost + more, audit + "K", (*lines, f"{role}:{text}")))
                    found.append((then[q], cost + 3 + more, audit + "R", (*lines, f"{name[then[q]]}:{text}")))
                for to, *way in found:
                    if to not in new or tuple(way[:2]) < new[to][:2]:
                        new[to] = tuple(way)
                q, cost, audit, lines = then[q], cost + 3, audit + "I", (*lines, name[then[q]] + ":")
        states = new
    ends = []
    for q, (cost, audit, lines) in states.items():
        more = {"": "", "a": "", "u": "I", "s": "II"}[q]
        ends.append((cost + 3 * len(more), audit + more, lines + {"": (), "I": ("assistant:",), "II": ("user:", "assistant:")}[more]))
    return min(ends)


def damaged(given):
    out = []
    for c, t, r, x in given:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
            out += [(c, t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    return out


def order(c, r, x):
    return hashlib.md5(("-" if c is None else f"{len(str(c))}:{c}").encode() + f"{len(r)}:{r}{len(x)}:{x}".encode()).digest()


def reported(given, damage=True):
    """The rows of ``report`` in plain Python."""
    rows, out = damaged(given) if damage else given, []
    for c in {g[0] for g in given}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, order(c, r[2], r[3])))
        seen, judged = set(), []
        for _, _, r, x in own:
            bare = x.strip(BLANK)
            judged.append((r, x, "blank" if not bare else "again" if (r, x) in seen else "" if bare[-1] in ".!?" else "cut"))
            seen.add((r, x))
        turns = [t for _, t, *_ in own if t is not None]
        cost, audit, lines = plain(judged)
        initials = [r[:1] or " " for r, *_ in judged]
        counts = [sum(w == k for *_, w in judged) for k in ("blank", "again", "cut")]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_integers_are_the_least_of_all_edits():
    roles = ["system", "user", "assistant", "", "tool", "sysop", "u"]
    rng = random.Random(2)
    codes = {"": 0, "cut": 1, "blank": 2, "again": 2}
    kinds = {"s": C.SYSTEM, "u": C.USER, "a": C.ASSISTANT}
    for n in range(4):
        for _ in range(25 if n == 3 else 60):
            rows = [(rng.choice(roles), f"t{k}", rng.choice(["", "", "cut", "blank"])) for k in range(n)]
            code = bytes(kinds.get(r[:1], C.OTHER) + 4 * codes[w] for r, _, w in rows)
            cost, audit, lines = every_way(rows)
            assert C.whole(code) == (cost, audit) == plain(rows)[:2]
            given = [f"{role or rows[k][0]}:{rows[k][1]}" if k is not None else f"{role}:" for k, role in C.edits(code, C.OTHER, audit)]
            assert given == lines == list(plain(rows)[2])


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_chunks_give_the_path_of_the_whole(size):
    rng = random.Random(size)
    for n in range(1, 40):
        code = bytes(rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]) for _ in range(n))
        parts = [code[k : k + size] for k in range(0, n, size)]
        steps = C.route([C.between(p) for p in parts])
        assert all(a[1] == b[0] for a, b in itertools.pairwise(steps)) and steps[0][0] == C.OTHER
        weights = [C.least(p, a)[b] for p, (a, b) in zip(parts, steps, strict=True)]
        audit = "".join(C.letters_of(w, len(p)) for w, p in zip(weights, parts, strict=True)) + C.CLOSING[steps[-1][1]]
        cost = sum(w >> C.FIELD * len(p) for w, p in zip(weights, parts, strict=True)) + 3 * len(C.CLOSING[steps[-1][1]])
        assert (cost, audit) == C.whole(code)


def made(rng, conversations, turns):
    roles = ["system", "user", "assistant", "user", "assistant", None, "", "tool", "User"]
    texts = ["Yes.", "No", "What is it?", "", " \t\n", None, "ok!", "é.\x0b", "a.\n\n", "word " * 30, "x ", "."]
    return [(rng.choice([*range(conversations), None]), rng.choice([*range(turns), None, -3]), rng.choice(roles), rng.choice(texts)) for _ in range(conversations * turns)]


@pytest.mark.parametrize("chunk", [2, 256])
def test_equals_the_plain_repair(spark, chunk):
    given = made(random.Random(4), 30, 9)
    given += [(77, t, ("user", "assistant", "user")[t % 3], f"turn {t // 2}" + "." * (t % 5 > 0)) for t in range(400)] + [(78, 5, "user", "The same.")] * 300
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string").repartition(5)
    assert collected(C.report(df, chunk)) == reported(given)
    own = spark.createDataFrame([(c, t, r or " ", x or " ") for c, t, r, x in given], df.schema)
    chunks, rows = C.repair(own, chunk)
    assert chunks.groupBy().sum("cost").first()[0] == sum(r[6] for r in reported([(c, t, r or " ", x or " ") for c, t, r, x in given], damage=False))
    by: dict = {}
    for r in sorted(rows.collect(), key=lambda r: (str(r.conv_id), r.uid, r.place)):
        by.setdefault(r.conv_id, []).append(r.role[0])
    assert all(ROLES.fullmatch("".join(x)) for x in by.values())


def test_cases(spark):
    schema = "conv_id string, turn int, role string, text string, uid int, place int, row string, cost int"
    assert C.report(spark.createDataFrame([], schema)).collect() == []
    # a conversation whose only row is dropped: crc32("c10:0") and others are found by trying
    gone = next(k for k in range(1000) if zlib.crc32(f"c{k}:0".encode()) % 20 == 0)
    given = [(f"c{gone}", 0, "user", "Hi."), ("b", None, "assistant", "Alone."), (None, None, None, None), (" ", 1, "user", "x" * 200_000)]
    df = spark.createDataFrame([(*g, 1, 2, "r", 3) for g in given], schema)
    found = collected(C.report(df))
    assert found == reported(given)
    assert (f"c{gone}", 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) in found
    far = spark.createDataFrame([("z", -(1 << 63), "user", "A."), ("z", (1 << 63) - 1, "user", "B.")], "conv_id string, turn long, role string, text string")
    assert C.report(far).first().gaps is None


def test_sql_says_the_same_of_odd_rows(spark):
    given = [(c, t, r, x) for c, t, r, x in made(random.Random(9), 12, 7) if r != ""]
    duck = duckdb.connect()
    duck.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    duck.executemany("insert into conversations values (?, ?, ?, ?)", given)
    want = sorted(duck.sql(ORACLE_SQL["op13_conversation_repair"]).fetchall(), key=str)
    assert want == reported(given) == collected(C.report(spark.createDataFrame(given, "conv_id long, turn long, role string, text string")))


def test_query(spark, data):
    given = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(op13_conversation_repair(spark, data)) == reported(given)
