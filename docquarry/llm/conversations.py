"""Conversations whose rows are dropped, blank, repeated, cut off or out of turn, repaired at least cost.

The roles of a repaired conversation read ``(s?(ua)+)?`` by their initials. Edits go through the rows in order:
keep a row (cost 0), give it the role user or assistant (3), delete it (4; a must for blank and repeated rows),
or insert an empty row of user or assistant (3); a row that is cut off and not deleted costs 3 more. Of the
cheapest edits those whose initials (D, I, K, R) come first are taken.

A conversation is a DAG of (row, state of the roles). Every edge is one whole number: its cost in the high
digits and, in the place of its row among the low digits, the letters of that row's edits, each row as wide as
the next and filled up with zeros at the end. A least path under ordinary integer addition and comparison is
then the cheapest and first one, and its low digits are the audit. (What stands between two rows ends with
the letter of a row, so that no row's letters begin another choice for it; the fill never decides.)

Rows are dealt over tasks by range of (conversation, turn), so that a conversation of any length spreads. A task cuts
it into chunks of at most ``CHUNK`` rows and solves each from every state to every state; a pass over the chunks
(not the rows) of a conversation that has more than one, or touches the border of a task, picks the states between them
with the same integers, their low digits now the rank of what lies before. Repeats are found by an aggregation on
(conversation, role, text). Only the hash of a whole conversation's text reads that in one place, as a stream.

Defined cases: a null conv_id is a conversation; null role and text are one space; turns are whole numbers, null first;
rows of one turn are in the order of a digest of role and text, equal ones adjacent, each a row. The initial of an empty role is a space.
A conversation without rows has zeros, an empty audit and the hash of the empty text. An empty table gives no rows; a gap beyond
a long is null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import materialize

#: Rows to a chunk at most; bits of a letter, letters of a row at most.
CHUNK, BITS, LETTERS = 256, 3, 3
FIELD = BITS * LETTERS
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTER = {v: k for k, v in DIGIT.items()}
RETITLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: Classes of roles by initial, and what may follow what.
OTHER, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: What a row is: sound, cut off, or to be deleted as blank or repeated. Its code: class + 4 * (0, 1, 2, 2).
SOUND, TRUNCATED, BLANK, REPEATED = range(4)
#: States are the class of the last role (OTHER: none yet). The role that may be inserted or given next.
NEXT = {OTHER: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Inserts that end a conversation from a state.
CLOSING = {OTHER: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
NAME = {USER: "user", ASSISTANT: "assistant"}


# -------------------------------------------------------------------------------------- least paths


def field(letters: str) -> int:
    """Letters as digits of a row, zeros after them."""
    return sum(DIGIT[x] << BITS * (LETTERS - 1 - k) for k, x in enumerate(letters))


def _options(state: int, code: int) -> list[tuple[int, int, int]]:
    """(state after, cost, field) of each way to pass a row: at most two inserts (two more come back to
    where they began), then its own edit."""
    found, role, what = [], code % 4, code // 4
    for inserts in range(LETTERS):
        cost, letters, more = INSERT * inserts, "I" * inserts, CUT_OFF * (what == 1)
        found.append((state, cost + DELETE, field(letters + "D")))
        if what < 2:
            if role == NEXT[state] or (role == SYSTEM and state == OTHER):
                found.append((role, cost + more, field(letters + "K")))
            found.append((NEXT[state], cost + RETITLE + more, field(letters + "R")))
        state = NEXT[state]
    return found


OPTIONS = [[_options(q, c) for c in range(12)] for q in range(4)]


def least(codes: bytes, state: int) -> list[int | None]:
    """The least weight from ``state`` over the rows to each state: cost above ``FIELD`` bits a row."""
    width, reach = FIELD * len(codes), [None] * 4
    reach[state] = 0
    for k, code in enumerate(codes):
        place, new = FIELD * (len(codes) - 1 - k), [None] * 4
        for q in range(4):
            if reach[q] is not None:
                for to, cost, letters in OPTIONS[q][code]:
                    weight = reach[q] + (cost << width) + (letters << place)
                    if new[to] is None or weight < new[to]:
                        new[to] = weight
        reach = new
    return reach


def letters_of(weight: int, rows: int) -> str:
    """The letters in the low digits of a weight."""
    digits = ((weight >> BITS * k) & 7 for k in range(LETTERS * rows - 1, -1, -1))
    return "".join(LETTER[d] for d in digits if d)


@lru_cache(1 << 16)
def whole(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of a conversation."""
    width, rows = FIELD * (len(codes) + 1), len(codes) + 1
    ends = ((w << FIELD) + (INSERT * len(CLOSING[q]) << width) + field(CLOSING[q]) for q, w in enumerate(least(codes, OTHER)) if w is not None)
    best = min(ends)
    return best >> width, letters_of(best, rows)


@lru_cache(1 << 12)
def between(codes: bytes) -> tuple[list[list[int | None]], list[list[int]]]:
    """Costs of a chunk from each state to each, and the ranks of its letters among those from one state."""
    width = FIELD * len(codes)
    weights = [least(codes, q) for q in range(4)]
    low = [[None if w is None else w & ((1 << width) - 1) for w in row] for row in weights]
    ranks = [[0 if w is None else sum(x is not None and x < w for x in row) for w in row] for row in low]
    return [[None if w is None else w >> width for w in row] for row in weights], ranks


def route(chunks: list[tuple[list[list[int | None]], list[list[int]]]]) -> list[tuple[int, int]]:
    """(state before, state after) of each chunk of a conversation on its least path."""
    cost, rank, back = {OTHER: 0}, {OTHER: 0}, []
    for costs, ranks in chunks:
        came, new = {}, {}
        for to in range(4):
            ways = [((cost[q] + costs[q][to]) * 4 + rank[q], q) for q in cost if costs[q][to] is not None]
            if ways:
                best, came[to] = min(ways)
                new[to] = best // 4
        order = sorted(new, key=lambda to: (rank[came[to]], ranks[came[to]][to]))
        back.append(came)
        cost, rank = new, {to: k for k, to in enumerate(order)}
    at = min(cost, key=lambda q: (cost[q] + INSERT * len(CLOSING[q])) * 4 + rank[q])
    out = []
    for came in reversed(back):
        out.append((came[at], at))
        at = came[at]
    return out[::-1]


def edits(codes: bytes, state: int, audit: str) -> Iterator[tuple[int | None, str | None]]:
    """(row or none for an insert, new role or none) of what stands after the edits."""
    row = 0
    for x in audit:
        if x == "I":
            state = NEXT[state]
            yield None, NAME[state]
            continue
        if x == "K":
            state = codes[row] % 4
            yield row, None
        elif x == "R":
            state = NEXT[state]
            yield row, NAME[state]
        row += 1


# ---------------------------------------------------------------------------------------- in Spark


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that the CRC of ``conv_id:turn`` says."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("__fault")).where("__fault <> 0")
    fault = F.col("__fault")
    text = F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))))
    return rows.drop("col")


def digest(*parts: Column) -> Column:
    """128 bits of texts that may be null."""
    return F.unhex(F.md5(F.concat_ws("", *(F.coalesce(F.concat(F.char_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts)).cast("binary")))


def keyed(rows: DataFrame) -> DataFrame:
    """The rows with ``row``, a digest of all of it, and ``same``, one of what makes it a repeat."""
    conv, role, text = F.col("conv_id").cast("string"), F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.withColumns({"same": digest(conv, F.col("role"), F.col("text")), "row": digest(conv, F.col("turn").cast("string"), F.col("role"), F.col("text"))})


def outlined(rows: DataFrame) -> DataFrame:
    """Each distinct row without its text: how many it stands for, class of its role, what it is."""
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    bare = F.expr(r"trim(TRAILING ' \t\n\u000B\f\r' FROM text)")
    what = F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    slim = rows.groupBy("row", "same", "conv_id", "turn", kind.cast("int").alias("kind"), what.cast("int").alias("what")).agg(F.count("*").alias("copies"))
    first = slim.groupBy("same").agg(F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("before"))
    late = F.when(F.col("before"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first"))
    return slim.join(first, "same").select("conv_id", "turn", "same", "row", "kind", "what", "copies", F.coalesce(late, F.lit(False)).alias("late"))


CHUNKS = "uid long, conv_id {}, alone boolean, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first int, last int, codes binary, rows array<binary>, costs array<int>, ranks array<int>"


def chunked(slim: DataFrame, size: int = CHUNK) -> DataFrame:
    """The rows of ``outlined`` in chunks of one conversation each, whose ``uid`` ascends in the order of rows."""
    kind = slim.schema["conv_id"].dataType.simpleString()
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, number, own, ready = TaskContext.get().partitionId() << 32, 0, None, []
        held: list[tuple] = []
        conv, runs, cuts = None, 0, 0

        def close(last: bool, ended: bool) -> None:
            """Put what is held of the conversation into a chunk."""
            nonlocal held, number, cuts
            what = [x[2] for x in held]
            turns = [x[0] for x in held if x[0] is not None]
            kinds = [x[1] for x in held]
            codes = bytes(k + 4 * min(w, 2) for k, w in zip(kinds, what, strict=True))
            alone = ended and runs > 1 and not cuts and not last
            costs, ranks = between(codes) if not alone else ([], [])
            ready.append((
                base + number, conv, alone, turns[0] if turns else None, turns[-1] if turns else None, sum(a != b for a, b in pairwise(turns)) + bool(turns), what.count(BLANK), what.count(REPEATED), what.count(TRUNCATED), sum(p not in LEGAL for p in pairwise(kinds)),
                kinds[0], kinds[-1], codes, [x[3] for x in held if x[2] < BLANK], [-1 if c is None else c for r in costs for c in r], [r for row in ranks for r in row],
            ))
            held, number, cuts = [], number + 1, cuts + 1

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), own, pa.bool_(), *[pa.int64()] * 7, pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            columns = [pa.array([r[k] for r in ready], t) for k, t in enumerate(kinds)]
            ready.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            own = batch.schema.field("conv_id").type
            for c, turn, _, row, role, what, copies, late in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not runs or c != conv:
                    if held:
                        close(False, True)
                    conv, runs, cuts = c, runs + 1, 0
                for k in range(copies):
                    if len(held) == size:
                        close(False, False)
                        if len(ready) >= 1000:
                            yield out()
                    held.append((turn, role, REPEATED if what != BLANK and (late or k) else what, row))
            if len(ready) >= 1000:
                yield out()
        if held:
            close(True, True)
        if ready:
            yield out()

    order = ["conv_id", "turn", "same", "row"]
    return materialize(slim.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(scan, CHUNKS.format(kind)), "chunks")


def routed(chunks: DataFrame) -> DataFrame:
    """(uid, start, stop, closing, illegal and turns to correct) of the chunks that do not stand alone."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def out() -> pa.RecordBatch:
            steps = route([([[None if c < 0 else c for c in r["costs"][4 * q : 4 * q + 4]] for q in range(4)], [r["ranks"][4 * q : 4 * q + 4] for q in range(4)]) for r in held])
            illegal = [0] + [int((a["last"], b["first"]) not in LEGAL) for a, b in pairwise(held)]
            seen, again = None, []
            for r in held:
                again.append(int(seen is not None and r["low"] == seen))
                seen = r["high"] if r["high"] is not None else seen
            columns = [[r["uid"] for r in held], [a for a, _ in steps], [b for _, b in steps], [""] * (len(held) - 1) + [CLOSING[steps[-1][1]]], illegal, again]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()], strict=True)], ["uid", "start", "stop", "closing", "between", "again"])

        for batch in batches:
            for r in batch.to_pylist():
                if held and r["conv_id"] != held[0]["conv_id"]:
                    yield out()
                    held = []
                held.append(r)
        if held:
            yield out()

    rows = chunks.where("not alone").select("conv_id", "uid", "low", "high", "first", "last", "costs", "ranks")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "uid").mapInArrow(scan, "uid long, start int, stop int, closing string, between int, again int")


def solved(chunks: DataFrame) -> DataFrame:
    """Counts, cost, audit and ``after`` (rows and inserts that stand, with new roles) of each chunk."""
    kind = chunks.schema["conv_id"].dataType.simpleString()
    kept = ["uid", "conv_id", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal"]
    rest = ["codes", "rows", "start", "stop", "closing"]
    alone = chunks.where("alone").select(*kept, "codes", "rows", F.lit(0).alias("start"), F.lit(-1).alias("stop"), F.lit("").alias("closing"))
    linked = chunks.where("not alone").join(routed(chunks), "uid").withColumns({"turns": F.expr("turns - again"), "illegal": F.expr("illegal + between")})
    own = pa.list_(pa.struct([("row", pa.binary()), ("role", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, audits, after = [], [], []
            for codes, rows, start, stop, closing in zip(*(batch.column(c).to_pylist() for c in rest), strict=True):
                if stop < 0:
                    cost, audit = whole(codes)
                else:
                    weight = least(codes, start)[stop]
                    cost, audit = (weight >> FIELD * len(codes)) + INSERT * len(closing), letters_of(weight, len(codes)) + closing
                place = np.cumsum([c < 8 for c in codes]) - 1
                costs.append(cost)
                audits.append(audit)
                after.append([{"row": None if k is None else rows[place[k]], "role": role} for k, role in edits(codes, start, audit)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(after, own)], [*kept, "cost", "audit", "after"])

    both = alone.unionByName(linked.select(*kept, *rest))
    return materialize(both.mapInArrow(scan, f"uid long, conv_id {kind}, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, after array<struct<row: binary, role: string>>"), "solved")


def repaired_rows(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """(conv_id, uid, place, role, text) of the repaired conversations, in the order of uid and place."""
    after = chunks.select("conv_id", "uid", F.posexplode("after").alias("place", "x")).select("conv_id", "uid", "place", F.col("x.row").alias("row"), F.col("x.role").alias("given"))
    texts = rows.groupBy("row").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    kept = after.where("row is not null").join(texts, "row").select("conv_id", "uid", "place", F.coalesce("given", "role").alias("role"), "text")
    return kept.unionAll(after.where("row is null").select("conv_id", "uid", "place", "given", F.lit("")))


def hashes(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): ``role:text`` lines of a conversation, read as a stream."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, own, done = None, None, pa.null(), []

        def out() -> pa.RecordBatch:
            columns = [pa.array([c for c, _ in done], own), pa.array([s for _, s in done], pa.string())]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "repaired_sha256"])

        for batch in batches:
            own = batch.schema.field("conv_id").type
            for c, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").cast(pa.binary()).to_pylist(), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256(line)
                else:
                    state.update(b"\n" + line)
            if done:
                yield out()
        if state is not None:
            done.append((conv, state.hexdigest()))
            yield out()

    lines = repaired.select("conv_id", "uid", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "uid", "place").select("conv_id", "line")
    return lines.mapInArrow(scan, f"conv_id {kind}, repaired_sha256 string")


def repair(rows: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Of conversations (conv_id, turn, role, text): a row for each chunk with counts, cost and audit, and the repaired rows."""
    rows = keyed(rows)
    chunks = solved(chunked(outlined(rows), chunk))
    return chunks, repaired_rows(rows, chunks)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def report(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation,
    after the damage of ``damaged``."""
    chunks, repaired = repair(damaged(conversations), chunk)
    pieces = F.sort_array(F.collect_list(F.struct("uid", "audit")))
    found = chunks.groupBy("conv_id").agg(
        F.expr("try_add(try_subtract(max(high), min(low)), 1 - sum(turns))").alias("gaps"), F.max("high").isNull().alias("__none"), *(F.sum(c).alias(c) for c in COUNTS[1:]), F.array_join(F.transform(pieces, lambda x: x["audit"]), "").alias("audit"),
    )
    found = found.withColumn("gaps", F.when(F.col("__none"), 0).otherwise(F.col("gaps"))).drop("__none")
    zero, text = F.lit(0).cast("long"), F.lit(None).cast("string")
    every = conversations.select("conv_id").distinct().select("conv_id", *(zero.alias(c) for c in COUNTS), F.lit("").alias("audit"), text.alias("repaired_sha256"))
    hashed = hashes(repaired).select("conv_id", *(zero.alias(c) for c in COUNTS), F.lit("").alias("audit"), "repaired_sha256")
    parts = every.unionByName(found.withColumn("repaired_sha256", text)).unionByName(hashed)
    empty = hashlib.sha256().hexdigest()
    gaps = F.when(F.max(F.col("gaps").isNull()), None).otherwise(F.sum("gaps")).alias("gaps")
    return parts.groupBy("conv_id").agg(gaps, *(F.sum(c).alias(c) for c in COUNTS[1:]), F.max("audit").alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(empty)).alias("repaired_sha256"))
