"""The registered query of each operator, over the whole of its table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import contexttree, conversations, decontaminate, embeddings, language, mixing, neardup, pieces, quality, substrings, tokens, toxicity, whitening
from docquarry.llm.common import table


def op1_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.without_repeats(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return out.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexttree.scores(table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    """Where the word vocabulary of the token-ID queries lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenized(table(spark, sf_dir, "documents"), vocabulary())


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "items")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def piece_model() -> str:
    """Where the piece model of the encoding query lies."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encoded(table(spark, sf_dir, "documents"), piece_model())
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_quality_compression, op2_language, op3_embedding_near_dedup, op4_substring_dedup, op5_context_tree, op6_token_ids, op7_source_mix, op8_decontaminate, op9_toxicity, op10_simhash, op11_sentencepiece, op12_whitening, op13_conversation_repair)}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"



def _repair_sql() -> str:
    """The repair as a recursion over rows: a list of what is cheapest so far in each state (0 nothing yet, or 1 s,
    2 u, 3 a), its edits and its text; NULL where a state can't be reached."""
    then, name = {0: 2, 1: 2, 2: 3, 3: 2}, {2: "user", 3: "assistant"}
    ways: dict[int, list[str]] = {q: [] for q in range(4)}
    for start in range(4):
        q, edits, text, cost = start, "", "", 0
        for _ in range(3):
            said = f"c: st[{start + 1}].c + {cost}", f"a: st[{start + 1}].a || '{edits}", f"t: st[{start + 1}].t || '{text}'"
            ways[q].append(f"case when st[{start + 1}] is not null then {{{said[0]} + 4, {said[1]}D', {said[2]}}} end")
            for role in [1, 2] if q == 0 else [then[q]]:
                ways[role].append(f"case when st[{start + 1}] is not null and what < 2 and kind = {role} then {{{said[0]} + 3 * what, {said[1]}K', {said[2]} || role || ':' || text || chr(10)}} end")
            ways[then[q]].append(f"case when st[{start + 1}] is not null and what < 2 then {{{said[0]} + 3 + 3 * what, {said[1]}R', {said[2]} || '{name[then[q]]}:' || text || chr(10)}} end")
            q, edits, text, cost = then[q], edits + "I", text + name[then[q]] + ":\n", cost + 3
    step = ", ".join(f"list_min([{', '.join(ways[q])}])" for q in range(4))
    ends = ", ".join(f"case when st[{q + 1}] is not null then {{c: st[{q + 1}].c + {3 * len(x)}, a: st[{q + 1}].a || '{x}', t: st[{q + 1}].t || '{t}'}} end" for q, x, t in ((0, "", ""), (1, "II", "user:\nassistant:\n"), (2, "I", "assistant:\n"), (3, "", "")))
    return rf"""
with recursive given as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') k from conversations),
crc as (select *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: cast(ascii(x) as bigint))),
  lambda h, b: list_reduce(list_prepend(xor(h, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384) + z)), 4294967295) % 20 fault from given),
hurt as (select conv_id, turn, case when fault = 4 then 'user' else role end role, case fault when 1 then '' when 2 then translate(text, '.!?', '') else text end text, unnest(range(case when fault = 3 then 2 else 1 end)) copy from crc where fault <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, md5(coalesce(length(cast(conv_id as varchar)) || ':' || conv_id, '-') || length(role) || ':' || role || length(text) || ':' || text)) i from hurt),
known as (select *, row_number() over (partition by conv_id, role, text order by i) nth,
  case left(role, 1) when 's' then 1 when 'u' then 2 when 'a' then 3 else 0 end kind, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) bare from placed),
rows_ as (select *, case when bare = '' then 2 when nth > 1 then 3 when right(bare, 1) in ('.', '!', '?') then 0 else 1 end what, lag(kind) over (partition by conv_id order by i) kind0 from known),
walk as (select distinct conv_id, cast(0 as bigint) i, [{{c: 0, a: '', t: ''}}, null, null, null] st from rows_
  union all select w.conv_id, r.i, [{step}] from walk w join rows_ r on r.conv_id is not distinct from w.conv_id and r.i = w.i + 1),
ends as (select conv_id, list_min([{ends}]) e from (select *, max(i) over (partition by conv_id) n from walk) where i = n),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (what = 2) blank, count(*) filter (what = 3) duplicate, count(*) filter (what = 1) truncated, count(*) filter (kind0 is not null and kind0 * 4 + kind not in (6, 11, 14)) illegal from rows_ group by 1)
select o.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, cast(coalesce(e.c, 0) as bigint) cost, coalesce(e.a, '') audit, sha256(left(coalesce(e.t, ''), greatest(length(coalesce(e.t, '')) - 1, 0))) repaired_sha256
from (select distinct conv_id from conversations) o left join counts c on c.conv_id is not distinct from o.conv_id left join ends on ends.conv_id is not distinct from o.conv_id"""


#: SQL for what SQL can say; the others are tested against brute force, round trips or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op3_embedding_near_dedup": """
with recursive v as (select row_number() over () r, vec_id, label, list_transform(embedding, lambda x: cast(x as double)) e from embeddings),
good as (select * from v where label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select a.r x, b.r y from good a join good b on a.label = b.label and a.r <> b.r and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (select r x, r y from v union select reach.x, links.y from reach join links on reach.y = links.x)
select v.vec_id, coalesce(n, 0) n_links, c component_id, v.vec_id = c kept from v
left join (select x, count(*) n from links group by 1) on x = v.r join (select reach.x r, min(o.vec_id) c from reach join v o on o.r = reach.y group by 1) m on m.r = v.r""",
    "op4_substring_dedup": r"""
with d as (select row_number() over () r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) w from documents),
g as (select r, s, md5(array_to_string(w[s + 1:s + 35], ' ')) h from (select r, w, unnest(range(len(w) - 34)) s from d where len(w) >= 35)),
again as (select h from g group by 1 having count(*) > 1),
gone as (select distinct r, p from (select r, unnest(range(s, s + 35)) p from g join again using (h))),
words as (select r, unnest(range(len(w))) p, unnest(w) x from d),
kept as (select r, string_agg(x, ' ' order by p) t from words anti join gone using (r, p) group by 1)
select doc_id, len(w) n_words, coalesce(n, 0) n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join (select r, count(*) n from gone group by 1) using (r) left join kept using (r)""",
    "op8_decontaminate": f"""
with d as (select row_number() over () r, doc_id, coalesce(regexp_extract_all({_LOWER}, '{_ALNUM}'), []) w from documents),
i as (select distinct cast(item_id as varchar) item_id, w, least(10, len(w)) k from (select item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') w from benchmark) where len(w) > 0),
iw as (select distinct item_id, k, array_to_string(w[s + 1:s + k], ' ') g from (select item_id, w, k, unnest(range(len(w) - k + 1)) s from i)),
dw as (select r, k, s, array_to_string(w[s + 1:s + k], ' ') g from (select r, w, k, unnest(range(len(w) - k + 1)) s from d join (select distinct k from iw) on len(w) >= k)),
hits as (select r, s, dw.k, item_id from dw join iw using (k, g)),
n as (select r, count(distinct p) n from (select r, unnest(range(s, s + k)) p from hits) group by 1),
m as (select r, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct r, item_id from hits) group by 1)
select doc_id, len(w) n_words, coalesce(n, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n, 0) > 0 contaminated from d left join n using (r) left join m using (r)""",
}
ORACLE_SQL["op13_conversation_repair"] = _repair_sql()
