"""Registered queries of this subpackage, each over whole tables, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, linededup, lshforest, maxent, tokenfile, toolcalls, topk, toxicity, unigram, warc
from .workspace import Workspace


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.revisit_report(_table(spark, sf_dir, "pages"), least=1000)


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.call_report(_table(spark, sf_dir, "conversations"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfile.write_tokens(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), 2, Workspace(spark, "tokens"))
    return tokenfile.read_tokens(manifest)


def op6_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.lm_scores(_table(spark, sf_dir, "documents"))


def op7_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.piece_report(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(_table(spark, sf_dir, "documents"), percent=80)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lshforest.near_groups(_table(spark, sf_dir, "documents"), k=2, percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_topk, op2_warc, op3_tool_calls, op4_decontamination, op5_token_files, op6_maxent, op7_unigram, op8_line_dedup, op9_toxicity, op10_lsh_forest)}

_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_topk": """
with v as (
    select vec_id, min(list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint))) as e
    from embeddings
    where vec_id is not null and embedding is not null
      and list_aggregate(list_transform(embedding, lambda x: case when x is null or isnan(x) or isinf(x) then 1 else 0 end), 'sum') = 0
    group by vec_id),
s as (
    select q.vec_id as query_id, c.vec_id,
        cast(list_inner_product(cast(q.e as double[]), cast(c.e as double[])) as bigint) as score
    from v q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e)
    where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5""",
    "op2_warc": """
with p as (
    select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload) as n, sha1(payload) as digest from p),
w as (select digest, max(page_id) as winner from d where n >= 1000 group by digest)
select d.page_id, cast(d.n as bigint) as payload_bytes, d.digest as payload_digest,
    case when w.winner is not null and d.page_id is distinct from w.winner then 'revisit' else 'response' end as record_type,
    case when w.winner is not null and d.page_id is distinct from w.winner then w.winner end as refers_to
from d left join w on d.digest = w.digest and d.n >= 1000""",
    "op3_tool_calls": """
with c as (
    select conv_id, conv_id || ':' || turn as call_id, turn, text from conversations where role = 'user'),
r as (
    select conv_id, conv_id || ':' || (turn - 1) as call_id, text from conversations where role = 'assistant'),
j as (
    select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.call_id, r.call_id) as call_id,
        c.call_id is not null as called, r.call_id is not null as answered, c.turn, c.text, r.text as result
    from c full join r on c.conv_id = r.conv_id and c.call_id = r.call_id),
o as (
    select *, case when not called then 'orphan' when answered then 'linked' else 'unanswered' end as status,
        (text is not null and len(text) between 1 and 400) as fine,
        coalesce(cast(to_json(result) as varchar), 'null') as result_json
    from j)
select conv_id, call_id, status,
    case when called then row_number() over (partition by conv_id, called order by turn) - 1 end as position,
    case when called then fine end as valid,
    cast(case when called and not fine then 1 else 0 end as bigint) as n_errors,
    sha256(case when called then '{"after":["' || conv_id || ':' || (turn - 2) || '"],"arguments":{'
            || case when text is null then '' else '"question":' || cast(to_json(text) as varchar) || ',' end
            || '"turn":' || turn || '},"id":"' || call_id || '","name":"answer","result":' || result_json || '}'
        else '{"id":"' || call_id || '","result":' || result_json || '}' end) as json_sha256
from o""",
    "op4_decontamination": rf"""
with dw as (
    select doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (
    select coalesce(cast(item_id as varchar), '') as item, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
phrase as (
    select distinct item, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as p
    from (select item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from bw where len(w) > 0)),
sizes as (select distinct n from phrase),
dp as (
    select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as p
    from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, sizes where len(w) >= n)),
hits as (select dp.doc_id, dp.i, dp.n, phrase.item from dp join phrase on dp.n = phrase.n and dp.p = phrase.p),
words as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from hits) group by doc_id),
items as (
    select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
    from (select distinct doc_id, item from hits) group by doc_id)
select dw.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join words on dw.doc_id = words.doc_id left join items on dw.doc_id = items.doc_id""",
    "op8_line_dedup": r"""
with l as (
    select doc_id, cast(u.i - 1 as integer) as line,
        list_distinct(list_filter(string_split(lower(translate(lines[u.i], chr(9) || chr(11) || chr(12) || chr(13), '    ')), ' '), lambda x: x <> '')) as s
    from (select doc_id, string_split(text, chr(10)) as lines from documents where text is not null) d,
        lateral (select unnest(range(1, len(lines) + 1)) as i) u),
t as (select *, list_sort(s) as k, len(s) as n from l where len(s) > 0),
sets as (
    select row_number() over (order by min((doc_id, line))) as id, k, min((doc_id, line)) as first, any_value(n) as n
    from t group by k),
tok as (select id, n, unnest(k) as w from sets),
df as (select w, count(*) as f from tok group by w),
ranked as (
    select id, n, tok.w, row_number() over (partition by id order by f, tok.w) as p
    from tok join df on tok.w = df.w),
prefix as (select id, n, w from ranked where p <= n - cast(ceil(n * 80 / 100.0) as bigint) + 1),
pairs as (
    select distinct x.id as x, y.id as y from prefix x join prefix y on x.w = y.w and y.id < x.id
    where 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
gone as (
    select distinct x.id from pairs join sets x on x.id = pairs.x join sets y on y.id = pairs.y
    where 100 * len(list_intersect(x.k, y.k)) >= 80 * (x.n + y.n - len(list_intersect(x.k, y.k)))),
removed as (
    select t.doc_id, t.line from t join sets on t.k = sets.k
    where (t.doc_id, t.line) <> sets.first or sets.id in (select id from gone)),
agg as (select doc_id, count(*) as n_removed, string_agg(cast(line as varchar), ',' order by line) as removed_lines from removed group by doc_id)
select d.doc_id, cast(coalesce(len(string_split(d.text, chr(10))), 0) as bigint) as n_lines,
    coalesce(n_removed, 0) as n_removed, coalesce(removed_lines, '') as removed_lines
from documents d left join agg on d.doc_id = agg.doc_id""",
}
