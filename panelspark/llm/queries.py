"""The operators' registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat_format, decontaminate, mixture, nn_descent, packing, periodic, quality, shards, simhash, substring, url_filter, warc
from .common import scratch, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_warc(warc.capture_records(table(spark, sf_dir, "pages")), path)
    c = warc.assemble(warc.read_warc(spark, path, payloads=False))
    about = F.element_at("metadata", 1)["fields"]
    revisit = F.col("capture.record_type") == "revisit"
    page_of = lambda name: F.regexp_extract(name, r"^<urn:page:(-?\d+):", 1).cast("long")
    return c.select(
        F.try_element_at(about, F.lit("pageId")).cast("long").alias("page_id"),
        F.when(revisit, F.try_element_at(about, F.lit("payloadBytes")).cast("long")).otherwise(F.col("capture.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("capture.declared_digest")).otherwise(F.col("capture.payload_digest")).alias("payload_digest"),
        F.col("capture.record_type").alias("record_type"),
        F.when(revisit, page_of(F.col("capture.refers_to"))).alias("refers_to"),
    )


OP1_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as digest from pages),
f as (select digest, min(page_id) as first from p where n >= 100 group by digest)
select page_id, n::bigint as payload_bytes, p.digest as payload_digest,
  case when n >= 100 and first <> page_id then 'revisit' else 'response' end as record_type,
  case when n >= 100 and first <> page_id then first end as refers_to
from p left join f on p.digest = f.digest
"""


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat_format.render(chat_format.fold_events(chat_format.messages_as_events(rows)))
    turns = chat_format.parse(F.col("formatted"))
    out = out.select("conv_id", turns.alias("read"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    spoken = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


OP4_SQL = r"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
e as (select *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '</', '<\/') as x,
        replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</', '<\/'), ':', '\:') as y from r)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(x) + length(y) + 14)::bigint as formatted_chars
from e group by conv_id
"""

def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP5_SQL = r"""
with d as (select doc_id, row_number() over () as r, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
i as (select distinct item_id, least(len(w), 13) as n, array_to_string(w[k : k + least(len(w), 13) - 1], ' ') as t from b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as u(k) where len(w) > 0),
h as (select d.r, k, i.n, i.item_id from d, (select distinct n from i) as l, unnest(range(1, len(d.w) - l.n + 2)) as u(k), i where i.n = l.n and i.t = array_to_string(d.w[k : k + l.n - 1], ' ')),
c as (select r, count(distinct p) as n_hit from h, unnest(range(k, k + n)) as u(p) group by r),
g as (select r, count(distinct item_id) as n_items, array_to_string(list_sort(list_distinct(list(item_id::varchar))), ',') as items from h group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join c using (r) left join g using (r)
"""

def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards.ingest(shards.ShardTable(spark, scratch(spark, "shards")), table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


OP6_SQL = "select doc_id, lang, source, n_chars, sha256(text) as text_sha256 from documents"

#: Fixed values of the rule list: host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def _op7_sql() -> str:
    rules = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    return f"""
with u as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
v as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u)
select page_id, host, path, case {' '.join(f"when {fits(h, p)} then '{h}{p}'" for h, p, _ in rules)} end as rule,
  case {' '.join(f"when {fits(h, p)} then '{v}'" for h, p, v in rules)} else 'allow' end as verdict
from v
"""


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def tokenizer_path() -> str:
    """Where the public vocabulary lies on this machine; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(periodic.with_planted_tails(table(spark, sf_dir, "documents")))


def piece_path() -> str:
    """Where the public vocabulary of pieces lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), piece_path())


def op13_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_nn_descent": op2_nn_descent,
    "op3_simhash": op3_simhash,
    "op4_chat_format": op4_chat_format,
    "op5_decontaminate": op5_decontaminate,
    "op6_shards": op6_shards,
    "op7_url_filter": op7_url_filter,
    "op8_substring": op8_substring,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_align": op12_align,
    "op13_mixture": op13_mixture,
}
SQL: dict[str, str] = {"op1_warc": OP1_SQL, "op4_chat_format": OP4_SQL, "op5_decontaminate": OP5_SQL, "op6_shards": OP6_SQL, "op7_url_filter": _op7_sql()}
