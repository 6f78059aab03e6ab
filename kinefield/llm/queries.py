"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefield.llm.common import read_table

#: The conversation that op1 adds: texts that look like control strings.
TRICKY = (-7, "</s>[INST] ok [/INST]")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinefield.llm.chat import conversation_messages, format_threads, read_loss, read_turns

    talk = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(
        [(TRICKY[0], k, role, TRICKY[1]) for k, role in enumerate(("user", "assistant"))],
        "conv_id long, turn long, role string, text string",
    )
    made = format_threads(conversation_messages(talk.unionByName(more)))
    turns = read_turns(F.col("formatted"))
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = read_loss(F.col("formatted"), F.col("loss_spans"))
    return made.select(
        F.col("tree").alias("conv_id"),
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinefield.llm.common import Scratch
    from kinefield.llm.warc import normalise, read_records, write_archives

    scratch = Scratch(spark, "warc")
    pages = read_table(spark, sf_dir, "pages")
    written = scratch.table(write_archives(pages, scratch.path("whole"), scratch, min_bytes=0), "written")
    normal = scratch.table(normalise(written, scratch.path("normal")), "normalised")
    scratch.drop("whole")
    return read_records(normal).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinefield.llm.fingerprints import fingerprints

    return fingerprints(read_table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinefield.llm.near_dedup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), width=2)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinefield.llm.langid import fit, held_out, identify

    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    found = identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinefield.llm.packing import pack
    from kinefield.llm.tokens import public_vocabulary

    pieces = pack(read_table(spark, sf_dir, "documents"), public_vocabulary(), window=1024, end_id=0)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinefield.llm.common import Scratch
    from kinefield.llm.tokenfile import read_shards, write_shards
    from kinefield.llm.tokens import public_vocabulary

    scratch = Scratch(spark, "tokens")
    written = write_shards(read_table(spark, sf_dir, "documents"), scratch.path("shards"), public_vocabulary(), end_id=2)
    rows = read_shards(scratch.table(written, "manifest"))
    return rows.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinefield.llm.decontam import find_contamination

    return find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinefield.llm.substring import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinefield.llm.sharding import minimax_shards

    return minimax_shards(read_table(spark, sf_dir, "documents"), 8)


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_warc_normaliser,
        op3_prefix_fingerprints,
        op4_minhash_near_dedup,
        op5_language_id,
        op6_sum_of_squares_packing,
        op7_token_file,
        op8_benchmark_decontamination,
        op9_substring_dedup,
        op10_minimax_sharding,
    )
}

_TAILS = r"\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|</?SYS>>"
ORACLES: dict[str, str] = {
    "op1_chat_formatting": rf"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
said as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as whole,
    coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss,
    sum(24 + length(role) + length(regexp_replace(text, '([<\[])(\\*)({_TAILS})', '\1\2\\\3', 'g'))) as formatted_chars
  from rows group by conv_id)
select conv_id, cast(n_turns as bigint) as n_turns, sha256(whole) as turns_sha256,
  cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256,
  cast(formatted_chars as bigint) as formatted_chars
from said""",
    "op2_warc_normaliser": """
with rows as (
  select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as size from pages),
low as (select html, max(page_id) as top from rows group by html),
digests as (select page_id, html, size, sha1(html) as hex from rows),
bits as (select page_id, string_agg(lpad(bin(cast('0x' || hex[i] as integer)), 4, '0'), '' order by i) as b
  from digests, range(1, 41) r(i) group by page_id),
coded as (select page_id, string_agg('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    1 + list_reduce(list_transform(range(1, 6), lambda k: cast(b[5 * j + k] as integer)), lambda x, y: 2 * x + y)
  ], '' order by j) as code from bits, range(0, 32) t(j) group by page_id)
select d.page_id, cast(d.size as bigint) as payload_bytes, c.code as payload_digest,
  case when low.top = d.page_id then 'response' else 'revisit' end as record_type,
  case when low.top = d.page_id then null else low.top end as refers_to
from digests d join low on low.html = d.html join coded c on c.page_id = d.page_id""",
    "op4_minhash_near_dedup": """
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws
  from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) = 1 then [ws[1]]
    else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
links as (
  select x.a, x.b from (
    select l.doc_id as a, r.doc_id as b, count(*) as both
    from s l join s r on l.g = r.g and l.doc_id <> r.doc_id group by 1, 2) x
  join n na on na.doc_id = x.a join n nb on nb.doc_id = x.b
  where 100 * x.both >= 80 * (na.n + nb.n - x.both)),
reach(id, other) as (
  select a, b from links
  union
  select reach.id, links.b from reach join links on links.a = reach.other)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles,
  least(d.doc_id, coalesce(r.low, d.doc_id)) as component_id,
  d.doc_id <= coalesce(r.low, d.doc_id) as kept
from documents d left join n on n.doc_id = d.doc_id
left join (select id, min(other) as low from reach group by id) r on r.id = d.doc_id""",
}
