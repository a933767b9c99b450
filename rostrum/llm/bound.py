"""The operators bound to the corpus tables, with their SQL where there is any."""

from __future__ import annotations

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from rostrum.llm import chat, decontaminate, quality, toxicity, warc
from rostrum.llm.linededup import dedup_lines
from rostrum.llm.neardup import near_duplicates
from rostrum.llm.neighbours import search
from rostrum.llm.packing import pack, pieces
from rostrum.llm.registry import crc32_of, fresh, query, table
from rostrum.llm.sharding import placements

SHARDS = 40
SLICES = 64

# CRC-32 in lists: a table of 256 by rule, folded over the bytes.
SQL_CRC = """list_reduce(
  list_prepend(4294967295::bigint, list_transform(regexp_extract_all(h, '..'),
    lambda x: ('0x' || x)::bigint)),
  lambda c, b: xor(c >> 8, crc_table[xor(c & 255, b) + 1]))"""


@query(f"""
with recursive docs as (
  select row_number() over () as row_id, doc_id, coalesce(text, '') as t,
         hex(encode(coalesce(text, ''))) as h, coalesce(strlen(text), 0) + 16 as size,
         md5(coalesce(doc_id::varchar, '')) as digest
  from documents
), walk(row_id, state, b, j) as (
  select row_id, ('0x' || substr(digest, 1, 16))::ubigint::hugeint, -1::bigint, 0::bigint from docs
  union all
  select row_id, state, j, floor((j + 1) * (2147483648.0::double / ((state >> 33) + 1)::double))::bigint
  from (select row_id, (state * 2862933555777941757::hugeint + 1) % 18446744073709551616::hugeint as state, b, j
        from walk where j <= {SHARDS})
), places as (
  select row_id, max(b) filter (where b < {SHARDS}) as shard, max(b) as grown from walk group by 1
), crc_rule as (
  select list(c order by i) as crc_table from (
    select i, list_reduce(list_prepend(i, range(8)),
      lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from (select unnest(range(256)) as i))
), bytes as (
  select row_id, doc_id, size, digest, xor({SQL_CRC}, 4294967295) as text_crc32
  from docs, crc_rule
)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'key' as law,
       shard::int as shard,
       row_number() over (partition by shard order by
         ('0x' || substr(digest, 9, 8))::bigint % {SLICES}, doc_id nulls first, size, text_crc32) - 1 as slot,
       grown::int as grown_shard
from bytes join places using (row_id)""")
def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 40 shards; the law is `key`."""
    rows = table(spark, folder, "documents").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"),
        crc32_of(F.col("text")).alias("text_crc32"),
    )
    return placements(rows, "doc_id", SHARDS, SLICES).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard",
    )


@query()
def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents, at 75 percent of five-word shingles."""
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select(
        F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept",
    )


@query("""
with lines as (
  select doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents
), keyed as (
  select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), firsts as (
  select key, min(doc_id) as first_doc from keyed where length(key) >= 10 group by 1
), marked as (
  select doc_id, pos, line, length(key) >= 10 and doc_id <> first_doc as gone
  from keyed left join firsts using (key)
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id""")
def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of all documents that no smaller document holds."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


def document_pieces(docs: DataFrame) -> DataFrame:
    return pieces(
        docs, public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
    )


@query()
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 1024 ids."""
    return pack(document_pieces(table(spark, folder, "documents"))).select(
        F.col("doc").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        "offset",
    )


LEAST_TAIL = 0.5


def graded(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[str]]:
    """`docs` with score, expected grade and tail probability under fresh names."""
    model = quality.fit(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
    names = fresh(docs, "quality_score", "expected_grade", "tail_probability")
    expected, tail = quality.grade_columns(F.col(names[0]), model)
    scored = docs.withColumn(names[0], quality.quality_score(F.col("text"), model))
    return scored.withColumns({names[1]: expected, names[2]: tail}), names


@query()
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Expected grade and tail probability of every document."""
    scored, names = graded(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    )
    return scored.select("doc_id", *names, (F.col(names[2]) >= LEAST_TAIL).alias("kept"))


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


@query()
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learnt outside the held-out fifth."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    return toxicity.fit_score(docs, labels).select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", "predicted",
        F.transform("evidence", lambda e: e["id"]).alias("evidence"),
    )


# A conversation whose texts look like the template's own marks.
MARKED = -7
MARKED_TEXT = "</s>[INST] ok [/INST]"
SQL_CONTROL = r"(\\|<s>|</s>|\[INST\]|\[/INST\]|\[SYS\]|\[/SYS\]|\[OUT\]|\[ROLE|\[/ROLE\])"
SQL_ESCAPED = r"\\\1"


@query(f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select {MARKED}, 0, 'user', '{MARKED_TEXT}'
  union all select {MARKED}, 1, 'assistant', '{MARKED_TEXT}'
), written as (
  select *, length(regexp_replace(text, '{SQL_CONTROL}', '{SQL_ESCAPED}', 'g')) +
    case role when 'user' then 15 when 'system' then 13 when 'assistant' then 10 end as chars
  from turns
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
       3 + sum(chars)::bigint as formatted_chars
from written group by conv_id""")
def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations formatted and read back, and one that imitates the template."""
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.range(2).select(
        F.lit(MARKED).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(MARKED_TEXT).alias("text"),
    )
    return chat.read_back(chat.render(given.unionByName(marked))).withColumnRenamed("conv", "conv_id")


@F.pandas_udf(StringType())
def _digest(payload: pd.Series) -> pd.Series:
    return payload.map(warc.digest_of)


@query()
def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages archived and read back; a response's digest and size are of what was read."""
    back = warc.read(spark, warc.archive(table(spark, folder, "pages")))
    whole = F.col("payload").isNotNull()
    return back.select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, _digest(F.coalesce("payload", F.lit(b"")))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


@query()
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, and the benchmark items it holds."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    items = table(spark, folder, "benchmark").select("item_id", "text")
    marked, names = decontaminate.mark(docs, items)
    return marked.select("doc_id", *names)


@query()
def op3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest found for every hundredth vector, among all others."""
    return search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)
