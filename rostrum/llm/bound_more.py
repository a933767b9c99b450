"""Whitening, best-fit packing and conversation repair bound to their tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rostrum.llm import bestfit, repair
from rostrum.llm.bound import SQL_CRC
from rostrum.llm.registry import query, table
from rostrum.llm.whitening import whiten


@query()
def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings on the four leading components of their distinct vectors."""
    rows, model, (deviation, whitened) = whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    explained = model.explained() if model else []
    return rows.select("vec_id", deviation, F.posexplode(whitened).alias("at", "white")).select(
        "vec_id", (F.col("at") + 1).alias("component"),
        F.lit(model.n if model else None).cast("bigint").alias("n"), F.col(deviation).alias("deviation"),
        F.col("white").alias("whitened"),
        F.get(F.array(*map(F.lit, explained)).cast("array<double>"), F.col("at")).alias("explained"),
        F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
    )


@query()
def op12_bestfit(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed whole into as few sequences of 2,048 ids as the method finds."""
    parts = bestfit.pieces(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return bestfit.pack(parts).select(
        F.col("doc").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
    )


def _ways(state: str) -> str:
    """SQL for the state a row leads to: deleted, or kept or given a role from the states before."""
    before, role, initial = {"u": (("b", "s", "a"), "user", "u"), "a": (("u",), "assistant", "a"),
                             "s": (("b",), None, "s"), "b": ((), None, None)}[state]
    ways = [f"{{c: {state}.c + 4, e: {state}.e || 'D', r: {state}.r}}"]
    for x in before:
        ways.append(f"""{{c: {x}.c + case when initial = '{initial}' then more else {FAR} end,
          e: {x}.e || 'K', r: {x}.r || chr(10) || role || ':' || text}}""")
        if role:
            ways.append(f"{{c: {x}.c + 3 + more, e: {x}.e || 'R', r: {x}.r || chr(10) || '{role}:' || text}}")
    return f"least({', '.join(ways)})" if before else ways[0]


def _insert(state: str, role: str) -> str:
    return f"{{c: {state}.c + 3, e: {state}.e || 'I', r: {state}.r || chr(10) || '{role}:'}}"


FAR = 1 << 40
NOWHERE = f"{{c: {FAR}::bigint, e: '', r: ''}}"
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

# Forward, state by state, the least of (cost, edits): edits of equal cost after equally many rows
# are never one the beginning of the other, so what is least stays least.
SQL_REPAIR = f"""
with recursive crc_rule as (
  select list(c order by i) as crc_table from (
    select i, list_reduce(list_prepend(i, range(8)),
      lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from (select unnest(range(256)) as i))
), given as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         hex(encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))) as h
  from conversations
), kinds as (
  select *, xor({SQL_CRC}, 4294967295) % 20 as kind from given, crc_rule
), damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
         unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) as copy
  from kinds
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
         trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as cut
  from damaged
), faults as (
  select *, case when cut = '' then 'blank'
                 when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
                 when right(cut, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
         left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as pair
  from placed
), counts as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count(*) filter (where fault = 'blank') as blank,
         count(*) filter (where fault = 'duplicate') as duplicate,
         count(*) filter (where fault = 'truncated') as truncated,
         count(*) filter (where pair is not null and pair not in ('su', 'ua', 'au')) as illegal
  from faults group by conv_id
), walk(conv_id, i, b, s, u, a) as (
  select conv_id, 0::bigint, {{c: 0::bigint, e: '', r: ''}}, {NOWHERE},
         {{c: 3::bigint, e: 'I', r: chr(10) || 'user:'}},
         {{c: 6::bigint, e: 'II', r: chr(10) || 'user:' || chr(10) || 'assistant:'}}
  from counts
  union all
  select conv_id, i, b, s, least(u1, {_insert('a', 'user')}) as u, a from (
    select conv_id, i, b, s, u as u1, least(a0, {_insert('u', 'assistant')}) as a from (
      select conv_id, i, b, s, least(u0, {_insert('b', 'user')}, {_insert('s', 'user')}, {_insert('a0', 'user')}) as u, a0
      from (
        select conv_id, i, {_ways('b')} as b, {_ways('s')} as s, {_ways('u')} as u0, {_ways('a')} as a0
        from (
          select w.conv_id, f.i, w.b, w.s, w.u, w.a, f.role, f.text, f.initial,
                 case f.fault when '' then 0 when 'truncated' then 3 else {FAR} end as more
          from walk w join faults f on f.conv_id = w.conv_id and f.i = w.i + 1))))
), ends as (
  select conv_id, least(b, a) as way from walk join counts using (conv_id) where i = n
)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank,
       coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
       coalesce(illegal, 0)::bigint as illegal, coalesce(way.c, 0)::bigint as cost,
       coalesce(way.e, '') as audit, coalesce(sha256(substr(way.r, 2)), '{EMPTY_SHA256}') as repaired_sha256
from (select distinct conv_id from conversations) left join counts using (conv_id) left join ends using (conv_id)"""


@query(SQL_REPAIR)
def op13_repair(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations after damage: their faults, and the cheapest edits that mend them."""
    rows = repair.damaged(table(spark, folder, "conversations"))
    return repair.repair(rows).withColumnRenamed("conv", "conv_id")
