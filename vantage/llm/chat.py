"""Perspective rotation of multi-party dialogues.

For every participant of a conversation the dialogue is rendered once with that speaker as assistant and all
others as named users; the mask lists the character ranges to train on, the speaker's own words with
their end mark.  System turns are context: rendered for everybody, masked for nobody, and no perspective.

A dialogue is rendered in parts of ``PART`` turns, which in order of ``part`` make up the whole; so a
conversation of any length is never one task's row.  Turns are ordered by number, then role, then text, and
numbered through: equal turns are counted before anything is sorted, the rest is dealt by range, and a turn's
place is what stands before it in its range and in those before.

A null role is the participant ``unknown``, null text is empty, a null turn number comes first, and rows
without a conversation id are one conversation.  Repeated rows are repeated turns.  A conversation of system
turns only has no perspectives; an empty table gives an empty result; extra columns are not kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantage.llm.base import stored, table

PART = 256
SYSTEM = "system"
END_MARK = "<|end|>\n"


def _header(role: Column, speaker: Column) -> Column:
    return (
        F.when(role == SYSTEM, F.lit("<|system|>\n"))
        .when(role == speaker, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))
    )


def _placed(turns: DataFrame) -> DataFrame:
    """Turns with ``part``, the PART turns of the conversation that it belongs to; repeated turns once for each time."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    counted = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    ranged = stored(counted.repartitionByRange("conv_id", *order).withColumn("range", F.spark_partition_id()), "turns")
    sums = ranged.groupBy(F.col("conv_id").alias("_conv"), F.col("range").alias("_range")).agg(F.sum("n").alias("n"))
    before = Window.partitionBy("_conv").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = sums.select("_conv", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("conv_id", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(offsets, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("range") == F.col("_range"))).withColumn("end", F.col("offset") + F.sum("n").over(within))
    first, last = F.col("end") - F.col("n"), F.col("end") - 1
    parts = placed.withColumn("part", F.explode(F.sequence(F.floor(first / PART), F.floor(last / PART))))
    copies = F.least(F.col("end"), (F.col("part") + 1) * PART) - F.greatest(first, F.col("part") * PART)
    return parts.select("conv_id", "turn", "role", "text", "part", F.explode(F.sequence(F.lit(1), copies)).alias("copy"))


def perspectives(turns: DataFrame) -> DataFrame:
    """conv_id, speaker, part, n_turns, text and mask (array of start, end) of every participant's rendering."""
    clean = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    speakers = clean.where(F.col("role") != SYSTEM).groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).agg(F.lit(1).alias("_one"))
    header = _header(F.col("role"), F.col("speaker"))
    rendered = _placed(clean).join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id",
        "speaker",
        F.col("part").cast("long").alias("part"),
        F.struct(
            "turn", "role", "text", header.alias("header"), F.concat(header, F.col("text"), F.lit(END_MARK)).alias("segment"), (F.col("role") == F.col("speaker")).alias("own")
        ).alias("x"),
    )
    parts = rendered.groupBy("conv_id", "speaker", "part").agg(F.array_sort(F.collect_list("x")).alias("x"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["segment"])
        span = F.struct((acc["at"] + F.length(x["header"])).alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["own"], F.concat(acc["mask"], F.array(span))).otherwise(acc["mask"]).alias("mask"))

    return parts.select(
        "conv_id",
        "speaker",
        "part",
        F.size("x").cast("long").alias("n_turns"),
        F.array_join(F.transform("x", lambda x: x["segment"]), "").alias("text"),
        F.aggregate("x", start, step, lambda acc: acc["mask"]).alias("mask"),
    )


def op3_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perspectives(table(spark, sf_dir, "conversations"))
    return out.select(
        "conv_id",
        "speaker",
        "part",
        "n_turns",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("text", 256).alias("text_sha256"),
        F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"], m["end"])), ",").alias("mask"),
    )


ORACLE = """
with t as (
  select conv_id, turn, role, text, (row_number() over (partition by conv_id order by turn nulls first, role, text) - 1) // 256 as part
  from (select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations)),
s as (select distinct conv_id, role as speaker from t where role <> 'system'),
g as (
  select t.conv_id, speaker, part::bigint as part, turn, role, text,
         case when role = 'system' then '<|system|>' || chr(10) when role = speaker then '<|assistant|>' || chr(10)
              else '<|user name=' || role || '|>' || chr(10) end as header
  from t join s on t.conv_id is not distinct from s.conv_id),
h as (select *, header || text || '<|end|>' || chr(10) as segment from g),
p as (select *, sum(length(segment)) over (partition by conv_id, speaker, part order by turn nulls first, role, text rows unbounded preceding) as stop from h)
select conv_id, speaker, part, count(*) as n_turns, sum(length(segment))::bigint as n_chars,
       sha256(string_agg(segment, '' order by turn nulls first, role, text)) as text_sha256,
       coalesce(string_agg(case when role = speaker then (stop - length(segment) + length(header))::bigint || ':' || stop::bigint end, ','
                           order by turn nulls first, role, text), '') as mask
from p group by conv_id, speaker, part
"""
