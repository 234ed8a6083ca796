"""Chat formatting: collapse cumulative snapshots, then render.

Logs often hold a conversation once per turn, each time with all turns so far.
Every turn gets a hash of its role and text; the hash of a prefix is the running
XOR of its turns' hashes, each mixed with its position, so two prefixes agree
only if their turns do, in order.  A conversation that equals a proper prefix of
another one goes (anti join); of equal conversations the one with the smallest
``conv_id`` stays.  Only then are turns gathered and rendered.  All of it is
DataFrame functions.

Defined cases: rows with a null ``conv_id`` take no part; rows that agree in
conversation, turn, role and text count once; rows of one turn that differ are
ordered by the hash of role and text; a null turn comes first; a null role is
rendered as ``unknown`` and a null text as the empty text, and both differ from
those values in comparisons; further columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from sunder.plans.scratch import Scratch

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turn_hash():
    tagged = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    return F.md5(F.concat(F.md5(tagged("role")), F.md5(tagged("text"))))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, n_turns)`` of the conversations that no other one continues."""
    scratch = Scratch(turns.sparkSession, "chat")
    rows = _hashed(turns).select("conv_id", "turn", "h").distinct()
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "h")
    rows = rows.withColumn("pos", F.row_number().over(order))
    run = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    prefix = rows.select(
        "conv_id",
        "pos",
        F.bit_xor(F.xxhash64("pos", "h")).over(run).alias("p1"),
        F.bit_xor(F.xxhash64(F.lit("other"), "h", "pos")).over(run).alias("p2"),
        F.lead("pos").over(order).isNull().alias("last"),
    )
    prefix = scratch.keep(prefix)
    whole = prefix.where("last").groupBy("p1", "p2", "pos").agg(F.min("conv_id").alias("conv_id"))
    continued = prefix.where("not last").select("p1", "p2", "pos").distinct()
    return whole.join(continued, ["p1", "p2", "pos"], "left_anti").select("conv_id", F.col("pos").cast("long").alias("n_turns"))


def _hashed(turns: DataFrame) -> DataFrame:
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    ).where("conv_id is not null").withColumn("h", _turn_hash())


def format_chats(turns: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, rendered)`` of every maximal conversation of ``turns(conv_id, turn, role, text)``."""
    kept = maximal_conversations(turns)
    rows = _hashed(turns).join(kept, "conv_id")
    said = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE + "\n"))
    rows = rows.select("conv_id", "n_turns", F.struct("turn", "h", said.alias("said")).alias("x"))
    listed = rows.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_set("x")).alias("x"))
    return listed.select("conv_id", "n_turns", F.array_join(F.col("x.said"), "").alias("rendered"))


ORACLE_SQL = f"""
WITH h AS (
  SELECT DISTINCT conv_id, turn, role, text,
         md5(md5(coalesce('=' || role, '-')) || md5(coalesce('=' || text, '-'))) AS h
  FROM conversations WHERE conv_id IS NOT NULL
), k AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(h, '' ORDER BY turn NULLS FIRST, h) AS key,
         string_agg('{OPEN}' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '{CLOSE}' || chr(10), ''
                    ORDER BY turn NULLS FIRST, h) AS rendered
  FROM h GROUP BY conv_id
)
SELECT a.conv_id, a.n_turns, a.rendered, length(a.rendered) AS n_chars FROM k a
WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.conv_id <> a.conv_id AND starts_with(b.key, a.key)
                  AND (length(b.key) > length(a.key) OR b.conv_id < a.conv_id))
"""
