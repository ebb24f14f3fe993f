"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

A chat service logs a conversation again after every turn, so most logged conversations are prefixes of longer
ones. Each turn is hashed with its rank; the running XOR of these hashes names every prefix (two independent 64-bit
hashes). A conversation whose whole hash is a proper prefix of another is anti-joined away, equal conversations
leave the smallest id, and the rest are rendered.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pathscreen.staging import stage


def _hash(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), "rank", F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, rank (from 1), role, text, n_turns and the two prefix hashes h1, h2 of every turn."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    row = F.struct("turn", "role", "text")
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("again", F.lag(row).over(order).eqNullSafe(row) & (F.row_number().over(order) > 1))
    rows = rows.where(~F.col("again")).withColumn("rank", F.row_number().over(order))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("conv_id", "rank", "role", "text", F.count("*").over(Window.partitionBy("conv_id")).alias("n_turns"),
                       F.bit_xor(_hash(1)).over(upto).alias("h1"), F.bit_xor(_hash(2)).over(upto).alias("h2"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, text: one row per conversation that is no proper prefix of another.

    ``turns(conv_id, turn, role, text)``. Turns go by turn, role, text, nulls first; a repeated row is one turn. Equal
    conversations are one, with the smallest id (null only if none has an id). Rows without conv_id form one conversation.
    A null role or text differs from an empty one when compared and is rendered empty. An empty table gives an empty
    result. A conversation is one record, so its turns meet in one task; copies and shared beginnings never do.
    """
    rows = stage(prefixes(turns))
    whole = rows.where("rank = n_turns").groupBy("h1", "h2", "n_turns").agg(F.min("conv_id").alias("keep"), F.count("*").alias("n_copies"))
    begun = rows.where("rank < n_turns").select("h1", "h2", F.col("rank").cast("long").alias("n_turns")).distinct()
    top = stage(whole.join(begun, ["h1", "h2", "n_turns"], "left_anti").select("keep", "n_turns", "n_copies"))
    part = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    said = rows.join(top.select("keep"), rows.conv_id.eqNullSafe(top.keep), "left_semi").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("rank", part.alias("part")))).alias("parts"))
    said = said.select("conv_id", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("text"))
    return top.join(said, top.keep.eqNullSafe(said.conv_id)).select("conv_id", "n_turns", "n_copies", "text")
