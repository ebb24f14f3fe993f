"""Merkle manifest of a dataset by lag and lead windows.

Rows of a group stand in order; at every level each two consecutive nodes become one, a last one alone is hashed alone. A
node stays on the row of its first leaf, so at level l its sibling is exactly 2^l rows ahead or behind: one lag and one
lead column, masked by the slot in the run and by the length of the run, give the siblings, and first-child rows hash
the parents. The way back down is the same: a second child takes the path of its parent from 2^l rows behind.

No window holds a group. A block of 2^10 rows climbs ten levels in one window partition; the blocks' tops are the rows of
the next tier, a thousandth of the last one, until one node a group is left. Positions are prefix sums over range
partitions. Tiers meet again in joins on (group, block), so no key ever has more than 1,024 rows.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pathscreen.staging import stage

LEVELS = 10  # levels of a tier; a window partition has 2^LEVELS rows


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def record_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def group_key(value: Column) -> Column:
    """A string that is never null and sorts as the values do, null first, then bytewise."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value.cast("string")))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds pos (from 0, by ``order``) and n (rows of the group) within ``group``: ranges are sorted, their counts summed up. Rows equal in ``order`` are told apart by where they lie."""
    rows = stage(rows.withColumn("tie", F.monotonically_increasing_id()))
    placed = stage(rows.repartitionByRange("group", *order, "tie").sortWithinPartitions("group", *order, "tie").drop("tie").withColumn("mark", F.monotonically_increasing_id())
                   .withColumn("range", F.shiftright("mark", 33)))
    runs = placed.groupBy("group", "range").agg(F.min("mark").alias("start"), F.count("*").alias("size"))
    every = Window.partitionBy("group")
    before = F.coalesce(F.sum("size").over(every.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("group", "range", (before - F.col("start")).alias("shift"), F.sum("size").over(every).alias("n"))
    return placed.join(runs, ["group", "range"]).withColumn("pos", F.col("mark") + F.col("shift")).drop("mark", "range", "shift")


def climbed(rows: DataFrame, levels: int) -> DataFrame:
    """``rows(group, pos, n, node, ...)`` one tier up: ``node`` becomes the block's top on the block's first row, ``path`` lists a row's
    siblings from its own level on: r or l and the digest of the node to the right or left, - for none."""
    kept = [c for c in rows.columns if c not in ("node", "pos", "n", "group")]
    block = Window.partitionBy("group", "block").orderBy("pos")
    pos, out = F.col("pos"), rows.withColumn("block", F.shiftright("pos", levels))
    lives, second, follows = [], [], []
    for level in range(levels):
        step = 1 << level
        lives.append((pos % step == 0) & (F.col("n") > step))
        second.append(F.shiftright(pos, level) % 2 == 1)
        follows.append(pos + step < F.col("n"))
        out = out.withColumn("ahead", F.lead("node", step).over(block)).withColumn("behind", F.lag("node", step).over(block))
        sibling = F.when(second[level], F.concat(F.lit("l"), "behind")).when(follows[level], F.concat(F.lit("r"), "ahead")).otherwise(F.lit("-"))
        parent = F.sha2(F.when(follows[level], F.concat("node", "ahead")).otherwise(F.col("node")), 256)
        out = out.withColumn(f"s{level}", F.when(lives[level], sibling).otherwise(F.lit(""))).withColumn("node", F.when(lives[level] & ~second[level], parent).otherwise(F.col("node")))
    out = out.withColumn("path", F.lit(""))
    for level in reversed(range(levels)):
        above = F.when(second[level], F.lag("path", 1 << level).over(block)).otherwise(F.col("path"))
        out = out.withColumn("above", above).withColumn("path", F.when(lives[level], F.concat(f"s{level}", "above")).otherwise(F.col("path")))
    return out.select("group", "pos", "n", "block", "node", "path", *kept)


def trees(rows: DataFrame, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """(tiers from the leaves up, roots(group, node)) of ``rows(group, pos, n, node, ...)``."""
    tiers, rows = [], stage(rows)
    most = rows.agg(F.max("n")).first()[0] or 0
    while True:
        tiers.append(stage(climbed(rows, levels)))
        tops = tiers[-1].where(F.col("pos") % (1 << levels) == 0)
        most = -(-most >> levels) if most else 0
        if most <= 1:
            return tiers, tops.select("group", "node")
        rows = tops.select("group", F.shiftright("pos", levels).alias("pos"), F.shiftright(F.col("n") + (1 << levels) - 1, levels).alias("n"), "node")


def descended(tiers: list[DataFrame], crown: DataFrame) -> DataFrame:
    """The leaves with their whole path; ``crown(group, path, ...)`` has what lies above each group's root, and columns that all its leaves get."""
    given = [c for c in crown.columns if c not in ("group", "path")]
    above = crown.select("group", F.lit(0).cast("long").alias("block"), F.col("path").alias("rest"), *given)
    for k, tier in reversed(list(enumerate(tiers))):
        keep = [c for c in tier.columns if c not in ("path", "block", "node", "n")] if k == 0 else ["group", "pos"]
        joined = tier.join(above, ["group", "block"]).select(*keep, F.concat("path", "rest").alias("path"), *given)
        if k == 0:
            return joined
        above = joined.withColumnRenamed("pos", "block").withColumnRenamed("path", "rest")
    raise ValueError("no tier")


def manifest(leaves: DataFrame, order: Sequence[str], levels: int = LEVELS) -> DataFrame:
    """``leaves(group, leaf, ...)`` with subroot, root and path: the siblings from the leaf over its group's root to the root of all.

    Within a group leaves stand by ``order`` (null first), groups by their key. Rows equal in ``order`` stand in the order in which they were read, which is fixed once
    for a run: add columns, such as the leaf, to make reruns agree. Equal rows each have a leaf. An empty table gives an empty result.
    ``group`` must not be null (``group_key``). Names this function needs itself are refused.
    """
    taken = {"pos", "n", "node", "block", "path", "tie", "mark", "range", "rest", "subroot", "root"} & set(leaves.columns)
    if taken:
        raise ValueError(f"columns with names of this operator: {sorted(taken)}")
    tiers, tops = trees(numbered(leaves.withColumn("node", F.col("leaf")), order), levels)
    tops = stage(tops)
    over, root = trees(numbered(tops.select(F.lit("").alias("group"), F.col("group").alias("of"), F.col("node"), F.col("node").alias("subroot")), ["of"]), levels)
    upper = descended(over, root.select("group", F.lit("").alias("path"), F.col("node").alias("root")))
    return descended(tiers, stage(upper.select(F.col("of").alias("group"), "path", "subroot", "root"))).drop("pos")


def siblings(path: Column) -> Column:
    """The digests of a path, one after another."""
    return F.translate(path, "lr-", "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of a path."""
    steps = F.regexp_extract_all(path, F.lit("([lr][0-9a-f]{64}|-)"), F.lit(1))
    digest = lambda s: F.substring(s, 2, 64)
    return F.aggregate(steps, leaf, lambda a, s: F.sha2(F.when(s.startswith("l"), F.concat(digest(s), a)).when(s.startswith("r"), F.concat(a, digest(s))).otherwise(a), 256))
