"""Joins with heavy keys kept apart, and connected components of links."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from pathscreen.staging import stage

HEAVY_SHARE = 2000  # a key with more than one in so many of the rows is heavy, so there are fewer than that many of them


def joined_apart(rows: DataFrame, ones: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``ones``, one row per ``key`` that says in ``size`` how many rows have it, of ``total`` rows in all. The rows of a heavy
    key stay where they are: its one row comes to them in a table of bounded size, fewer than 2,000 rows."""
    limit = math.ceil(total / HEAVY_SHARE) + 1000
    given = [c for c in ones.columns if c != key]
    heavy = F.broadcast(ones.where(F.col(size) > limit).select(key, F.struct(*given).alias("heavy")))
    marked = rows.join(heavy, key, "left")
    light = marked.where("heavy IS NULL").drop("heavy").join(ones.where(F.col(size) <= limit), key, "left")
    return light.unionByName(marked.where("heavy IS NOT NULL").select(*rows.columns, "heavy.*"))


def components(edges: DataFrame) -> DataFrame:
    """(key, root): the smallest key reachable, for every key of ``edges(a, b)``; keys of any type that sorts, null edges count as none.

    Alternating large and small stars; each round is a written table. The least neighbour is combined before the shuffle, and the edges
    of a heavy vertex do not move to one task (``joined_apart``).
    """
    links = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while mark[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", F.least("u", "m").alias("m"), "degree"))
        large = joined_apart(both.where("v > u"), low, "u", "degree", 2 * mark[0])
        large = stage(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = stage(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")))
        small = joined_apart(large, low, "u", "degree", mark[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return links.select(F.col("u").alias("key"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct())
