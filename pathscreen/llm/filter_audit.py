"""How filters interact in every order: Lehmer ranks and difference arrays.

A document's failures are a mask. An order of the filters has a rank among all orders, its Lehmer code read as a
number in the factorial base; orders that begin alike have consecutive ranks. A document with a given mask is removed
at step s by all orders that begin with s - 1 filters it passes and then one it fails: each such beginning covers one
interval of (n - s)! ranks. So a mask's count is added at an interval's first rank and taken off after its last, and one
running sum over the ranks gives what every order removes at that step. Documents are counted once; what follows
has at most 2^n masks a part, whatever their number.
"""
from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pathscreen.llm.common import words
from pathscreen.llm.linking import joined_apart
from pathscreen.staging import stage

FILTERS = "ABCDE"


def orders(filters: str = FILTERS) -> list[str]:
    """All orders, by rank."""
    return ["".join(p) for p in permutations(sorted(filters))]


def removal_intervals(filters: str = FILTERS) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last) of all beginnings that remove a document of that mask at that step; bit i is the i-th filter."""
    n, found = len(filters), []

    def begin(mask: int, left: list[int], rank: int, step: int) -> None:
        width = math.factorial(n - step)
        for digit, k in enumerate(left):
            at = rank + digit * width
            if mask >> k & 1:
                found.append((mask, step, at, at + width))
            else:
                begin(mask, left[:digit] + left[digit + 1:], at, step + 1)

    for mask in range(1, 1 << n):
        begin(mask, list(range(n)), 0, 1)
    return found


def interaction_audit(facts: DataFrame, filters: str = FILTERS, counted: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """One row per part, order and step of ``facts(part, mask, ...)``, one row a document; ``counted``: boolean columns.

    Returns part, filter_order, step, filter, kept, removed, redundant, unique_fails, <name>_lost for each counted column, shapley.
    A null flag counts as false, a null mask as no failure; equal rows each count; other columns are not read. An empty table has no part and gives an empty result.
    """
    spark, n = facts.sparkSession, len(filters)
    masks = stage(facts.groupBy("part", F.coalesce("mask", F.lit(0)).cast("int").alias("mask")).agg(
        F.count(F.lit(1)).alias("removed"), *(F.count(F.when(F.col(c), 1)).alias(f"{c}_lost") for c in counted)))
    sums = ["removed", *(f"{c}_lost" for c in counted)]
    spans = spark.createDataFrame(removal_intervals(filters), "mask int, step int, first int, after int")  # fixed: at most n! * 2^n rows
    ends = masks.join(F.broadcast(spans), "mask").withColumn("end", F.explode(F.array(F.struct(F.col("first").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("after").alias("rank"), F.lit(-1).alias("sign")))))
    steps = ends.groupBy("part", "step", F.col("end.rank").alias("rank")).agg(*(F.sum(F.col(c) * F.col("end.sign")).alias(c) for c in sums))
    parts = masks.groupBy("part").agg(F.sum("removed").alias("total"), *(F.sum(F.when(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0, F.col("removed")).otherwise(0)).alias(f"fails{k}") for k in range(n)),
                                      *(F.sum(F.when(F.col("mask") == 1 << k, F.col("removed")).otherwise(0)).alias(f"only{k}") for k in range(n)))
    parts = parts.select("part", "total", F.array(*(f"fails{k}" for k in range(n))).alias("fails"), F.array(*(f"only{k}" for k in range(n))).alias("only"))
    grid = parts.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(math.factorial(n) - 1)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    out = grid.join(steps, ["part", "step", "rank"], "left").select(*grid.columns, *(F.sum(F.coalesce(c, F.lit(0))).over(along).alias(c) for c in sums))
    out = out.withColumn("filter_order", F.element_at(F.array(*map(F.lit, orders(filters))), F.col("rank") + 1)).withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    letter = F.instr(F.lit("".join(sorted(filters))), F.col("filter"))
    so_far = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return out.select("part", "filter_order", "step", "filter", (F.col("total") - F.sum("removed").over(so_far)).alias("kept"), "removed",
                      (F.element_at("fails", letter) - F.col("removed")).alias("redundant"), F.element_at("only", letter).alias("unique_fails"), *sums[1:],
                      F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"))


def text_failures(text: Column, found: Column) -> Column:
    """Bits of A to D for a text and its words: under 100 words; under 80 in 100 words distinct; over 10 in 100 code points A-Z; a sign of #$%&*|."""
    n = F.size(found)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [n < 100, 100 * F.size(F.array_distinct(found)) < 80 * n, 100 * capitals > 10 * F.length(text), text.rlike(r"[#$%&*|]")]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def document_facts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic of every row of ``docs(doc_id, text, lang)``, for the filters A to E.

    E: a row with a smaller doc_id has the same text. Null text is the empty text. Null ids are never smaller or larger than any, so such
    rows never fail E and have no label; rows that repeat an id are told apart by nothing and never fail E by each other. Several labels of one id: any that says so counts.
    The text is read once; the rest works on a digest of 32 bytes. The rows of a text that very many share do not move to one task.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text")).withColumn("found", words(F.col("text")))
    seen = stage(read.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"), text_failures(F.col("text"), F.col("found")).alias("mask")))
    firsts = stage(seen.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("copies")).where("first < last").select("key", "first", "copies"))
    marked = joined_apart(seen, firsts, "key", "copies", firsts.agg(F.sum("copies")).first()[0] or 0).select("doc_id", "part", F.when(F.col("doc_id") > F.col("first"), F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"))
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    named = marked.where("doc_id IS NOT NULL").join(said, "doc_id", "left").select("part", "mask", "good", "toxic")
    return named.unionByName(marked.where("doc_id IS NULL").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic")))
