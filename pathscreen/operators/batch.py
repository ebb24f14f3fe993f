"""Summaries over many score rows. Each is one aggregation; nothing is collected."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pathscreen.functions.exprs import d
from pathscreen.operators.metrics import ID


def results(inputs: DataFrame, done: DataFrame, rejects: DataFrame) -> DataFrame:
    """One row per input: ``ok`` with the columns of ``done``, else ``error`` with the codes of its rejects, or ``lost`` if it has neither.

    inputs: (strategy_id); done: one row per input that went through; rejects: (strategy_id, code), any number.
    """
    errors = rejects.groupBy(ID).agg(F.array_join(F.array_sort(F.collect_set("code")), "|").alias("error"))  # codes are a fixed list
    out = inputs.select(ID).distinct().join(done.withColumn("ok", F.lit(True)), ID, "left").join(errors, ID, "left")
    ok = F.coalesce("ok", F.lit(False))
    return out.withColumn("ok", ok).withColumn("error", F.when(ok, F.lit("")).otherwise(F.coalesce("error", F.lit("lost"))))


def totals(rows: DataFrame) -> DataFrame:
    ok = F.coalesce(F.sum(F.col("ok").cast("long")), F.lit(0))
    n = F.count(F.lit(1))
    return rows.agg(n.alias("total_inputs"), ok.alias("ok"), (n - ok).alias("failed"), F.round(F.coalesce(F.try_divide(ok, n), F.lit(0.0)), 6).alias("success_rate"))


def outcome_counts(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Value counts of every dimension in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in dimensions])
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("rows"))


def score_distribution(rows: DataFrame, score: str = "display") -> DataFrame:
    """Mean and exact quantiles. Scores have one decimal, so at most a thousand distinct values are held."""
    q = F.percentile(score, F.array(*[d(p) for p in (0.5, 0.05, 0.25, 0.75, 0.95)]))
    agg = rows.agg(F.count(score).alias("rows"), F.avg(score).alias("mean"), q.alias("_q"), F.min(score).alias("min"), F.max(score).alias("max"))
    return agg.select("rows", "mean", *[F.col("_q")[i].alias(n) for i, n in enumerate(("median", "p05", "p25", "p75", "p95"))], "min", "max")


def score_by_group(rows: DataFrame, groups: list[str], score: str = "display") -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("member")) for g in groups])
    ex = rows.select(F.explode(pairs).alias("p"), F.col(score).alias("_s"))
    return ex.groupBy("p.grouping", "p.member").agg(
        F.count("_s").alias("count"), F.avg("_s").alias("mean"), F.percentile("_s", d(0.5)).alias("median"), F.min("_s").alias("min"), F.max("_s").alias("max"))


def topk_scores(rows: DataFrame, k: int = 20, score: str = "display", best: bool = True) -> DataFrame:
    """Top or bottom k of the batch (a bounded sort per task, then k rows)."""
    return rows.orderBy(F.desc(score) if best else F.asc(score), ID).limit(k)


def code_counts(rows: DataFrame, arrays: dict[str, str], top: int | None = None) -> DataFrame:
    """Counts of exploded codes per kind, all of them or the ``top`` most frequent of each."""
    parts = None
    for kind, col in arrays.items():
        part = rows.select(F.lit(kind).alias("kind"), F.explode(col).alias("code"))
        parts = part if parts is None else parts.unionByName(part)
    counts = parts.groupBy("kind", "code").agg(F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy("kind").orderBy(F.desc("rows"), "code")  # codes are a fixed list
    ranked = counts.withColumn("rank", F.row_number().over(w).cast("long"))
    return ranked if top is None else ranked.where(F.col("rank") <= top)
