"""Triage, dependency, risk tags, advice and routing from score rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pathscreen.functions.exprs import d, first_when
from pathscreen.operators.metrics import ID
from pathscreen.plans.dims import SOFT_EDGE


def with_persistence(f: DataFrame) -> DataFrame:
    """Recent third against the earlier sample (needs the ``re``/``pr`` feature columns)."""
    c = F.col
    ok = (c("n") >= 120) & (c("n_pr") >= 60) & (c("n_re") >= 40)
    delta = c("sharpe_re") - c("sharpe_pr")
    label = first_when((~ok, "unavailable"), ((c("cagr_re") <= 0) | (delta <= -1), "deteriorating"), (delta <= -0.35, "weakening"), (None, "stable"))
    f = f.withColumn("persistence", label)
    return f.withColumn("persistence_score", F.when(c("persistence") == "deteriorating", 35).when(c("persistence") == "weakening", 60)
                        .when(c("persistence") == "stable", 80).cast("long"))


def with_evidence(f: DataFrame) -> DataFrame:
    c = F.col
    points = (F.when(c("n") >= 500, 2).when(c("n") >= 120, 1).otherwise(0)
              + F.when(c("span_years") >= 2, 2).when(c("span_years") >= 1, 1).otherwise(0)
              + c("benchmark_available").cast("int") + (~c("is_trade_log")).cast("int"))
    f = f.withColumn("evidence_points", points.cast("long"))
    p = c("evidence_points")
    f = f.withColumn("evidence_level", first_when((p >= 5, "high"), (p >= 3, "medium"), (p >= 2, "limited"), (None, "low")))
    return f.withColumn("evidence_score", F.least(F.lit(100), p * 18))


def dependency(stats: DataFrame) -> DataFrame:
    """Label of the correlation to the held asset: high means very dependent."""
    a = F.abs("corr")
    return stats.withColumn("dependency", first_when((a < 0.25, "low"), (a < 0.55, "medium"), (None, "high")))


def triage(score: DataFrame, bench_dependency: DataFrame | None = None, trade_dependency: DataFrame | None = None) -> DataFrame:
    """Persistence, evidence, dependency (trade concentration first, else correlation) and the next step."""
    f = with_evidence(with_persistence(score))
    empty = F.lit(None).cast("string")
    if bench_dependency is not None:
        f = f.join(bench_dependency.select(ID, F.col("dependency").alias("_bd"), "corr", "beta"), ID, "left")
    else:
        f = f.withColumn("_bd", empty).withColumn("corr", F.lit(None).cast("double")).withColumn("beta", F.lit(None).cast("double"))
    if trade_dependency is not None:
        f = f.join(trade_dependency.select(ID, F.col("dependency").alias("_td"), "diversification", "top3_share"), ID, "left")
    else:
        f = f.withColumn("_td", empty).withColumn("diversification", empty).withColumn("top3_share", F.lit(None).cast("double"))
    is_tl = F.col("is_trade_log")
    f = f.withColumn("dependency", F.when(is_tl, F.col("_td")).otherwise(F.col("_bd")))
    f = f.withColumn("dependency_type", F.when(F.col("dependency").isNull(), "unavailable").when(is_tl, "trade_dependency_scan").otherwise("benchmark_beta_lite"))
    c = F.col
    return f.withColumn("next_step", first_when(
        (c("evidence_status") != "qualified", "collect_evidence"),
        ((F.abs("mdd") >= 0.25) | (c("risk") < 80), "overlay"), (None, "pro"))).drop("_bd", "_td")


def mc_verdict(mc: DataFrame) -> DataFrame:
    c = F.col
    return mc.withColumn("mc_level", first_when(
        (c("maxdd_worst5") <= -0.75, "high"), ((c("cagr_p5") < 0) | (d(1) - c("prob_loss") < 0.75), "medium"),
        (c("maxdd_worst5") <= -0.45, "medium"), (None, "low")))


def _level(x):
    return F.when(x.isNull(), "medium").when(x < 55, "high").when(x < 72, "medium").otherwise("low")


def risk_tags(t: DataFrame) -> DataFrame:
    """Five low/medium/high tags from triage rows."""
    c = F.col
    codes = F.transform("flags", lambda x: x["code"])

    def any_of(*names):
        return F.arrays_overlap(codes, F.array(*[F.lit(n) for n in names]))

    base = _level(c("credibility"))
    overfit = (F.when(any_of("TOO_GOOD_TO_BE_TRUE", "DSR_FAIL", "OOS_NEGATIVE_RETURN"), "high")
               .when(any_of("DSR_OVERFIT_RISK", "OVERFIT_SUSPECT_HOLDOUT", "LOW_EFFECTIVE_SAMPLE") & (base == "low"), "medium").otherwise(base))
    sample = (F.when(any_of("INSUFFICIENT_SAMPLE", "SHORT_TRACK_RECORD", "LOW_EFFECTIVE_SAMPLE") | c("sample_hard"), "high")
              .when(c("evidence_level").isin("low", "limited"), "medium").when(c("span_years") >= 2, "low").otherwise("medium"))
    drawdown = _level(c("risk"))
    tail = F.when(F.abs("mdd") >= 0.35, "high").when((F.abs("mdd") >= 0.20) & (drawdown == "low"), "medium").otherwise(drawdown)
    return t.select(ID, drawdown.alias("drawdown_risk"), _level(c("return_quality")).alias("stability_risk"), overfit.alias("overfit_tag"),
                    sample.alias("sample_risk"), tail.alias("tail_risk"))


def coaching(score: DataFrame, advice: DataFrame) -> DataFrame:
    """Up to three issues by priority and the tone of the closing line. Flags per strategy are a fixed list."""
    rows = score.select(ID, "judgement", F.explode("flags.code").alias("code")).join(advice, "code").dropDuplicates([ID, "code"])
    rk = F.row_number().over(Window.partitionBy(ID).orderBy("priority"))
    soft = F.bool_or(F.col("code").isin(*SOFT_EDGE))
    tops = rows.withColumn("rank", rk)
    per = tops.groupBy(ID).agg(
        soft.alias("_soft"),
        F.sort_array(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "code", "problem", "direction")))).alias("issues"))
    out = score.select(ID, "grade", "judgement").join(per, ID, "left")
    tone = F.when((F.col("judgement") == "OK") & F.coalesce("_soft", F.lit(False)), "OK_SOFT").otherwise(F.col("judgement"))
    return out.withColumn("tone", tone).withColumn("issues", F.coalesce("issues", F.array().cast(per.schema["issues"].dataType))).drop("_soft")


def route(t: DataFrame, mc: DataFrame | None = None) -> DataFrame:
    """Which follow-up fits: first matching rule wins."""
    c = F.col
    if mc is not None:
        t = t.join(mc.select(ID, "maxdd_worst5"), ID, "left")
    else:
        t = t.withColumn("maxdd_worst5", F.lit(None).cast("double"))
    high = F.coalesce(c("dependency") == "high", F.lit(False))
    deep = (F.abs("mdd") * 100 >= 40) | F.coalesce(F.abs("maxdd_worst5") * 100 >= 60, F.lit(False))
    trade_dep = c("dependency_type") == "trade_dependency_scan"
    kind = first_when(
        ((c("edge_light") == "random_fail") | F.coalesce(c("random_p") > 0.2, F.lit(False)), "pro"),
        (trade_dep & high, "pro"), ((c("display") >= 75) & deep, "overlay"),
        (high | ((c("display") >= 60) & (c("display") < 82) & (c("edge_light") == "marginal")), "exposure"),
        (c("display") < 60, "coaching"), (None, "pro"))
    return t.withColumn("route", kind)
