"""Scores, gates, caps, evidence and grade: one row per strategy, Column logic only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pathscreen.functions.exprs import clip, d, display_score, first_when, lin, overfit_index, pearson, sat
from pathscreen.operators import metrics as M, resample, scan
from pathscreen.operators.metrics import ID
from pathscreen.plans import dims
from pathscreen.staging import stage

# Thresholds of the public rules.
MIN_SPLIT_ROWS = 150
HARD_CAP, SOFT_CAP, EXPERIENCE_CAP = 59.0, 87.0, 79.0
GOLD, SILVER, BRONZE = 88.0, 80.0, 60.0
MIN_YEARS, MIN_EFF_N_TIER, MIN_EFF_N = 2.0, 10.0, 5.0
BENCH_LOST, BENCH_MATCH, RANDOM_HARD_P, RANDOM_SOFT_P, PSR_FLOOR = 40.0, 50.0, 0.20, 0.05, 0.90


def feature_table(p: DataFrame, *, order=("ts",), chunk: str = scan.CHUNK, sims: int = 1000,
                  seed: int = resample.SEED, bootstrap: DataFrame | None = None) -> DataFrame:
    """Everything the rules need, one row per strategy, from path rows (see ``metrics.path``).

    Order-free aggregates, split statistics and blocks share one aggregation; ranks, calendar buckets,
    the out-of-sample path and the bootstrap have their own. All meet as one row per strategy.
    Pass staged path rows: several branches read them. Runs a job per branch: planned as one, the adaptive
    planner would plan all that is left again after each of its stages, in the driver.
    """
    r, idx, n = F.col("ret"), F.col("idx"), F.col("n")
    first = idx <= M.split_cut(n)
    recent = idx > M.recent_cut(n)
    aggs = M.base_aggs()
    aggs += [F.least(d(0), F.min("dd")).alias("mdd"), pearson("ret", "prev").alias("_ac")]
    for part, cond in (("tr", first), ("ho", ~first), ("re", recent), ("pr", ~recent)):
        kept = F.when(cond, r)
        aggs += [F.count(kept).alias(f"n_{part}"), F.avg(kept).alias(f"mean_{part}"), F.stddev_samp(kept).alias(f"sd_{part}")]
    for part, cond in (("re", recent), ("pr", ~recent)):
        aggs.append(F.product(F.when(cond, d(1) + r).otherwise(d(1))).alias(f"growth_{part}"))
    rows = p.withColumn("_blk", M.block_id(idx, n))
    aggs += [F.sum(F.when(F.col("_blk") == b, r)).alias(f"_b{b}") for b in range(12)]
    out = M.derive_base(rows.groupBy(ID).agg(*aggs))
    for part in ("tr", "ho"):
        cols = [F.col(f"{x}_{part}") for x in ("mean", "sd", "n")]
        out = out.withColumn(f"sr_{part}", M.per_period_sharpe(*cols))
        out = out.withColumn(f"se_{part}", M.sharpe_se_expr(F.col(f"sr_{part}"), cols[1], cols[2]))
    for part in ("re", "pr"):
        cols = [F.col(f"{x}_{part}") for x in ("mean", "sd", "n")]
        out = out.withColumn(f"sharpe_{part}", M.sharpe_expr(*cols, F.col("ppy")))
        out = out.withColumn(f"cagr_{part}", M.cagr_expr(F.col(f"growth_{part}"), cols[2], F.col("ppy")))
    gap = F.sqrt(F.col("se_tr") * F.col("se_tr") + F.col("se_ho") * F.col("se_ho"))
    positive = sum((F.when(F.col(f"_b{b}") > 0, d(1)).otherwise(d(0)) for b in range(12)), d(0))
    n_col = F.col("n")
    out = (
        out.withColumn("z", F.when(gap > 0, (F.col("sr_tr") - F.col("sr_ho")) / gap).otherwise(d(0)))
        .withColumn("block_pos_frac", positive / M.block_count(n_col))
        .withColumn("autocorr", M.autocorr_expr(n_col, F.col("sd"), F.col("_ac")))
        .withColumn("calmar", M.calmar_expr(F.col("cagr"), F.col("mdd")))
        .drop("_ac", *[f"_b{b}" for b in range(12)], *[f"{x}_{q}" for x in ("mean", "sd") for q in ("tr", "ho", "re", "pr")])
    )
    out = stage(M.with_psr(out))
    m = stage(M.months(p))
    parts = [
        M.tail_stats(p).select(ID, "cvar", "keep_after_drop", "drop_k"),
        M.max_month(m), M.recurrence(m).select(ID, "recurrence", "top_block_share"),
        M.oos_gate(p, chunk, order).select(ID, "oos_cagr", "oos_calmar", "oos_mdd", "oos_sharpe"),
        resample.bootstrap_p5(p, sims, seed) if bootstrap is None else bootstrap,
    ]
    for t in parts:
        out = out.join(stage(t), ID, "left")
    return out


# --- pillars ------------------------------------------------------------------------------
def with_pillars(f: DataFrame) -> DataFrame:
    """Sub-scores from features, profile anchors and ``is_trade_log``; see ``score_unified``."""
    c = F.col
    pen = clip((c("top_block_share") - c("conc_tolerance")) / (d(1) - c("conc_tolerance")), 0, 1)
    f = f.withColumn("_pen", pen)
    rec = F.least(d(1.5) * c("recurrence"), d(1)) * (d(1) - d(0.5) * c("_pen"))
    keep = F.when(c("_pen") > 0, c("keep_after_drop")).otherwise(d(1))
    f = f.withColumn("robustness", d(65) * rec + d(35) * keep)
    decayed = c("z") > 1.64
    overfit = decayed & (c("sr_ho") < 0)
    degr = first_when((overfit, F.greatest(d(0), d(1) - (c("z") - d(1.64)) / d(3))),
                      (decayed, F.greatest(d(0.5), d(1) - (c("z") - d(1.64)) / d(6))), (None, d(1)))
    split = c("n") >= MIN_SPLIT_ROWS
    f = f.withColumns({"consistency": F.when(split, d(50) * c("block_pos_frac") + d(50) * degr),
                       "overfit_suspect": F.coalesce(split & overfit, F.lit(False)), "too_good_codes": F.array_compact(F.array(
        F.when(~c("is_trade_log") & (c("autocorr") > 0.30), F.lit("STALE_OR_INTERPOLATED")),
        F.when(c("sharpe") > c("sharpe_absurd"), F.lit("SHARPE_TOO_GOOD")),
        F.when((c("win_rate") > 0.90) & (F.abs("mdd") < 0.03), F.lit("NEAR_MONOTONIC")))),
        "background_codes": F.array_compact(F.array(
        F.when((c("span_years") >= 1.5) & (c("cagr") > 1), F.lit("BACKGROUND_CAGR")),
        F.when(c("calmar") > 10, F.lit("BACKGROUND_CALMAR")),
        F.when(c("growth") > 50, F.lit("BACKGROUND_GROWTH")),
        F.when(c("max_month") > 1, F.lit("BACKGROUND_EXTREME_MONTH"))))})
    k = F.size("too_good_codes")
    f = f.withColumns({"too_good": k > 0, "plausibility": F.when(k == 0, d(99)).otherwise(F.greatest(d(5), d(100) - d(35) * k)),
                       "subscore_flags": F.array_compact(F.array(
        F.when((c("top_block_share") > 0.6) & (c("recurrence") < 0.25), F.lit("ONE_OFF_EDGE")),
        F.when(~split, F.lit("INSUFFICIENT_FOR_SPLIT")), F.when(c("overfit_suspect"), F.lit("OVERFIT_SUSPECT_HOLDOUT")),
        F.when(c("eff_n") < MIN_EFF_N, F.lit("EDGE_FROM_FEW_TRADES"))))})
    weight = F.when(c("consistency").isNull(), d(0.65)).otherwise(d(1))
    cred = (d(0.45) * c("robustness") + d(0.20) * c("plausibility") + d(0.35) * F.coalesce("consistency", d(0))) / weight
    rq = d(65) * sat(c("sharpe"), c("sharpe50")) + d(35) * sat(c("sortino"), c("sortino50"))
    recovery = F.when(c("mdd") < 0, F.try_divide(c("growth") - d(1), F.abs("mdd"))).otherwise(d(0))
    risk = (d(50) * (d(1) - sat(F.abs("mdd"), c("mdd50"))) + d(30) * sat(recovery, c("rec50"))
            + d(20) * (d(1) - sat(F.abs("cvar"), c("cvar50"))))
    f = f.withColumns({"return_quality_raw": rq, "credibility_raw": cred, "risk_raw": risk})
    shown = {}
    for name, cap in (("return_quality", 50), ("credibility", 28), ("risk", 99)):
        capped = F.when(c("too_good"), F.least(c(f"{name}_raw"), d(cap))).otherwise(c(f"{name}_raw"))
        shown[name] = F.least(capped, d(99))
    f = f.withColumns({f"_{name}": x for name, x in shown.items()})
    f = f.withColumns({name: display_score(c(f"_{name}")) for name in shown}).drop(*[f"_{name}" for name in shown])
    bp5 = F.when(c("bootstrap_p5").isNull() | F.isnan("bootstrap_p5"), d(0.5)).when(c("bootstrap_p5") > 0, d(1)).otherwise(lin(c("bootstrap_p5"), -0.2, 0))
    n_min = c("n_min").cast("double")
    stat = (d(40) * F.coalesce("psr", d(0.5)) + d(25) * bp5 + d(20) * lin(c("eff_n"), 3, 20)
            + d(15) * lin(c("n").cast("double"), n_min, n_min * d(4)))
    ddr = clip(c("dd_reduction"), -1, 1)
    edge = d(60) * (d(0.5) + d(0.5) * F.tanh(c("cal_alpha") / d(2))) + d(40) * (d(0.5) + d(0.5) * ddr)
    return f.withColumns({"statistical_confidence": stat, "edge_score": F.when(c("cal_alpha").isNotNull(), edge)}).drop("_pen")


def score_unified(features: DataFrame, meta: DataFrame, profiles: DataFrame, benchmark: DataFrame | None = None,
                  control: DataFrame | None = None) -> DataFrame:
    """The full rule set.

    meta: (strategy_id, caliber, profile, n_trials, forward_looking, unit_suspect); benchmark: rows of
    ``benchmark.compare``; control: rows of a random control. Missing benchmark or control rows mean the
    evidence is not available.
    """
    c = F.col
    f = features.join(meta, ID)
    if benchmark is not None:
        f = f.join(stage(benchmark.select(ID, "cal_alpha", "dd_reduction", "ret_capture", F.col("partial").alias("bench_partial"),
                                          F.col("strat_calmar").alias("window_calmar"), "bnh_calmar")), ID, "left")
    else:
        f = f.withColumns({name: F.lit(None).cast("double") for name in (
            "cal_alpha", "dd_reduction", "ret_capture", "window_calmar", "bnh_calmar")})
        f = f.withColumn("bench_partial", F.lit(None).cast("boolean"))
    if control is not None:
        f = f.join(stage(control.select(ID, "random_p", "random_sims", "random_events", F.col("method").alias("random_method"))), ID, "left")
    else:
        f = f.withColumns({"random_p": F.lit(None).cast("double"), "random_sims": F.lit(None).cast("long"),
                           "random_events": F.lit(None).cast("long"), "random_method": F.lit(None).cast("string")})
    f = f.withColumns({"is_trade_log": F.coalesce(c("caliber") == "closed_trade", F.lit(False)),
                       "n_trials": F.greatest(F.coalesce("n_trials", F.lit(1)), F.lit(1))})
    # one row per strategy: each part of the rules plans over a plain scan, as one plan they take the driver more memory than all else
    f = stage(dims.join_profile(f, profiles))
    f = stage(with_pillars(f))
    f = stage(M.with_dsr(f, c("n_trials")).withColumn("effective_n", F.bround("eff_n", 1)))
    return stage(_verdict(stage(_gates(f))))  # consumers explode and filter plain columns


def _gates(f: DataFrame) -> DataFrame:
    c = F.col
    searched = c("n_trials") > 1
    overall = d(0.35) * c("return_quality") + d(0.40) * c("credibility") + d(0.25) * c("risk")
    penalty = F.when(searched, F.least(d(18), d(3) * F.log10(c("n_trials").cast("double")))).otherwise(d(0))
    thin = (c("span_years") < 1) | (c("effective_n") < MIN_EFF_N)
    per_year = F.when(c("span_years") > 0, c("n") / c("span_years")).otherwise(c("n").cast("double"))
    has_bench, has_rc = c("edge_score").isNotNull(), c("random_p").isNotNull() & c("edge_score").isNotNull()
    luck = F.coalesce(c("psr") < PSR_FLOOR, F.lit(False)) | F.coalesce(c("bootstrap_p5") < 0, F.lit(False))
    f = f.withColumns({
        "uncapped": F.bround(clip(overall - penalty, 0, 99), 1),
        "sample_hard": F.coalesce(F.when(c("is_trade_log"), thin).otherwise(thin | (c("n") < c("n_min"))), F.lit(False)),
        "low_frequency": c("is_trade_log") & ((c("n") < 100) | (per_year < 50)),
        "benchmark_available": has_bench, "random_available": has_rc, "edge_light": first_when(
        (~has_bench & luck, "luck_unclear"), (~has_bench, "not_evaluated"), (c("edge_score") < BENCH_LOST, "lost"),
        (c("random_p") > RANDOM_HARD_P, "random_fail"), (~has_rc, "hold_only"),
        ((c("edge_score") < BENCH_MATCH) | (c("random_p") > RANDOM_SOFT_P), "marginal"), (None, "beat"))})
    light = c("edge_light")
    oos_lost = F.coalesce(c("oos_cagr") <= 0, F.lit(False))
    dsr_fail = searched & F.coalesce(c("dsr") < 0.5, F.lit(False))
    dsr_soft = searched & F.coalesce((c("dsr") >= 0.5) & (c("dsr") < 0.95), F.lit(False))
    seasoned = (c("cagr") > 0) & ~c("sample_hard")
    short = seasoned & (c("span_years") < MIN_YEARS)
    few = seasoned & ~(c("span_years") < MIN_YEARS) & F.coalesce(c("effective_n") < MIN_EFF_N_TIER, F.lit(False))
    f = f.withColumns({"oos_lost": oos_lost, "dsr_fail": dsr_fail, "dsr_soft": dsr_soft, "short_record": short, "few_effective": few})

    def codes(*pairs):
        return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in pairs]))

    return f.withColumns({"hard": codes(
        (c("forward_looking"), "FORWARD_LOOKING_INPUT"), (c("cagr") <= 0, "NEGATIVE_RETURN"), (c("sample_hard"), "INSUFFICIENT_SAMPLE"),
        (c("oos_lost"), "OOS_NEGATIVE_RETURN"), (light == "lost", "UNDERPERFORMS_HOLD_RISKADJ"),
        (light == "random_fail", "RANDOM_CONTROL_NOT_BEATEN"), (c("dsr_fail"), "DSR_FAIL")), "soft": codes(
        (light == "marginal", "RANDOM_CONTROL_WEAK_EDGE"), (light == "hold_only", "RANDOM_CONTROL_UNAVAILABLE"),
        (light == "luck_unclear", "EDGE_HARD_TO_DISTINGUISH_FROM_LUCK"), (light == "not_evaluated", "EDGE_NOT_EVALUATED"),
        (c("dsr_soft"), "DSR_OVERFIT_RISK")),
        "experience": codes((c("short_record"), "SHORT_TRACK_RECORD"), (c("few_effective"), "LOW_EFFECTIVE_SAMPLE"))})


def _flags() -> Column:
    """Flags in the order of the rules, one entry per code, with the numbers of their message."""
    c = F.col

    def num(col, digits=1):
        return F.format_string(f"%.{digits}f", col)

    def flag(cond, code, severity, *args):
        item = F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"),
                        F.array(*args).cast("array<string>").alias("args"))
        return F.when(cond, item)

    def has(array, code):
        return F.array_contains(array, code)

    light = c("edge_light")
    return F.array_compact(F.array(
        flag(c("n_trials") > 1, "MULTIPLE_TESTING_PENALTY", "info", c("n_trials").cast("string")),
        flag(has("too_good_codes", "STALE_OR_INTERPOLATED"), "STALE_OR_INTERPOLATED", "warn", num(c("autocorr"), 2)),
        flag(has("too_good_codes", "SHARPE_TOO_GOOD"), "SHARPE_TOO_GOOD", "warn", num(c("sharpe"))),
        flag(has("too_good_codes", "NEAR_MONOTONIC"), "NEAR_MONOTONIC", "warn", num(c("win_rate") * 100, 0), num(c("mdd") * 100)),
        flag(c("too_good"), "TOO_GOOD_TO_BE_TRUE", "warn"),
        flag(c("forward_looking"), "FORWARD_LOOKING_INPUT", "warn"),
        flag(c("unit_suspect"), "RETURN_UNIT_SUSPECT", "info"),
        flag(F.size("background_codes") > 0, "BACKGROUND_REQUIRED", "info"),
        flag(has("background_codes", "BACKGROUND_CAGR"), "BACKGROUND_CAGR", "info", num(c("cagr") * 100, 0), num(c("span_years"))),
        flag(has("background_codes", "BACKGROUND_CALMAR"), "BACKGROUND_CALMAR", "info", num(c("calmar"), 0)),
        flag(has("background_codes", "BACKGROUND_GROWTH"), "BACKGROUND_GROWTH", "info", num(c("growth"), 0)),
        flag(has("background_codes", "BACKGROUND_EXTREME_MONTH"), "BACKGROUND_EXTREME_MONTH", "info", num(c("max_month") * 100, 0)),
        flag(c("cagr") <= 0, "NEGATIVE_RETURN", "warn"),
        flag(c("sample_hard"), "INSUFFICIENT_SAMPLE", "warn", c("n").cast("string"), num(c("span_years"))),
        flag(~c("sample_hard") & c("low_frequency"), "LOW_FREQUENCY", "info", c("n").cast("string"), num(c("span_years"))),
        flag(c("oos_lost"), "OOS_NEGATIVE_RETURN", "warn"),
        flag(light == "lost", "UNDERPERFORMS_HOLD_RISKADJ", "warn"),
        flag(light == "random_fail", "RANDOM_CONTROL_NOT_BEATEN", "warn", num(c("random_p"), 4)),
        flag(light == "marginal", "RANDOM_CONTROL_WEAK_EDGE", "warn", num(c("random_p"), 4)),
        flag(light == "hold_only", "RANDOM_CONTROL_UNAVAILABLE", "info"),
        flag(light == "luck_unclear", "EDGE_HARD_TO_DISTINGUISH_FROM_LUCK", "info"),
        flag(c("overfit_suspect"), "OVERFIT_SUSPECT_HOLDOUT", "warn"),
        flag(c("dsr_fail"), "DSR_FAIL", "warn", c("n_trials").cast("string"), num(c("dsr"), 2)),
        flag(c("dsr_soft"), "DSR_OVERFIT_RISK", "warn", c("n_trials").cast("string"), num(c("dsr"), 2)),
        flag(c("short_record"), "SHORT_TRACK_RECORD", "info", num(c("span_years")), F.lit("2")),
        flag(c("few_effective"), "LOW_EFFECTIVE_SAMPLE", "info", num(c("effective_n"), 0))))


def _verdict(f: DataFrame) -> DataFrame:
    c = F.col
    f = f.withColumn("flags", _flags())
    failed, soft, exp = F.size("hard") > 0, F.size("soft") > 0, F.size("experience") > 0
    cap = F.when(c("too_good") | failed, d(HARD_CAP)).otherwise(F.least(
        d(99), F.when(soft, d(SOFT_CAP)).otherwise(d(99)), F.when(exp, d(EXPERIENCE_CAP)).otherwise(d(99))))
    f = f.withColumn("display", F.bround(F.least(c("uncapped"), cap), 1))
    f = f.withColumn("capped", c("display") < c("uncapped") - d(0.05))
    f = f.withColumn("judgement", first_when((c("too_good"), "FLAGGED"), (failed, "CAUTION"), (None, "OK")))
    f = f.withColumn("candidate_tier", F.when(c("display") >= GOLD, "GOLD").when(c("display") >= SILVER, "SILVER").when(c("display") >= BRONZE, "BRONZE"))
    comparable = c("benchmark_available") & ~F.coalesce("bench_partial", F.lit(False))
    f = f.withColumn("benchmark_comparable", comparable)
    eligible = ((c("judgement") == "OK") & c("benchmark_comparable") & c("random_available") & (c("edge_light") == "beat")
                & ~c("sample_hard") & ~exp)
    f = f.withColumn("metal_eligible", eligible)
    f = f.withColumn("evidence_status", first_when((c("too_good") | failed, "insufficient"), (c("metal_eligible"), "qualified"), (None, "provisional")))
    f = f.withColumn("evidence_reasons", F.array_compact(F.array(
        F.when(~c("benchmark_available"), F.lit("BENCHMARK_MISSING")),
        F.when(c("benchmark_available") & ~c("benchmark_comparable"), F.lit("BENCHMARK_UNAVAILABLE")),
        F.when(c("benchmark_available") & ~c("random_available"), F.lit("RANDOM_CONTROL_UNAVAILABLE")),
        F.when(c("sample_hard"), F.lit("SAMPLE_TOO_SMALL")), F.when(c("span_years") < MIN_YEARS, F.lit("SHORT_TRACK_RECORD")),
        F.when(c("effective_n") < MIN_EFF_N_TIER, F.lit("LOW_EFFECTIVE_SAMPLE")),
        F.when(c("edge_light").isin("marginal", "luck_unclear", "not_evaluated", "hold_only"), F.lit("EDGE_NOT_ESTABLISHED")))))
    f = f.withColumn("tier", F.when(c("metal_eligible"), c("candidate_tier")))
    f = f.withColumn("grade", first_when(
        (c("judgement") == "FLAGGED", "FLAGGED"), (c("judgement") == "CAUTION", "NEEDS WORK"),
        (c("evidence_status") == "provisional", "PROVISIONAL"), (None, F.coalesce(c("tier"), F.lit("NEEDS WORK")))))
    light = c("edge_light")
    f = f.withColumn("headline", first_when(
        (c("too_good"), "TOO_GOOD"), (c("cagr") <= 0, "NOT_PROFITABLE"), (light == "lost", "LOST_TO_HOLD"),
        (light == "random_fail", "RANDOM_TIMING"), (c("dsr_fail"), "SEARCH_LUCK"), (c("sample_hard"), "SAMPLE_SMALL"),
        (c("oos_lost"), "LATE_LOSS"), ((light == "beat") & exp, "BEAT_BUT_YOUNG"), (light == "beat", "BEAT"),
        (light == "hold_only", "HOLD_ONLY"), (light == "marginal", "MARGINAL"), (light == "luck_unclear", "LUCK_UNCLEAR"), (None, "ADD_ASSET")))
    f = f.withColumn("cap_reasons", F.concat("hard", "soft", "experience"))
    return f.withColumn("overfit_risk", F.bround(overfit_index(c("credibility")), 1))


def distinct_flags(flags: DataFrame) -> DataFrame:
    """One row per (strategy, code)."""
    return flags.dropDuplicates([ID, "code"])
