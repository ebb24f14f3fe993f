"""Per-strategy metrics over returns(strategy_id, ts, ret)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pathscreen.functions.exprs import (
    CONFIDENCE_Z, INF, MICROS_PER_DAY, MICROS_PER_YEAR, NAN, clip, d, expected_max_z, first_when,
    micros, norm_cdf, pearson, trial_budget)
from pathscreen.operators import scan

ID = "strategy_id"
TINY = 1e-12
DEFAULT_PPY = 252.0


# --- paths ------------------------------------------------------------------------------
def path(returns: DataFrame, chunk: str = scan.CHUNK, order=("ts",), keys=(ID,)) -> DataFrame:
    """Returns with idx, n, prev (previous return), equity, peak and dd."""
    return scan.running(returns, keys, order, chunk=chunk, counts=True, lags={"prev": "ret"}, compound="ret")


def curve(returns: DataFrame, chunk: str = scan.CHUNK) -> DataFrame:
    """Equity with its leading 1.0 one bar before the first return (seq 0)."""
    rows = scan.running(returns, [ID], ["ts"], chunk=chunk, counts=True, compound="ret")
    heads = (
        rows.where("idx <= 2").groupBy(ID)
        .agg(F.min("ts").alias("t1"), F.max("ts").alias("t2"), F.max("n").alias("n"))
        .select(ID, F.lit(0).cast("long").alias("seq"),
                (F.col("t1") - (F.col("t2") - F.col("t1"))).alias("ts"), d(1).alias("equity"),
                d(1).alias("peak"), d(0).alias("dd"))
    )
    body = rows.select(ID, F.col("idx").cast("long").alias("seq"), "ts", "equity", "peak", "dd")
    return heads.unionByName(body)


def pct_change(levels: DataFrame, keys, ts: str, level: str, out: str = "ret",
               chunk: str = scan.CHUNK) -> DataFrame:
    """Simple return against the previous level; the first row of each group goes away."""
    rows = scan.running(levels, keys, [ts], chunk=chunk, lags={"_prev": level})
    return rows.where(F.col("_prev").isNotNull()).withColumn(out, F.try_divide(level, "_prev") - d(1)).drop("_prev")


# --- formulas over already aggregated columns -----------------------------------------------
def ppy_expr(n: Column, start: str, end: str) -> Column:
    years = span_years_expr(start, end)
    return F.when(years > 0, n / years).otherwise(d(DEFAULT_PPY))


def span_years_expr(start: str, end: str) -> Column:
    return (micros(end) - micros(start)).cast("double") / d(MICROS_PER_YEAR)


def cagr_expr(growth: Column, n: Column, ppy: Column) -> Column:
    return (F.when((n == 0) | (ppy <= 0), d(0)).when(growth <= 0, d(-1))
            .otherwise(F.pow(F.when(growth > 0, growth).otherwise(d(1)), ppy / n) - d(1)))


def sharpe_expr(mean: Column, sd: Column, n: Column, ppy: Column) -> Column:
    return F.when((n < 2) | sd.isNull() | (sd < TINY), d(0)).otherwise(F.try_divide(mean, sd) * F.sqrt(ppy))


def sortino_expr(mean: Column, downside_sq: Column, n: Column, ppy: Column) -> Column:
    return (F.when(n < 2, d(0))
            .when(downside_sq == 0, F.when(mean > 0, d(INF)).otherwise(d(0)))
            .otherwise(F.try_divide(mean, F.sqrt(downside_sq)) * F.sqrt(ppy)))


def calmar_expr(cagr: Column, mdd: Column) -> Column:
    return F.when(mdd >= 0, d(0)).otherwise(F.try_divide(cagr, F.abs(mdd)))


def profit_factor_expr(gains: Column, losses: Column) -> Column:
    return (F.when(losses == 0, F.when(gains > 0, d(INF)).otherwise(d(0)))
            .otherwise(F.try_divide(gains, losses)))


def per_period_sharpe(mean: Column, sd: Column, n: Column) -> Column:
    return F.when((n < 2) | sd.isNull() | (sd < TINY), d(0)).otherwise(F.try_divide(mean, sd))


def sharpe_se_expr(sr: Column, sd: Column, n: Column) -> Column:
    return (F.when((n < 2) | sd.isNull() | (sd < TINY), d(INF))
            .otherwise(F.sqrt((d(1) + d(0.5) * sr * sr) / n)))


# --- one pass of commutative aggregates -------------------------------------------------------
def base_aggs(ret: str = "ret", ts: str = "ts") -> list[Column]:
    r = F.col(ret)
    logs = F.greatest(F.log1p(F.greatest(r, d(-0.999999))), d(0))
    return [
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"),
        F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"),
        F.avg(F.pow(F.least(r, d(0)), d(2))).alias("downside_sq"),
        F.product(d(1) + r).alias("growth"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.sum(F.when(r > 0, r).otherwise(d(0))).alias("gains"),
        F.sum(F.when(r < 0, -r).otherwise(d(0))).alias("losses"),
        F.var_pop(r).alias("m2"), F.skewness(r).alias("skew0"), F.kurtosis(r).alias("kurt0"),
        F.sum(logs).alias("log_sum"), F.sum(logs * logs).alias("log_sq"), F.max(logs).alias("log_max"),
    ]


def derive_base(df: DataFrame, ppy: Column | None = None) -> DataFrame:
    """Metrics that follow from ``base_aggs`` columns alone."""
    n = F.col("n")
    out = df.withColumn("span_years", span_years_expr("start", "end"))
    out = out.withColumn("ppy", F.coalesce(ppy, ppy_expr(n, "start", "end")) if ppy is not None
                         else ppy_expr(n, "start", "end"))
    flat, ppy = F.col("m2") == 0, F.col("ppy")
    out = out.withColumns({
        "cagr": cagr_expr(F.col("growth"), n, ppy), "sharpe": sharpe_expr(F.col("mean"), F.col("sd"), n, ppy),
        "sortino": sortino_expr(F.col("mean"), F.col("downside_sq"), n, ppy),
        "profit_factor": profit_factor_expr(F.col("gains"), F.col("losses")),
        "sr": per_period_sharpe(F.col("mean"), F.col("sd"), n),
        "skew": F.when(flat, d(0)).otherwise(F.col("skew0")), "kurt": F.when(flat, d(3)).otherwise(F.col("kurt0") + d(3)),
        "eff_n": F.when(F.col("log_sum") > 0, F.try_divide(F.col("log_sum") * F.col("log_sum"), F.col("log_sq"))).otherwise(d(1)),
        "top1_share": F.when(F.col("log_sum") > 0, F.try_divide(F.col("log_max"), F.col("log_sum"))).otherwise(d(1))})
    return (
        out.withColumn("se", sharpe_se_expr(F.col("sr"), F.col("sd"), n))
        .drop("skew0", "kurt0", "m2", "log_sum", "log_sq", "log_max")
    )


def base_metrics(returns: DataFrame, keys=(ID,), ppy: Column | None = None) -> DataFrame:
    """CAGR, Sharpe, Sortino, win rate, profit factor, moments, concentration: one shuffle."""
    return derive_base(returns.groupBy(*keys).agg(*base_aggs()), ppy)


def drawdowns(returns: DataFrame, keys=(ID,), order=("ts",), chunk: str = scan.CHUNK) -> DataFrame:
    return scan.fold_path(scan.chunk_folds(returns, keys, order, "ret", chunk), list(keys))


def core_metrics(returns: DataFrame, chunk: str = scan.CHUNK) -> DataFrame:
    """The display set, with Calmar, drawdown and CVaR."""
    base = base_metrics(returns)
    mdd = drawdowns(returns, chunk=chunk).select(ID, "mdd")
    tail = tail_stats(returns).select(ID, "cvar")
    return (base.join(mdd, ID).join(tail, ID)
            .withColumn("calmar", calmar_expr(F.col("cagr"), F.col("mdd"))))


# --- significance ---------------------------------------------------------------------------
def with_psr(df: DataFrame, clip_positive_skew: bool = True) -> DataFrame:
    """Add denom, psr (null under 3 rows or without dispersion) from n, sd, sr, skew, kurt."""
    skew = F.least(F.col("skew"), d(0)) if clip_positive_skew else F.col("skew")
    sq = d(1) - skew * F.col("sr") + (F.col("kurt") - d(1)) / d(4) * F.col("sr") * F.col("sr")
    out = df.withColumn("_sq", sq)
    out = out.withColumn("denom", F.when((F.col("n") >= 3) & (F.col("sd") >= TINY),
                                         F.when(F.col("_sq") > TINY, F.sqrt(F.greatest(F.col("_sq"), d(TINY)))).otherwise(d(1e-6))))
    out = out.withColumn("_z", F.col("sr") * F.sqrt((F.col("n") - 1).cast("double")) / F.col("denom"))
    return out.withColumn("psr", norm_cdf(F.col("_z"))).drop("_sq")


def with_dsr(df: DataFrame, n_trials: Column) -> DataFrame:
    """Deflated Sharpe against the expected best of ``n_trials``, and the trial budget.

    Without a supplied trial variance the scatter of the trials is the squared standard error of the
    Sharpe itself, so the hurdle shifts the z value by the expected best z of the trials.
    """
    out = df.withColumn("_t", F.greatest(F.coalesce(n_trials, F.lit(1)), F.lit(1)).cast("long"))
    out = out.withColumn("_hurdle", expected_max_z(F.col("_t")))
    out = out.withColumn("_dz", F.col("_z") - F.col("_hurdle"))
    out = out.withColumn("dsr", norm_cdf(F.col("_dz")))
    out = out.withColumn("_margin", F.col("_z") - d(CONFIDENCE_Z))
    return out.withColumn("trial_budget", trial_budget(F.col("_margin"))).drop("_t", "_hurdle", "_dz", "_margin")


# --- rank statistics --------------------------------------------------------------------------
def drop_count(n: Column) -> Column:
    return F.greatest(F.lit(3), F.bround(d(0.05) * n, 0).cast("long"))


def tail_stats(returns: DataFrame, q: float = 0.05, k: int | None = None,
               resolution: int = scan.RESOLUTION) -> DataFrame:
    """CVaR of the worst q share and the growth kept after dropping the k largest returns."""
    rows = scan.ordered_values(returns.select(ID, "ret"), [ID], "ret", resolution)
    n, below, cnt, r = F.col("n"), F.col("below"), F.col("cnt"), F.col("ret")
    worst = F.greatest(F.lit(1), F.floor(d(q) * n))
    dropped = drop_count(n) if k is None else F.lit(k)
    taken = clip((worst - below).cast("double"), 0, cnt.cast("double"))
    kept = clip((n - dropped - below).cast("double"), 0, cnt.cast("double"))
    agg = rows.groupBy(ID).agg(
        F.max("n").alias("n"), F.max(worst).alias("tail_k"), F.max(dropped).alias("drop_k"),
        F.sum(r * taken).alias("_tail"),
        F.product(F.pow(d(1) + r, cnt)).alias("_full"),
        F.product(F.pow(d(1) + r, kept)).alias("_rest"))
    full, rest = F.col("_full"), F.col("_rest")
    keep = first_when(
        (n <= F.col("drop_k"), d(0)),
        (full <= 1, F.when(rest >= full, d(1)).otherwise(d(0))),
        (None, clip(F.try_divide(rest - d(1), full - d(1)), 0, 1)))
    return agg.select(ID, "n", "drop_k", (F.col("_tail") / F.col("tail_k")).alias("cvar"),
                      keep.alias("keep_after_drop"), rest.alias("growth_after_drop"))


# --- order-dependent counts ---------------------------------------------------------------------
def block_count(n: Column) -> Column:
    return F.least(n, F.least(F.lit(12), F.greatest(F.lit(4), F.floor(n / F.lit(30))))).cast("long")


def block_id(idx: Column, n: Column) -> Column:
    """0-based block of a 1-based row: the first n % k blocks are one row longer."""
    k = block_count(n)
    size = F.floor(n / k)
    extra = n % k
    i = idx - F.lit(1)
    head = extra * (size + F.lit(1))
    return F.when(i < head, F.floor(i / (size + F.lit(1)))).otherwise(
        extra + F.floor((i - head) / size)).cast("int")


def block_positive_share(p: DataFrame) -> DataFrame:
    """Share of equal-count blocks with a positive sum, from path rows."""
    blocks = (p.withColumn("_b", block_id(F.col("idx"), F.col("n")))
              .groupBy(ID, "_b").agg(F.sum("ret").alias("_s")))
    return blocks.groupBy(ID).agg(
        F.avg((F.col("_s") > 0).cast("double")).alias("block_pos_frac"),
        F.count(F.lit(1)).alias("n_blocks"))


def autocorr(p: DataFrame) -> DataFrame:
    agg = p.groupBy(ID).agg(F.max("n").alias("n"), F.stddev_samp("ret").alias("sd"),
                            pearson("ret", "prev").alias("_ac"))
    return agg.select(ID, "n", autocorr_expr(F.col("n"), F.col("sd"), F.col("_ac")).alias("autocorr"))


def autocorr_expr(n: Column, sd: Column, raw: Column) -> Column:
    return (F.when((n <= 3) | sd.isNull() | (sd < TINY) | raw.isNull() | F.isnan(raw), d(0)).otherwise(raw))


def split_cut(n: Column, share: float = 0.7) -> Column:
    return F.floor(d(share) * n)


def holdout(p: DataFrame) -> DataFrame:
    """Per-period Sharpe of the first 70% and the rest, with standard errors and the decay z."""
    cut = split_cut(F.col("n"))
    r, first = F.col("ret"), F.col("idx") <= cut
    out = p.groupBy(ID).agg(F.max("n").alias("n"), *[
        f(F.when(c, r)).alias(f"{name}_{part}")
        for part, c in (("tr", first), ("ho", ~first))
        for name, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_samp))])
    for part in ("tr", "ho"):
        cols = [F.col(f"{x}_{part}") for x in ("mean", "sd", "n")]
        out = out.withColumn(f"sr_{part}", per_period_sharpe(*cols))
        out = out.withColumn(f"se_{part}", sharpe_se_expr(F.col(f"sr_{part}"), cols[1], cols[2]))
    gap = F.sqrt(F.pow("se_tr", d(2)) + F.pow("se_ho", d(2)))
    return out.withColumn("z", F.when(gap > 0, (F.col("sr_tr") - F.col("sr_ho")) / gap).otherwise(d(0))).drop(
        "mean_tr", "sd_tr", "mean_ho", "sd_ho")


# --- calendar ---------------------------------------------------------------------------------
def months(returns: DataFrame, keys=(ID,)) -> DataFrame:
    """Sum, growth and rows per calendar month: bounded by the calendar, combined before the shuffle."""
    return returns.groupBy(*keys, F.trunc("ts", "month").alias("month")).agg(
        F.sum("ret").alias("sum_ret"), F.product(d(1) + F.col("ret")).alias("growth"),
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("start"), F.max("ts").alias("end"))


def max_month(m: DataFrame) -> DataFrame:
    """Best month. A month without rows compounds to 0, so a gap lifts an all-negative record to 0."""
    months_apart = F.round(F.months_between(F.max("month"), F.min("month"))).cast("long") + F.lit(1)
    best = F.max(F.col("growth") - d(1))
    return m.groupBy(ID).agg(
        F.when(months_apart > F.count(F.lit(1)), F.greatest(best, d(0))).otherwise(best).alias("max_month"))


def recurrence(m: DataFrame) -> DataFrame:
    """Share of year / quarter / month buckets that carry over 5% of positive profit, and the top share.

    Buckets without rows count as empty buckets; their number is calendar arithmetic.
    """
    spans = m.groupBy(ID).agg(F.min("start").alias("_s"), F.max("end").alias("_e"))
    whole_days = F.floor((micros("_e") - micros("_s")).cast("double") / d(MICROS_PER_DAY))
    years = F.greatest(whole_days / d(365.25), d(1e-9))
    unit = F.when(years >= 3, "year").when(years >= 1, "quarter").otherwise("month")
    spans = spans.select(F.col(ID).alias("_id"), unit.alias("unit"))
    per = F.when(F.col("unit") == "year", F.lit(12)).when(F.col("unit") == "quarter", F.lit(3)).otherwise(F.lit(1))
    number = F.floor((F.year("month") * F.lit(12) + F.month("month") - F.lit(1)) / per)
    buckets = (m.join(spans, F.col(ID) == F.col("_id"))
               .groupBy(ID, "unit", number.alias("bucket"))
               .agg(F.greatest(F.sum("sum_ret"), d(0)).alias("gain")))
    # the number of buckets of one strategy is bounded by the calendar
    share = F.try_divide(F.col("gain"), F.sum("gain").over(Window.partitionBy(ID)))
    return (
        buckets.withColumn("share", share).groupBy(ID, "unit")
        .agg((F.max("bucket") - F.min("bucket") + F.lit(1)).alias("n_blocks"),
             F.sum("gain").alias("_tot"), F.max("share").alias("_top"),
             F.sum((F.col("share") > 0.05).cast("double")).alias("_hits"))
        .select(ID, "unit", "n_blocks",
                F.when(F.col("_tot") <= 0, d(0)).otherwise(F.col("_hits") / F.col("n_blocks")).alias("recurrence"),
                F.when(F.col("_tot") <= 0, d(1)).otherwise(F.col("_top")).alias("top_block_share"))
    )


def daily_compound(returns: DataFrame, keys=(ID,), ts: str = "ts") -> DataFrame:
    """One return per day. The return of a day with a single row stays as it is: 1 + ret - 1 would lose its last digits."""
    made = F.product(d(1) + F.col("ret")) - d(1)
    return returns.groupBy(*keys, F.to_date(ts).alias("day")).agg(
        F.when(F.count(F.lit(1)) == 1, F.max("ret")).otherwise(made).alias("ret"), F.count(F.lit(1)).alias("rows"))


# --- splits -----------------------------------------------------------------------------------
def segment_metrics(p: DataFrame, segment: Column, chunk: str = scan.CHUNK, order=("ts",)) -> DataFrame:
    """Return, drawdown and Sharpe of each segment of a path, annualized with the full-path ppy."""
    rows = p.withColumn("segment", segment)
    base = rows.groupBy(ID, "segment").agg(*base_aggs())
    mdd = scan.fold_path(scan.chunk_folds(rows, [ID, "segment"], list(order), "ret", chunk), [ID, "segment"])
    joined = base.join(mdd.select(ID, "segment", "mdd"), [ID, "segment"])
    whole = p.groupBy(ID).agg(F.max("n").alias("_wn"), F.min("ts").alias("_ws"), F.max("ts").alias("_we"))
    whole = whole.select(ID, F.col("_wn").alias("total_n"), ppy_expr(F.col("_wn"), "_ws", "_we").alias("_ppy"))
    out = derive_base(joined.join(whole, ID), F.col("_ppy"))
    return out.withColumn("calmar", calmar_expr(F.col("cagr"), F.col("mdd"))).drop("_ppy")


def oos_gate(p: DataFrame, chunk: str = scan.CHUNK, order=("ts",)) -> DataFrame:
    """Train against the last 30%; only strategies with at least 264 rows have one."""
    eligible = p.where("n >= 264")
    seg = F.when(F.col("idx") <= split_cut(F.col("n")), "train").otherwise("oos")
    s = segment_metrics(eligible, seg, chunk, order)

    def pick(part, c):
        return F.max(F.when(F.col("segment") == part, F.col(c)))

    out = s.groupBy(ID).agg(
        pick("train", "calmar").alias("train_calmar"), pick("oos", "calmar").alias("oos_calmar"),
        pick("oos", "cagr").alias("oos_cagr"), pick("oos", "sharpe").alias("oos_sharpe"),
        pick("oos", "mdd").alias("oos_mdd"), pick("train", "n").alias("train_n"), pick("oos", "n").alias("oos_n"))
    out = out.where("train_n >= 120 AND oos_n >= 80")
    return out.withColumn("oos_train_ratio", F.when(F.col("train_calmar") > 0,
                          F.try_divide("oos_calmar", "train_calmar")).otherwise(d(NAN)))


def recent_cut(n: Column) -> Column:
    """Rows before the recent third."""
    return F.greatest(F.floor(n * d(0.67)), n - F.greatest(F.lit(40), F.floor(n * d(0.33))))
