"""Strategy against buy-and-hold of its asset over their common window."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pathscreen.functions.exprs import clip, d, INF, micros, MICROS_PER_DAY, NAN, pearson
from pathscreen.operators import ranges, scan
from pathscreen.operators.metrics import ID, TINY, calmar_expr, cagr_expr, ppy_expr
from pathscreen.staging import stage

ASSET = "asset_key"
MIN_OVERLAP_DAYS = 20.0


def one_return_per_time(returns: DataFrame) -> DataFrame:
    """Trades that close at the same time are compounded into one bar."""
    return returns.groupBy(ID, "ts").agg((F.product(d(1) + F.col("ret")) - d(1)).alias("ret"))


def asset_bars(prices: DataFrame, chunk: str = scan.CHUNK) -> DataFrame:
    """Closes with the return and the time of the previous bar."""
    rows = scan.running(prices.select(ASSET, "ts", "close"), [ASSET], ["ts"], chunk=chunk,
                        lags={"prev_close": "close", "prev_ts": "ts"})
    return rows.select(ASSET, "ts", "close", (F.try_divide("close", "prev_close") - d(1)).alias("aret"), "prev_ts")


def overlap_windows(returns: DataFrame, prices: DataFrame, mapping: DataFrame,
                    min_days: float = MIN_OVERLAP_DAYS) -> DataFrame:
    """Common time window per strategy; both sides are reduced to one row per key before they meet."""
    s = returns.groupBy(ID).agg(F.min("ts").alias("s_start"), F.max("ts").alias("s_end"))
    a = prices.groupBy(ASSET).agg(F.min("ts").alias("a_start"), F.max("ts").alias("a_end"))
    w = mapping.join(s, ID).join(a, ASSET)
    w = w.withColumn("lo", F.greatest("s_start", "a_start")).withColumn("hi", F.least("s_end", "a_end"))
    days = (micros("hi") - micros("lo")).cast("double") / d(MICROS_PER_DAY)
    full = (micros("s_end") - micros("s_start")).cast("double") / d(MICROS_PER_DAY)
    w = w.withColumn("overlap_days", days).withColumn("partial", days < d(0.95) * full)
    return w.where((F.col("hi") > F.col("lo")) & (F.col("overlap_days") >= d(min_days))).select(
        ID, ASSET, "lo", "hi", "overlap_days", "partial")


def strategy_side(returns: DataFrame, windows: DataFrame) -> DataFrame:
    """Strategy rows inside the window. A hot strategy is split by the adaptive skew join."""
    return returns.join(windows, ID).where("ts BETWEEN lo AND hi").select(ID, ASSET, "ts", "ret", "lo", "hi")


def asset_side(bars: DataFrame, windows: DataFrame) -> DataFrame:
    """Asset bars inside each strategy's window; the first bar of the window returns 0."""
    inside = bars.join(windows.select(ID, ASSET, "lo", "hi"), ASSET).where("ts BETWEEN lo AND hi")
    first = F.col("prev_ts").isNull() | (F.col("prev_ts") < F.col("lo"))
    return inside.select(ID, ASSET, "ts", "close", F.when(first, d(0)).otherwise(F.col("aret")).alias("ret"),
                         first.alias("is_first"))


def overlap_rows(returns: DataFrame, prices: DataFrame, mapping: DataFrame,
                 min_days: float = MIN_OVERLAP_DAYS) -> DataFrame:
    """Windows with the number of rows on both sides; short ones are dropped."""
    w = overlap_windows(returns, prices, mapping, min_days)
    s = strategy_side(returns, w).groupBy(ID).agg(F.count(F.lit(1)).alias("s_rows"))
    a = prices.join(w, ASSET).where("ts BETWEEN lo AND hi").groupBy(ID).agg(F.count(F.lit(1)).alias("a_rows"))
    return w.join(s, ID).join(a, ID).where("s_rows >= 3 AND a_rows >= 2")


def bar_returns(returns: DataFrame, bars: DataFrame, windows: DataFrame) -> DataFrame:
    """Inner join of both bar returns on (asset, ts) inside the window."""
    b = bars.where("prev_ts IS NOT NULL").select(ASSET, "ts", "aret", "prev_ts")
    return strategy_side(returns, windows).join(b, [ASSET, "ts"]).where("prev_ts >= lo").select(
        ID, ASSET, "ts", "ret", "aret")


def compare(returns: DataFrame, prices: DataFrame, mapping: DataFrame, *, bars: DataFrame | None = None,
            min_days: float = MIN_OVERLAP_DAYS, chunk: str = scan.CHUNK) -> DataFrame:
    """One row per strategy: totals, CAGR, drawdown, Calmar on both sides and the risk-adjusted gaps.

    The asset's bars are not copied per strategy (``ranges``); a strategy has one asset. Runs jobs."""
    returns = one_return_per_time(returns)
    bars = asset_bars(prices, chunk) if bars is None else bars
    w = stage(overlap_windows(returns, prices, mapping, min_days))
    s = scan.fold_path(scan.chunk_folds(strategy_side(returns, w), [ID], ["ts"], "ret", chunk), [ID])
    a = ranges.window_folds(bars.withColumnRenamed("aret", "ret"), w, ASSET, ID, "ret", chunk)
    s = s.where("n >= 3").select(ID, F.col("growth").alias("s_growth"), F.col("mdd").alias("strat_mdd"))
    a = a.where("n >= 2").select(ID, F.col("growth").alias("b_growth"), F.col("mdd").alias("bnh_mdd"))
    out = w.join(stage(s), ID).join(stage(a), ID)
    out = out.withColumn("years", F.greatest(F.col("overlap_days") / d(365.25), d(1e-9)))
    for side, g in (("strat", "s_growth"), ("bnh", "b_growth")):
        out = out.withColumn(f"{side}_total", F.col(g) - d(1))
        out = out.withColumn(f"{side}_cagr", F.when(F.col(g) > 0, F.pow(F.greatest(F.col(g), d(0)), d(1) / F.col("years")) - d(1)).otherwise(d(-1)))
        out = out.withColumn(f"{side}_calmar", F.when(F.col(f"{side}_mdd") < 0,
                             F.try_divide(F.col(f"{side}_cagr"), F.abs(f"{side}_mdd"))).otherwise(d(0)))
    out = out.withColumn("cal_alpha", F.col("strat_calmar") - F.col("bnh_calmar"))
    out = out.withColumn("ret_capture", F.try_divide("strat_total", "bnh_total"))
    out = out.withColumn("dd_reduction", F.when(F.col("bnh_mdd") < 0,
                         F.try_divide(F.abs("bnh_mdd") - F.abs("strat_mdd"), F.abs("bnh_mdd"))).otherwise(d(0)))
    return out.drop("s_growth", "b_growth")


def curves(returns: DataFrame, prices: DataFrame, mapping: DataFrame, chunk: str = scan.CHUNK) -> DataFrame:
    """Both curves in the window, rebased to their first value (long form)."""
    returns = one_return_per_time(returns)
    w = overlap_windows(returns, prices, mapping)
    s = scan.running(strategy_side(returns, w), [ID], ["ts"], chunk=chunk, compound="ret")
    a = scan.running(asset_side(asset_bars(prices, chunk), w), [ID], ["ts"], chunk=chunk, compound="ret")
    cols = [ID, "ts", "equity"]
    return (s.select(*cols).withColumn("side", F.lit("strategy"))
            .unionByName(a.select(*cols).withColumn("side", F.lit("hold"))))


def dependency_stats(joined: DataFrame, min_rows: int = 40) -> DataFrame:
    """Beta and correlation to the asset; groups that are short or flat have none."""
    agg = joined.groupBy(ID).agg(
        F.count(F.lit(1)).alias("observations"), pearson("ret", "aret").alias("corr"),
        F.covar_samp("ret", "aret").alias("_cov"), F.var_samp("aret").alias("_var"))
    return agg.where((F.col("observations") >= min_rows) & (F.col("_var") > 0)).select(
        ID, "observations", "corr", (F.col("_cov") / F.col("_var")).alias("beta"))
