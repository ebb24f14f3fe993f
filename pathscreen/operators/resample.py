"""Seeded resampling: moving-block bootstrap, Monte Carlo paths and random controls.

Every draw is a hash of (seed, strategy, simulation, position), so results do not depend on
partitioning, retries or row order. Returns must be above -100%, as the loader guarantees.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pathscreen.functions.exprs import as_uniform, clip, d, stream_key, with_hash
from pathscreen.operators import scan
from pathscreen.operators.benchmark import ASSET
from pathscreen.staging import stage
from pathscreen.operators.metrics import ID, cagr_expr, calmar_expr, path, ppy_expr

SEED = 12345
SALT_BOOT, SALT_PATH, SALT_BARS, SALT_EVENTS = 1, 2, 3, 4
TASK_ROWS = 500_000  # simulated bars of one task, about


def block_length(n: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.sqrt(n.cast("double")), 0).cast("long"))


def _id_type(df: DataFrame) -> str:
    return df.schema[ID].dataType.simpleString()


def _sized(p: DataFrame, with_ppy: bool = True) -> DataFrame:
    """Path rows with at least 10 observations and the annualization factor of their strategy."""
    spans = p.groupBy(ID).agg(F.max("n").alias("_n"), F.min("ts").alias("_s"), F.max("ts").alias("_e"))
    return spans.select(ID, F.col("_n").alias("n"), ppy_expr(F.col("_n"), "_s", "_e").alias("ppy")).where("n >= 10 AND ppy > 0")


# --- bootstrap --------------------------------------------------------------------------
def bootstrap_growth(p: DataFrame, sims: int = 1000, seed: int = SEED) -> DataFrame:
    """Growth of every resample (strategy_id, n, sim, growth) from path rows (idx, n, ret).

    A resample is a product of block growths, and a block growth is a difference of two running log
    sums, so a strategy needs sims * sqrt(n) lookups instead of sims * n values: the draws join the
    running sums on (strategy, idx).
    """
    return _bootstrap_rows(p.where("n >= 10").select(ID, "idx", "n", "ts", "ret"), sims, seed)


def _draws(sizes: DataFrame, sims: Column, seed: int, salt: int) -> DataFrame:
    """(strategy, n, sim, block number j, start, length) for every block of every resample."""
    b = block_length(F.col("n"))
    out = sizes.withColumn("b", b).withColumn("blocks", F.ceil(F.col("n") / F.col("b")))
    out = out.withColumn("_key", stream_key(F.col(ID), seed, salt))
    out = out.withColumn("sim", F.explode(F.sequence(F.lit(0).cast("long"), sims - 1)))
    out = with_hash(out, "_h", "_key", F.col("sim"))
    out = out.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    out = with_hash(out, "_h", "_h", F.col("j"))
    # never null, so no join on it pushes a null check (with the whole hash inlined) below the projections
    out = out.withColumn("start", F.coalesce(F.floor(as_uniform("_h") * (F.col("n") - F.col("b") + 1)), F.lit(0)))
    length = F.when(F.col("j") == F.col("blocks") - 1, F.col("n") - (F.col("blocks") - 1) * F.col("b")).otherwise(F.col("b"))
    return out.withColumn("len", length).drop("_key", "_h")


def _bootstrap_rows(rows: DataFrame, sims: int, seed: int) -> DataFrame:
    logs = scan.running(rows.withColumn("lg", F.log(F.greatest(d(1) + F.col("ret"), d(1e-300)))), [ID], ["ts", "idx"],
                        sums={"cum": "lg"}).select(ID, "idx", "cum")
    sizes = rows.select(ID, "n").groupBy(ID).agg(F.max("n").alias("n"))
    draws = _draws(sizes, F.lit(sims).cast("long"), seed, SALT_BOOT)
    ends = draws.select(ID, "n", "sim", F.explode(F.array(
        F.struct(F.col("start").alias("idx"), d(-1).alias("sign")),
        F.struct((F.col("start") + F.col("len")).alias("idx"), d(1).alias("sign")))).alias("e"))
    ends = ends.select(ID, "n", "sim", "e.idx", "e.sign")
    hit = ends.join(logs, [ID, "idx"], "left")  # idx 0 has no row: its running sum is 0
    return hit.groupBy(ID, "n", "sim").agg(
        F.exp(F.sum(F.col("sign") * F.coalesce(F.col("cum"), d(0)))).alias("growth")).select(
        ID, F.col("n").cast("long").alias("n"), F.col("sim").cast("long").alias("sim"), "growth")


def bootstrap_p5(p: DataFrame, sims: int = 1000, seed: int = SEED, ppy: DataFrame | None = None) -> DataFrame:
    """5th percentile of the annualized return over the resamples (``sims`` values per strategy)."""
    sized = _sized(p) if ppy is None else ppy
    g = bootstrap_growth(p, sims, seed)
    # a strategy has exactly ``sims`` values here, so the exact percentile is bounded
    j = g.join(sized.select(ID, "ppy").where("ppy > 0"), ID)
    year = cagr_expr(F.col("growth"), F.col("n"), F.col("ppy"))
    return j.groupBy(ID).agg(F.percentile(year, d(0.05)).alias("bootstrap_p5"))


# --- Monte Carlo -----------------------------------------------------------------------------
def _path_draws(rows: DataFrame, n_sims: int, seed: int) -> DataFrame:
    sizes = rows.groupBy(ID).agg(F.max("n").alias("n"))
    return _draws(sizes, F.lit(n_sims).cast("long"), seed, SALT_PATH)


def _drawn_blocks(rows: DataFrame, draws: DataFrame) -> DataFrame:
    """Rows (strategy, start, len, off, ret) of every block that some path uses, once for all paths that use it."""
    used = draws.select(ID, "start", "len").distinct()
    steps = used.withColumn("off", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1)))
    steps = steps.withColumn("idx", F.col("start") + F.col("off") + 1)
    # the planner does not see the fan-out: by the size of the strategies it would broadcast every step, here and every draw below
    return steps.hint("merge").join(rows.select(ID, "idx", "ret"), [ID, "idx"]).drop("idx")


def monte_carlo_sims(p: DataFrame, n_sims: int = 2000, seed: int = SEED) -> DataFrame:
    """(strategy_id, n, sim, growth, mdd): one row per simulated path.

    Blocks are folded once per start (at most 2 n sqrt(n) steps of a strategy, however many paths there are);
    a path then combines sqrt(n) block summaries.
    """
    rows = p.where("n >= 10").select(ID, "idx", "n", "ret")
    draws = _path_draws(rows, n_sims, seed)
    blocks = scan.chunk_folds(_drawn_blocks(rows, draws), [ID, "start", "len"], ["off"], "ret", F.lit(0)).drop("_chunk")
    folds = draws.select(ID, "sim", "start", "len", F.col("j").alias("_chunk")).hint("merge").join(blocks, [ID, "start", "len"])
    out = scan.fold_path(folds, [ID, "sim"])
    return out.select(ID, F.col("n").cast("long").alias("n"), F.col("sim").cast("long").alias("sim"), "growth", "mdd")


def monte_carlo(p: DataFrame, n_sims: int = 2000, seed: int = SEED) -> DataFrame:
    """Quantiles of final equity, annual return and drawdown, and the share of losing paths.

    Runs a job: the path rows are staged, as sizes, draws and blocks read them."""
    p = stage(p.select(ID, "idx", "n", "ts", "ret"))
    s = monte_carlo_sims(p, n_sims, seed).join(_sized(p).select(ID, "ppy"), ID)
    s = s.withColumn("cagr", cagr_expr(F.col("growth"), F.col("n"), F.col("ppy")))
    three = F.array(d(0.05), d(0.5), d(0.95))
    # at most n_sims values per strategy: the exact percentile is bounded
    out = s.groupBy(ID).agg(
        F.count(F.lit(1)).alias("n_sims"), F.percentile("growth", three).alias("_f"),
        F.percentile("cagr", three).alias("_c"), F.percentile("mdd", F.array(d(0.5), d(0.05))).alias("_d"),
        F.avg((F.col("growth") < 1).cast("double")).alias("prob_loss"))
    return out.select(
        ID, "n_sims", *[F.col(f"_{k}")[i].alias(f"{name}_{q}") for k, name in (("f", "final"), ("c", "cagr"))
                        for i, q in enumerate(("p5", "p50", "p95"))],
        F.col("_d")[0].alias("maxdd_p50"), F.col("_d")[1].alias("maxdd_worst5"), "prob_loss")


def mc_bands(p: DataFrame, n_sims: int = 2000, seed: int = SEED) -> DataFrame:
    """5/50/95% equity envelope per step (step 0 is the starting 1.0).

    The n-th blocks of all paths of a strategy meet in one group of n_sims rows with sqrt(n) values each. Runs a job,
    as ``monte_carlo`` does.
    """
    rows = stage(p.where("n >= 10").select(ID, "idx", "n", "ret"))
    draws = _path_draws(rows, n_sims, seed)
    inside = Window.partitionBy(ID, "start", "len").orderBy("off").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = _drawn_blocks(rows, draws).withColumn("_g", F.product(d(1) + F.col("ret")).over(inside))
    blocks = steps.groupBy(ID, "start", "len").agg(F.sort_array(F.collect_list(F.struct("off", "_g"))).alias("_s"))
    blocks = blocks.select(ID, "start", "len", F.col("_s._g").alias("curve"))
    before = Window.partitionBy(ID, "sim").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    drawn = draws.select(ID, "sim", "j", "b", "start", "len").hint("merge").join(blocks, [ID, "start", "len"])
    drawn = drawn.withColumn("base", F.coalesce(F.product(F.element_at("curve", -1)).over(before), d(1)))
    schema = f"{ID} {_id_type(p)}, step long, lo double, mid double, hi double"

    def band(pdf: pd.DataFrame) -> pd.DataFrame:
        equity = np.stack(pdf["curve"].to_list()) * pdf["base"].to_numpy()[:, None]
        lo, mid, hi = np.percentile(equity, [5, 50, 95], axis=0)
        step = pdf["j"].iloc[0] * pdf["b"].iloc[0] + 1 + np.arange(equity.shape[1])
        return pd.DataFrame({ID: pdf[ID].iloc[0], "step": step, "lo": lo, "mid": mid, "hi": hi})

    bands = drawn.select(ID, "j", "b", "base", "curve").groupBy(ID, "j").applyInPandas(band, schema)
    heads = rows.select(ID).distinct().select(ID, F.lit(0).cast("long").alias("step"), d(1).alias("lo"), d(1).alias("mid"), d(1).alias("hi"))
    return bands.unionByName(heads)


# --- random controls --------------------------------------------------------------------------
def _control_summary(sims: DataFrame, actual: DataFrame, min_sims: int = 1) -> DataFrame:
    """Random Calmar quantiles and the share of simulations at or above the strategy's own Calmar."""
    j = sims.where(~F.isnan("calmar") & (F.abs("calmar") < d(float("inf")))).join(actual, ID)
    # at most 512 simulations per strategy: the exact percentile is bounded
    out = j.groupBy(ID).agg(
        F.max("strat_calmar").alias("strat_calmar"), F.max("exposure").alias("exposure"), F.max("events").alias("random_events"),
        F.percentile("calmar", F.array(d(0.5), d(0.75), d(0.95))).alias("_q"),
        F.avg((F.col("calmar") >= F.col("strat_calmar")).cast("double")).alias("random_p"),
        F.count(F.lit(1)).alias("random_sims"), F.max("method").alias("method"))
    return out.where(F.col("random_sims") >= min_sims).select(
        ID, "exposure", "strat_calmar", F.col("_q")[0].alias("random_calmar_p50"), F.col("_q")[1].alias("random_calmar_p75"),
        F.col("_q")[2].alias("random_calmar_p95"), "random_p", "random_sims", "random_events", "method")


def bar_exposure(joined: DataFrame) -> DataFrame:
    """Per strategy: rows, ppy of the joined bars and the exposure clip(|beta|, 0.15, 1)."""
    agg = joined.groupBy(ID).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("_s"), F.max("ts").alias("_e"),
        F.covar_samp("ret", "aret").alias("_cov"), F.var_samp("aret").alias("_var"))
    agg = agg.where("n >= 120 AND _var > 0")
    return agg.select(ID, F.col("n").alias("bars"), ppy_expr(F.col("n"), "_s", "_e").alias("ppy"),
                      clip(F.abs(F.col("_cov") / F.col("_var")), 0.15, 1).alias("exposure"))


def positions(joined: DataFrame, sims: int = 128, seed: int = SEED, cost_bps: float = 2.0,
              chunk: str = scan.CHUNK, stats: DataFrame | None = None) -> DataFrame:
    """Random long/flat paths: position of each simulated bar, its turnover and its net return.

    The position of a bar is a hash of its row number, so the previous position needs no window; rows
    fan out after they were hashed on (strategy, chunk) and are never shuffled as simulations. Runs a job.
    """
    stats = stage(bar_exposure(joined)) if stats is None else stats
    bars = stats.agg(F.sum("bars")).first()[0] or 0  # one number
    rows = scan.running(joined, [ID], ["ts"], chunk=chunk, counts=True, keep_chunk=True)
    spine = rows.select(ID, "_chunk").distinct().join(stats, ID)  # one row per strategy and month
    # dealt by what a task makes of its rows: by their own bytes the adaptive planner would put them all into a few tasks
    rows = rows.join(spine, [ID, "_chunk"]).repartition(max(1, -(-bars * sims // TASK_ROWS)), ID, "_chunk")
    rows = rows.withColumn("_key", stream_key(F.col(ID), seed, SALT_BARS))
    rows = rows.withColumn("sim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sims - 1).cast("long"))))
    rows = with_hash(rows, "_sim", "_key", F.col("sim"))
    rows = with_hash(with_hash(rows, "_now", "_sim", F.col("idx")), "_last", "_sim", F.col("idx") - 1)
    rows = rows.withColumn("pos", (as_uniform("_now") < F.col("exposure")).cast("double"))
    rows = rows.withColumn("prev_pos", F.when(F.col("idx") > 1, (as_uniform("_last") < F.col("exposure")).cast("double")).otherwise(d(0)))
    rows = rows.drop("_key", "_sim", "_now", "_last")
    rows = rows.withColumn("turnover", F.abs(F.col("pos") - F.col("prev_pos")))
    return rows.withColumn("sim_ret", F.col("prev_pos") * F.col("aret") - F.col("turnover") * d(cost_bps / 10000.0))


def random_control_bars(joined: DataFrame, sims: int = 128, seed: int = SEED, cost_bps: float = 2.0,
                        chunk: str = scan.CHUNK) -> DataFrame:
    """Strategy Calmar against random long/flat exposure to the same asset bars.

    Simulated in chunks that never leave their task as rows.
    """
    joined = stage(joined)  # read by the exposure, by the simulations and by the strategy's own path
    stats = stage(bar_exposure(joined))
    pos = positions(joined, sims, seed, cost_bps, chunk, stats)
    folds = scan.chunk_folds(pos.drop("ret").withColumnRenamed("sim_ret", "ret"), [ID, "sim"], ["ts"], "ret", F.col("_chunk"))
    rand = stage(scan.fold_path(folds, [ID, "sim"]).select(ID, "n", "growth", "mdd"))  # one row per simulation
    own = scan.fold_path(scan.chunk_folds(joined, [ID], ["ts"], "ret", chunk), [ID]).join(stats, ID)
    own = own.select(ID, "ppy", "exposure", calmar_expr(cagr_expr(F.col("growth"), F.col("n"), F.col("ppy")), F.col("mdd")).alias("strat_calmar"),
                     F.lit(None).cast("long").alias("events"), F.lit("bar_long_flat").alias("method"))
    rand = rand.join(stats.select(ID, "ppy"), ID).select(
        ID, calmar_expr(cagr_expr(F.col("growth"), F.col("n"), F.col("ppy")), F.col("mdd")).alias("calmar"))
    return _control_summary(rand, stage(own))


def event_bars(asset_rows: DataFrame, chunk: str = scan.CHUNK) -> DataFrame:
    """Asset closes of each strategy's window with their row number; needs 30 positive bars."""
    rows = scan.running(asset_rows.select(ID, "ts", "close"), [ID], ["ts"], chunk=chunk, counts=True)
    bad = asset_rows.where(~(F.col("close") > 0)).select(ID).distinct()
    return rows.where("n >= 30").join(bad, ID, "left_anti").select(ID, "ts", "close", F.col("idx").alias("bar"), F.col("n").alias("bars"))


def event_draws(trades: DataFrame, bars: DataFrame, sims: int = 128, seed: int = SEED,
                chunk: str = scan.CHUNK) -> DataFrame:
    """Random entries with the same holding times: (strategy, sim, trade_no, exit_ts, ret)."""
    valid = trades.where("entry_ts <= exit_ts").select(ID, "trade_no", "exit_ts", (F.col("exit_ts") - F.col("entry_ts")).alias("hold"))
    enough = valid.groupBy(ID).agg(F.count(F.lit(1)).alias("events")).where("events >= 8")
    ends = bars.groupBy(ID).agg(F.max("ts").alias("last_ts"), F.max("bars").alias("bars"), F.max_by("close", "bar").alias("last_close"))
    t = valid.join(enough.join(ends, ID), ID)
    t = t.withColumn("_after", F.col("last_ts") - F.col("hold") + F.expr("INTERVAL '0.000001' SECOND"))
    t = stage(scan.first_at_or_after(stage(t), bars, ID, "_after", "ts", ["bar"], chunk))
    room = clip((F.coalesce(F.col("bar.bar") - 1, F.col("bars"))).cast("double"), d(1), (F.col("bars") - 1).cast("double"))
    t = t.withColumn("room", room).drop("bar", "_after").withColumn("_key", stream_key(F.col(ID), seed, SALT_EVENTS))
    t = t.withColumn("sim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sims - 1).cast("long"))))
    t = with_hash(with_hash(t, "_h", "_key", F.col("sim")), "_h", "_h", F.col("trade_no"))
    t = t.withColumn("bar", F.coalesce(F.floor(as_uniform("_h") * F.col("room")) + 1, F.lit(1)).cast("long")).drop("_key", "_h", "room")
    b = bars.select(ID, F.col("bar").cast("long").alias("bar"), F.col("ts").alias("start_ts"), F.col("close").alias("start_close"))
    # the planner does not see the fan-out: by the size of the trades it would broadcast every simulated entry
    t = t.hint("merge").join(b, [ID, "bar"]).drop("bar")
    # a later bar than the start one, even for a zero holding time
    t = t.withColumn("_target", F.greatest(F.col("start_ts") + F.col("hold"), F.col("start_ts") + F.expr("INTERVAL '0.000001' SECOND")))
    t = scan.first_at_or_after(stage(t), bars, ID, "_target", "ts", ["close"], chunk)
    end_close = F.coalesce(F.col("bar.close"), F.col("last_close"))
    return t.select(ID, "sim", "trade_no", "exit_ts", "events", (end_close / F.col("start_close") - d(1)).alias("ret"))


def random_control_events(trades: DataFrame, strategy_rows: DataFrame, asset_rows: DataFrame, ppy: DataFrame, sims: int = 128,
                          seed: int = SEED, chunk: str = scan.CHUNK) -> DataFrame:
    """Closed trades against random entries with the same holding times on the same asset.

    trades: (strategy_id, trade_no, entry_ts, exit_ts); strategy_rows and asset_rows: both sides inside
    the benchmark window; ppy: (strategy_id, ppy) of the trade log.
    """
    bars = stage(event_bars(asset_rows, chunk))
    valid = trades.where("entry_ts <= exit_ts")
    counts = valid.groupBy(ID).agg(F.count(F.lit(1)).alias("events")).where("events >= 8")
    sizes = stage(counts.join(bars.groupBy(ID).agg(F.max("bars").alias("_bars")), ID))
    draws = event_draws(trades.join(sizes.select(ID), ID, "left_semi"), bars.join(sizes.select(ID), ID, "left_semi"), sims, seed, chunk)
    folds = scan.chunk_folds(draws, [ID, "sim"], ["exit_ts", "trade_no"], "ret", chunk)
    rand = stage(scan.fold_path(folds, [ID, "sim"]).select(ID, "n", "growth", "mdd"))  # one row per simulation
    ppy = stage(ppy)
    rand = rand.join(ppy, ID).select(ID, calmar_expr(cagr_expr(F.col("growth"), F.col("n"), F.col("ppy")), F.col("mdd")).alias("calmar"))
    own = scan.fold_path(scan.chunk_folds(strategy_rows, [ID], ["ts"], "ret", chunk), [ID]).where("n >= 3").join(ppy, ID).join(sizes.select(ID, "events"), ID)
    own = own.select(ID, d(1).alias("exposure"), "events", F.lit("event_window").alias("method"),
                     calmar_expr(cagr_expr(F.col("growth"), F.col("n"), F.col("ppy")), F.col("mdd")).alias("strat_calmar"))
    return _control_summary(rand, stage(own), min_sims=32)


def random_control(closed: DataFrame, trades: DataFrame, strategy_rows: DataFrame, asset_rows: DataFrame, joined: DataFrame, ppy: DataFrame, sims: int = 128, seed: int = SEED,
                   cost_bps: float = 2.0, chunk: str = scan.CHUNK) -> DataFrame:
    """One control per strategy, by its own kind: closed trade logs (``closed``: their strategy_id) against random entries, all others, and logs whose trades or
    asset bars are too few for that, against random long/flat bars. Nobody is simulated twice.

    Other arguments as of ``random_control_events`` and ``random_control_bars``; the rows of trade logs and of plain returns stand in the same tables.
    """
    logs = stage(closed.select(ID).distinct())
    mine = lambda rows: rows.join(logs, ID, "left_semi")
    events = stage(random_control_events(mine(trades), mine(strategy_rows), mine(asset_rows), ppy, sims, seed, chunk))
    return events.unionByName(random_control_bars(joined.join(events.select(ID), ID, "left_anti"), sims, seed, cost_bps, chunk))
