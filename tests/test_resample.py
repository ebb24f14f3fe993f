import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from conftest import frame, record
from pathscreen.operators import benchmark as B, metrics as M, resample as R
from pathscreen.staging import stage


def paths_one_by_one(key, ret, sims):
    """Equity of every simulated path, from the same draws hash by hash."""
    mask, gold = 0xFFFFFFFF, 2654435761

    def mix(x):
        for _ in range(2):
            x = ((x ^ (x >> 16)) * 73244475) & mask
        return x ^ (x >> 16)

    n = len(ret)
    block = max(1, round(math.sqrt(n)))
    stream = int(hashlib.md5(f"{R.SEED}:{R.SALT_PATH}:{key}".encode()).hexdigest()[:8], 16)
    out = []
    for sim in range(sims):
        own, picked = mix((stream + sim * gold) & mask), []
        for j in range(-(-n // block)):
            start = math.floor(mix((own + j * gold) & mask) / 4294967296.0 * (n - block + 1))
            picked.extend(ret[start:start + block])
        out.append(np.cumprod(1 + np.array(picked[:n])))
    return np.array(out)


def test_monte_carlo_equals_one_path_at_a_time(spark):
    pdf = pd.concat([record(90, 1, 1), record(47, 2, 2), record(9, 3, 3)])
    p = stage(M.path(frame(spark, pdf)))
    assert R.bootstrap_p5(p, 64).count() == 2
    sims = R.monte_carlo_sims(p, 40).toPandas()
    total, bands = R.monte_carlo(p, 40).toPandas().set_index("strategy_id"), R.mc_bands(p, 40).toPandas()
    assert sorted(total.index) == sorted(bands.strategy_id.unique()) and len(total) == 2
    for key in total.index:
        equity = paths_one_by_one(key, pdf[pdf.strategy_id == key].sort_values("ts").ret.to_numpy(), 40)
        peak = np.maximum(np.maximum.accumulate(equity, axis=1), 1)
        one = sims[sims.strategy_id == key].sort_values("sim")
        assert (one.n == equity.shape[1]).all()
        np.testing.assert_allclose(one.growth, equity[:, -1], atol=1e-9)
        np.testing.assert_allclose(one.mdd, np.minimum((equity / peak - 1).min(axis=1), 0), atol=1e-9)
        np.testing.assert_allclose(total.final_p50[key], np.median(equity[:, -1]), atol=1e-9)
        band = bands[bands.strategy_id == key].sort_values("step")
        assert list(band.step) == list(range(equity.shape[1] + 1)) and (band.iloc[0][["lo", "mid", "hi"]] == 1).all()
        np.testing.assert_allclose(band[["lo", "mid", "hi"]].to_numpy()[1:], np.percentile(equity, [5, 50, 95], axis=0).T, atol=1e-9)


def test_results_do_not_depend_on_partitioning(spark):
    pdf = record(120, 3, 7)
    a = R.bootstrap_p5(M.path(frame(spark, pdf)), 50).toPandas()
    b = R.bootstrap_p5(M.path(frame(spark, pdf.sample(frac=1)).repartition(5), "day"), 50).toPandas()
    np.testing.assert_allclose(a.bootstrap_p5, b.bootstrap_p5, rtol=1e-9)


def test_bootstrap_distribution_is_like_numpy(spark):
    pdf = record(300, 5)
    p = M.path(frame(spark, pdf))
    ours = R.bootstrap_p5(p, 2000).toPandas().bootstrap_p5[0]
    rng, arr, n, b = np.random.default_rng(0), pdf.ret.to_numpy(), 300, 17
    starts = rng.integers(0, n - b + 1, size=(2000, 18))
    sims = arr[(starts[:, :, None] + np.arange(b)).reshape(2000, -1)[:, :n]]
    ppy = 300 / (299 / 365.25)
    theirs = np.percentile(np.prod(1 + sims, axis=1) ** (ppy / n) - 1, 5)
    assert abs(ours - theirs) < 0.03


def market(spark, n=400):
    t = np.arange(n)
    px = pd.DataFrame({"asset_key": "A", "ts": pd.date_range("2020-01-01", periods=n), "close": 100 * np.cumprod(1 - 0.0002 + 0.002 * np.sin(t / 9))})
    return frame(spark, px), frame(spark, pd.DataFrame({"strategy_id": [1], "asset_key": ["A"]}))


def test_bar_control_needs_120_bars(spark):
    px, mp = market(spark)
    pdf = record(400, 6)
    for n, available in ((90, False), (400, True)):
        ret = frame(spark, pdf.head(n))
        joined = B.bar_returns(ret, B.asset_bars(px), B.overlap_windows(ret, px, mp))
        out = R.random_control_bars(joined, sims=32).toPandas()
        assert (len(out) == 1) is available
        if available:
            assert out.random_sims[0] == 32 and 0 <= out.random_p[0] <= 1


def trades(spark, n=46):
    start = pd.date_range("2020-01-03", periods=n, freq="8D")
    rng = np.random.default_rng(2)
    return frame(spark, pd.DataFrame({"strategy_id": 1, "trade_no": range(1, n + 1), "entry_ts": start, "exit_ts": start + pd.to_timedelta(rng.integers(0, 7, n), "D"), "ret": rng.normal(0.01, 0.02, n)}))


def test_event_control(spark):
    px, mp = market(spark)
    t = trades(spark)
    ret = B.one_return_per_time(t.select("strategy_id", F.col("exit_ts").alias("ts"), "ret"))
    w = B.overlap_windows(ret, px, mp)
    args = (t, B.strategy_side(ret, w), B.asset_side(B.asset_bars(px), w), spark.createDataFrame([(1, 45.0)], "strategy_id long, ppy double"))
    out = R.random_control_events(*args, sims=64).toPandas()
    assert out.random_sims[0] == 64 and out.random_events[0] == 46 and out.method[0] == "event_window"


def test_simulated_entries_are_not_broadcast(spark, monkeypatch):
    px, mp = market(spark)
    t, plans = trades(spark), []
    ret = B.one_return_per_time(t.select("strategy_id", F.col("exit_ts").alias("ts"), "ret"))
    bars = stage(R.event_bars(B.asset_side(B.asset_bars(px), B.overlap_windows(ret, px, mp))))

    def staged(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df)

    monkeypatch.setattr(R, "stage", staged)
    assert R.event_draws(t, bars, 16).count() == 46 * 16
    fanned = [plan for plan in plans if "explode" in plan]
    assert len(fanned) == 1 and "SortMergeJoin" in fanned[0] and "Broadcast" not in fanned[0]


def test_drawn_steps_and_paths_are_not_broadcast(spark):
    p = stage(M.path(frame(spark, record(90, 1, 1))))
    for out in (R.monte_carlo_sims(p, 40), R.mc_bands(p, 40)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan


def test_partial_overlap_is_marked(spark):
    px, mp = market(spark, 200)
    out = B.compare(frame(spark, record(400, 6)), px, mp).toPandas()
    assert out.partial[0]


def test_simulated_bars_are_dealt_by_their_number(spark, monkeypatch):
    ret = pd.concat([record(150, 1, 1), record(150, 2, 2)]).assign(asset_key="a")
    joined = stage(frame(spark, ret.assign(aret=ret.ret * 0.5 + 0.001)))
    whole = R.random_control_bars(joined, 16).toPandas().sort_values("strategy_id")
    monkeypatch.setattr(R, "TASK_ROWS", 500)
    pos = R.positions(joined, 16)
    assert "REPARTITION_BY_NUM" in pos._jdf.queryExecution().executedPlan().toString() and pos.rdd.getNumPartitions() == 10  # 300 bars x 16 / 500
    split = R.random_control_bars(joined, 16).toPandas().sort_values("strategy_id")
    assert np.allclose(whole[["strat_calmar", "random_calmar_p50", "random_p"]], split[["strat_calmar", "random_calmar_p50", "random_p"]])
