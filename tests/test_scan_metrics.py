import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from conftest import frame, record
from pathscreen.functions import exprs as X
from pathscreen.operators import metrics as M, scan


def rows(df, *order):
    return df.orderBy(*order).toPandas()


def two(spark):
    return pd.concat([record(400, 1, 1), record(151, 2, 2, -0.002, 0.02, freq="9h")])


def test_path_is_the_same_for_every_chunk_and_input_order(spark):
    pdf = two(spark)
    base = rows(M.path(frame(spark, pdf)), "strategy_id", "ts")
    for chunk in ("year", "day", "hour"):
        other = rows(M.path(frame(spark, pdf.sample(frac=1, random_state=3)).repartition(7), chunk), "strategy_id", "ts")
        assert (other.idx == base.idx).all() and (other.n == base.n).all()
        np.testing.assert_allclose(other[["equity", "peak", "dd"]], base[["equity", "peak", "dd"]], rtol=1e-12)
    for sid, g in pdf.groupby("strategy_id"):
        eq = np.cumprod(1 + g.ret.to_numpy())
        mine = base[base.strategy_id == sid]
        np.testing.assert_allclose(mine.equity, eq, rtol=1e-12)
        np.testing.assert_allclose(mine.dd, eq / np.maximum(np.maximum.accumulate(eq), 1) - 1, atol=1e-12)
        np.testing.assert_allclose(mine.prev.iloc[1:], g.ret.to_numpy()[:-1])


def test_folded_drawdown_equals_the_path(spark):
    df = frame(spark, two(spark))
    a = rows(M.drawdowns(df, chunk="day"), "strategy_id")
    b = rows(M.path(df).groupBy("strategy_id").agg(F.least(F.lit(0.0), F.min("dd")).alias("mdd")), "strategy_id")
    np.testing.assert_allclose(a.mdd, b.mdd, atol=1e-12)


def test_quantiles_and_tail_with_ties(spark):
    pdf = two(spark)
    pdf.loc[pdf.ret.abs() < 0.004, "ret"] = 0.0
    df = frame(spark, pdf)
    for res in (1, 16, 512):
        q = rows(scan.exact_quantiles(df, ["strategy_id"], "ret", {"a": 0.05, "b": 0.5, "c": 0.937}, res), "strategy_id")
        t = rows(M.tail_stats(df, resolution=res), "strategy_id")
        for i, (_, g) in enumerate(pdf.groupby("strategy_id")):
            np.testing.assert_allclose(q.loc[i, ["a", "b", "c"]].astype(float), np.quantile(g.ret, [0.05, 0.5, 0.937]), atol=1e-14)
            s = np.sort(g.ret.to_numpy())
            assert math.isclose(t.cvar[i], s[:max(1, int(0.05 * len(s)))].mean(), rel_tol=1e-12)
            k = max(3, round(0.05 * len(s)))
            full, rest = np.prod(1 + s), np.prod(1 + s[:-k])
            want = (1.0 if rest >= full else 0.0) if full <= 1 else min(max((rest - 1) / (full - 1), 0), 1)
            assert math.isclose(t.keep_after_drop[i], want, abs_tol=1e-12)


def test_first_at_or_after_against_search(spark):
    rng = np.random.default_rng(5)
    bars = pd.DataFrame({"asset_key": "A", "ts": pd.to_datetime("2021-01-01") + pd.to_timedelta(np.sort(rng.choice(900, 60, False)), "D")})
    bars["close"] = np.arange(60.0)
    targets = pd.DataFrame({"asset_key": "A", "k": range(300), "target": pd.to_datetime("2020-10-01") + pd.to_timedelta(rng.integers(0, 1100, 300), "D")})
    out = rows(scan.first_at_or_after(frame(spark, targets), frame(spark, bars), "asset_key", "target", "ts", ["close"]).select("k", "bar.close"), "k")
    at = np.searchsorted(bars.ts.to_numpy(), targets.target.to_numpy())
    want = [float(i) if i < 60 else None for i in at]
    assert [None if pd.isna(x) else x for x in out.close] == want


def test_degenerate_series_abstain(spark):
    pdf = pd.DataFrame({"strategy_id": 1, "ts": pd.date_range("2020-01-01", periods=300), "ret": 0.001})
    noisy = pdf.assign(strategy_id=2, ret=0.001 + 1e-19 * np.arange(300))
    out = M.with_dsr(M.with_psr(M.base_metrics(frame(spark, pd.concat([pdf, noisy])))), F.lit(5)).toPandas()
    assert (out.sharpe == 0).all() and np.isinf(out.se).all()
    assert out.psr.isna().all() and out.dsr.isna().all() and out.trial_budget.isna().all()
    assert np.isinf(out.sortino).all()
    assert (M.autocorr(M.path(frame(spark, pdf))).toPandas().autocorr == 0).all()


def test_normal_distribution_and_trial_budget(spark):
    xs = np.concatenate([np.linspace(-9, 9, 181), [0.0, 1e-9]])
    df = spark.createDataFrame(pd.DataFrame({"x": xs})).select("x", X.norm_cdf(F.col("x")).alias("p")).toPandas()
    np.testing.assert_allclose(df.p, [0.5 * math.erfc(-x / math.sqrt(2)) for x in df.x], rtol=1e-9, atol=1e-15)
    margins = spark.createDataFrame([(m,) for m in (-0.1, 0.0, 0.4, 1.3, 2.2, 3.1, 9.0)], "m double")
    got = margins.select("m", X.trial_budget(F.col("m")).alias("b")).toPandas()
    grid = spark.range(1, 3000).select(F.col("id").alias("k"), X.expected_max_z(F.col("id")).alias("z")).toPandas().sort_values("k")
    assert (np.diff(grid.z) >= 0).all()
    for m, b in zip(got.m, got.b):
        if m < 0:
            assert b == 0
        elif b < 2999:
            assert b == int((grid.z <= m).sum())
    assert got.b.iloc[-1] == X.TRIALS_CAP


def test_recurrence_counts_empty_buckets(spark):
    ts = pd.to_datetime(["2020-01-05", "2020-01-20", "2020-05-10", "2020-11-02"])
    pdf = pd.DataFrame({"strategy_id": 1, "ts": ts, "ret": [0.1, 0.02, -0.05, 0.3]})
    out = M.recurrence(M.months(frame(spark, pdf))).toPandas().iloc[0]
    assert out.unit == "month" and out.n_blocks == 11
    assert math.isclose(out.recurrence, 2 / 11) and math.isclose(out.top_block_share, 0.3 / 0.42)


def test_blocks_match_array_split(spark):
    pdf = record(101, 4)
    out = M.block_positive_share(M.path(frame(spark, pdf))).toPandas().iloc[0]
    want = np.mean([b.sum() > 0 for b in np.array_split(pdf.ret.to_numpy(), 4)])
    assert math.isclose(out.block_pos_frac, want)


def test_leading_point_of_the_curve(spark):
    c = M.curve(frame(spark, record(5))).orderBy("seq").toPandas()
    assert c.equity[0] == 1.0 and len(c) == 6 and c.ts[0] == pd.Timestamp("2019-12-31")


def test_crowded_value_buckets_are_divided(spark):
    """Epoch seconds and levels near 1 each fall in one or two buckets; their parts stay small and the order exact."""
    v = np.concatenate([1.7e9 + 3600.0 * np.arange(5000), 1 + np.arange(3000) / 1e6, -1.7e9 - 60.0 * np.arange(1000), [np.inf, 0.0]])
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "v": v}))
    rows = scan.ordered_values(df, ["k"], "v", full=200).toPandas().sort_values("v")
    assert rows.below.tolist() == list(range(len(v))) and (rows.n == len(v)).all()
    got = scan.exact_quantiles(df.where("v < 1e300"), ["k"], "v", {"m": 0.5, "q": 0.9}).first()
    assert np.allclose([got.m, got.q], np.quantile(v[np.isfinite(v)], [0.5, 0.9]), rtol=0, atol=1e-6)
