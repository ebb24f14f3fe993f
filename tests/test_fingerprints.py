"""Correlations by blocked products against one pair at a time."""
import numpy as np
import pandas as pd
import pytest
from conftest import frame

from pathscreen.operators import assetmatch as A


def series(rng, n, key, value, extra):
    days = pd.date_range("2019-12-20", periods=150, freq="D")
    rows = []
    for k in range(n):
        keep = np.sort(rng.choice(150, rng.integers(40, 140), replace=False))
        rows += [(k if key == "strategy_id" else f"A{k}", days[i], v) for i, v in zip(keep, rng.normal(0.01, 0.02, len(keep)))]
    return pd.DataFrame(rows + extra(days), columns=[key, "day", value])


@pytest.mark.parametrize(("block", "days"), [(256, 4096), (2, 7), (1, 1000)])
def test_blocks_against_single_pairs(spark, block, days):
    rng = np.random.default_rng(3)
    s = series(rng, 7, "strategy_id", "ret", lambda t: [(50, x, 0.01) for x in t] + [(51, t[0], float("nan")), (52, t[0], None)])
    a = series(rng, 5, "asset_key", "aret", lambda t: [("flat", x, 0.3) for x in t] + [("same", x, 5.0 + i) for i, x in enumerate(t)])
    got = {(r.strategy_id, r.asset_key): (r.overlap, r["corr"]) for r in A.fingerprints(*(f.selectExpr(k, "CAST(day AS date) day", v) for f, k, v in (
        (frame(spark, s), "strategy_id", "ret"), (frame(spark, a), "asset_key", "aret"))), 60, block, days).collect()}
    want = {}
    for i, x in s.dropna().groupby("strategy_id"):
        for k, y in a.groupby("asset_key"):
            both = x.merge(y, on="day")
            if len(both) >= 60 and both.ret.nunique() > 1 and both.aret.nunique() > 1:
                want[i, k] = (len(both), np.corrcoef(both.ret, both.aret)[0, 1])
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_no_rows(spark):
    s, a = spark.createDataFrame([], "strategy_id string, day date, ret double"), spark.createDataFrame([], "asset_key string, day date, aret double")
    assert A.fingerprints(s, a).count() == 0
