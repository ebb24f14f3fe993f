"""Windows by sparse table against a walk over each window's bars."""
import numpy as np
import pandas as pd
import pytest
from conftest import frame
from pyspark.sql import functions as F

from pathscreen.operators import ranges


def walked(bars, windows):
    out = {}
    for name, key, lo, hi in windows:
        r = bars[(bars.key == key) & (bars.ts >= lo) & (bars.ts <= hi)].sort_values("ts").ret.fillna(0).to_numpy()
        if len(r):
            eq = np.concatenate(([1.0], np.cumprod(1 + r[1:])))
            out[name] = (len(r), round(eq[-1], 9), round((eq / np.maximum.accumulate(eq) - 1).min(), 9))
    return out


@pytest.mark.parametrize("unit", ["month", "day", "hour"])
def test_windows_of_every_length(spark, unit):
    rng = np.random.default_rng(7)
    rows = []
    for key, step in (("a", 17), ("b", 3)):
        at = pd.Timestamp("2020-01-05")
        for k in range(300):
            at += pd.Timedelta(hours=int(rng.integers(1, step * 4))) + (pd.Timedelta(days=100) if k in (60, 200) else pd.Timedelta(0))
            rows.append((key, at, None if k == 0 else float(rng.normal(0, 0.05))))
    bars = pd.DataFrame(rows, columns=["key", "ts", "ret"])
    ends = [pd.Timestamp("2019-01-01"), pd.Timestamp("2024-01-01"), *bars.ts[rng.integers(0, 600, 60)], *(bars.ts[rng.integers(0, 600, 40)] + pd.Timedelta(minutes=30))]
    windows = [(i, "ab"[i % 2], *sorted((ends[rng.integers(0, len(ends))], ends[rng.integers(0, len(ends))]))) for i in range(150)] + [(900, "none", ends[0], ends[1])]
    got = ranges.window_folds(frame(spark, bars), frame(spark, pd.DataFrame(windows, columns=["name", "key", "lo", "hi"])), "key", "name", "ret", unit)
    assert {r.name: (r.n, round(r.growth, 9), round(r.mdd, 9)) for r in got.select(F.col("name").alias("name"), "n", "growth", "mdd").collect()} == walked(bars, windows)


def test_no_bars_and_other_units(spark):
    none = spark.createDataFrame([], "key string, ts timestamp_ntz, ret double")
    windows = spark.createDataFrame([], "name long, key string, lo timestamp_ntz, hi timestamp_ntz")
    assert ranges.window_folds(none, windows, "key", "name", "ret").count() == 0
    with pytest.raises(ValueError):
        ranges.chunk_number("ts", "week")
