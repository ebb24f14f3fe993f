import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pathscreen.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("8", 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    return s


def frame(spark, pdf: pd.DataFrame):
    """Spark frame with zone-less timestamps."""
    df = spark.createDataFrame(pdf)
    for name, kind in df.dtypes:
        if kind == "timestamp":
            df = df.withColumn(name, df[name].cast("timestamp_ntz"))
    return df


def record(n=400, seed=1, sid=1, mean=0.001, sd=0.01, start="2020-01-01", freq="D") -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"strategy_id": sid, "ts": pd.date_range(start, periods=n, freq=freq), "ret": rng.normal(mean, sd, n)})
