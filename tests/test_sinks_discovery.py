import math

import pandas as pd
from pyspark.sql import functions as F

from conftest import frame
from pathscreen.operators import metrics as M
from pathscreen.sources import files as FI, sinks


def test_number_text_rounds_the_exact_binary_value(spark):
    values = [(2 * k + 1) * 5e-11 for k in range(40)] + [0.1, -0.25, 0.0, 1.0, -1e-12, 12345.6789]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", sinks.number_text(F.col("v")).alias("t")).toPandas().sort_values("i").t
    assert list(got) == [f"{v:.10f}".rstrip("0").rstrip(".") for v in values]


def test_a_day_of_one_row_keeps_its_return(spark):
    ret = 1.5e-10
    day = M.daily_compound(frame(spark, pd.DataFrame({"strategy_id": [1, 2, 2], "ts": pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:00", "2024-01-01 10:00"]), "ret": [ret, 0.1, 0.2]}))).toPandas()
    day = day.set_index("strategy_id").ret
    assert day[1] == ret and math.isclose(day[2], 0.32)


def test_a_table_in_parts_is_one_input(spark, tmp_path):
    for name in ("a/t.parquet/part-0.parquet", "a/t.parquet/part-1.parquet", "a/one.parquet", "a/other.csv", "b.x.parquet/day=1/part-0.snappy.parquet"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    got = FI.discover_inputs(spark, {"s": str(tmp_path)}, "*.parquet").toPandas().sort_values("path")
    assert got[["group", "name", "length"]].values.tolist() == [["a", "one", 5], ["a", "t", 10], [tmp_path.name, "b.x", 5]]
    assert list(got.path) == [f"file:{tmp_path}/{p}" for p in ("a/one.parquet", "a/t.parquet", "b.x.parquet")]
    assert [r.name for r in FI.discover_inputs(spark, {"s": f"{tmp_path}/a"}, "o*", limit=1).collect()] == ["one"]
