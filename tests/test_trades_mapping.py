import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from conftest import frame, record
from pathscreen.functions import names as N
from pathscreen.operators import mapping as MP, quality as Q, trades as T
from pathscreen.sources import files as FI


def log(spark, rows):
    pdf = pd.DataFrame(rows, columns=["entry_ts", "exit_ts", "ret"])
    pdf[["entry_ts", "exit_ts"]] = pdf[["entry_ts", "exit_ts"]].apply(pd.to_datetime, format="ISO8601")
    return frame(spark, pdf.assign(strategy_id=1, trade_no=range(1, len(pdf) + 1)))


def test_daily_expansion_compounds_back(spark):
    t = log(spark, [("2018-01-01", "2018-01-10", 0.1), ("2020-02-01", "2020-02-01", -0.05), ("2023-01-01", "2023-02-01", 0.2)])
    daily = T.trades_to_daily(t).toPandas()
    assert len(daily) > 1800
    assert np.isclose(np.prod(1 + daily.ret), 1.1 * 0.95 * 1.2)


def test_overlaps_reject_and_handover_is_fine(spark):
    bad = log(spark, [("2024-01-01", "2024-01-10", 0.1), ("2024-01-05", "2024-01-20", 0.1), ("2024-02-01", "2024-02-05", 0.1)])
    intraday = log(spark, [("2024-01-01 09:00", "2024-01-01 12:00", 0.1), ("2024-01-01 11:00", "2024-01-01 13:00", 0.1), ("2024-01-02", "2024-01-03", 0.1)])
    fine = log(spark, [("2024-01-01", "2024-01-10", 0.1), ("2024-01-10", "2024-01-20", 0.1), ("2024-01-20", "2024-02-05", 0.1)])
    assert T.overlap_check(bad).toPandas().rejected[0] and T.overlap_check(intraday, "hour").toPandas().rejected[0]
    assert not T.overlap_check(fine).toPandas().rejected[0]
    assert T.trades_to_daily(fine).count() == 36 and T.trades_to_daily(bad).count() == 0


def test_percent_trades_are_scaled_and_clipped(spark):
    raw = log(spark, [("2024-01-01", "2024-01-02", 5.0), ("2024-01-03", "2024-01-04", -150.0), ("2024-01-05", "2024-01-06", 2.0)])
    kept, facts, few = T.load_trades(raw.withColumn("is_pct", F.lit(True)).withColumn("symbol", F.when(F.col("trade_no") == 2, "BTC")))
    assert sorted(kept.toPandas().ret) == [-0.999, 0.02, 0.05]
    assert facts.toPandas().symbol[0] == "BTC" and few.count() == 0


def test_compound_without_exactly_three_trades(spark):
    t = log(spark, [("2024-01-01", "2024-01-02", r) for r in (0.1, 0.2, 0.3, 0.3, -0.1)])
    out = T.top_contributors(t).toPandas().iloc[0]
    assert np.isclose(out.compound_without_top3, 1.1 * 0.9 - 1) and np.isclose(out.top1_share, 0.3 / 0.9)


def columns(spark, names):
    return MP.normalize_columns(spark.createDataFrame([("f", i, n) for i, n in enumerate(names)], "file string, col_no int, name string"))


def test_names(spark):
    got = [r.norm for r in columns(spark, ["﻿Date/Time", "Net P&L %", "净盈亏 %", "大小（数量）", "Portfolio Value", "日期和时间"]).orderBy("col_no").collect()]
    assert got == ["datetime", "net_pnl_pct", "net_pnl_pct", "contracts", "equity", "datetime"]
    dup = MP.dedupe_column_names(columns(spark, ["ret", "ret", "", "ret"])).orderBy("col_no").toPandas().unique_name.tolist()
    assert dup == ["ret", "ret_2", "column", "ret_3"]


def test_hints_match_whole_words(spark):
    assert MP.match_hint(columns(spark, ["width", "open", "close"]), N.DATE_HINTS).count() == 0
    assert MP.match_hint(columns(spark, ["width", "trade_date"]), N.DATE_HINTS).toPandas().column[0] == "trade_date"


def cells(spark, values):
    return spark.createDataFrame([("f", i, v) for i, v in enumerate(values)], "file string, row_no int, txt string")


def test_numbers(spark):
    def read(values):
        return MP.coerce_numeric(cells(spark, values)).orderBy("row_no").toPandas()
    pct = read(["1.2%", "-0.5%", "0.3%"])
    assert np.allclose(pct.value, [0.012, -0.005, 0.003]) and pct.is_pct.all()
    assert np.allclose(read(["0,01", "-1,5", "2,25"]).value, [0.01, -1.5, 2.25])
    assert np.allclose(read(["1,234.5", "7", "8"]).value, [1234.5, 7, 8])


def test_dates(spark):
    def read(values):
        return MP.parse_dates(cells(spark, values)).orderBy("row_no").toPandas().ts.tolist()
    day = pd.Timestamp("2024-01-02")
    for values in (["1704153600"] * 3, ["1704153600000"] * 3, ["45293"] * 3, ["20240102"] * 3, ["2024-01-02", "2024-01-02T00:00:00Z", "2024-01-02 00:00:00"]):
        assert read(values) == [day] * 3, values


def test_input_type_and_units(spark):
    base = record(60)
    level = base.assign(strategy_id=2, value=10_000 * np.cumprod(1 + base.ret))
    kinds = MP.detect_input_type(frame(spark, pd.concat([base.assign(value=base.ret), level]))).orderBy("strategy_id").toPandas().input_type.tolist()
    assert kinds == ["returns", "equity"]
    rare = base.head(40).copy()
    rare.loc[5, "ret"] = 3.9
    wild = base.head(20).assign(strategy_id=3, ret=[2.0, -0.9] * 10)
    out = MP.unit_sanity(frame(spark, pd.concat([rare, wild]))).orderBy("strategy_id").toPandas()
    assert list(out.codes[0]) == ["EXTREME_BARS"] and "UNITS_LARGE" in out.codes[1] and not out.reject.any()


def test_text_files_in_several_encodings(spark, tmp_path):
    body = "日期;净盈亏 %\n2024-01-01;1.5\n2024-01-02;2,5\n"
    for enc in ("utf-8-sig", "utf-16", "gb18030"):
        (tmp_path / f"{enc}.csv").write_bytes(body.encode(enc))
    out = FI.scan_delimited(FI.read_files(spark, str(tmp_path), "*.csv")).toPandas()
    for _, g in out.groupby("path"):
        wide = g.pivot(index="row_no", columns="col_no", values="txt")
        assert wide.loc[0].tolist() == ["日期", "净盈亏 %"] and wide.loc[2].tolist() == ["2024-01-02", "2,5"]
    assert FI.discover_inputs(spark, {"up": str(tmp_path)}, "*.csv").count() == 3


def test_personal_values(spark):
    df = spark.createDataFrame([("a", "write to me@x.org"), ("a", "fine"), ("b", "call +49 170 123 45 67"), ("c", "nothing")], "g string, t string")
    out = Q.pii_values(df, "g", "t").orderBy("column").toPandas()
    assert out.kind.tolist() == ["email", "phone", None]


def test_texts_are_read_once_before_ranks(spark):
    rules = MP.date_rules(cells(spark, ["2024-01-02", "45293", "n/a"]))
    hint = Q.return_unit_hint(MP.coerce_numeric(cells(spark, ["1.2%", "-0.5%", "0.3%"])))
    for df in (rules, hint):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" in plan and "txt" not in plan and "replace(" not in plan
    assert rules.toPandas().unit[0] == "text" and hint.toPandas().unit[0] == "decimal"
