"""Trade logs from cells to trades, and a batch of logs and plain returns scored against the control of each kind."""
import numpy as np
import pandas as pd
import pytest
from conftest import frame, record
from pyspark.sql import functions as F

from pathscreen.operators import benchmark as B, loader, resample as R
from pathscreen.sources import files as FI
from pathscreen.staging import stage


def lines(head, *rows):
    return "\n".join([head, *rows]).encode()


def pairs(value, n=12, first=0):
    return [f"2024-{1 + i:02d}-01,2024-{1 + i:02d}-{5 + i % 3:02d},{value(i)}" for i in range(first, n)]


def events(n, words=("Entry long", "Exit long"), ids=True):
    out = []
    for i in range(n):
        key = f"t{i}" if ids else ""
        out += [f"{key},{words[0]},2024-{1 + i:02d}-01 10:00,,AAA", f"{key},{words[1]},2024-{1 + i:02d}-03 10:00,1.5,"]
    return out


FILES = {
    "percent": lines("entry time,exit time,pnl_pct", *pairs(lambda i: 2.5)),
    "signed": lines("entry time,exit time,pnl", *pairs(lambda i: "2.5%")),
    "ratio": lines("entry_date,exit_date,profit_ratio,symbol", *pairs(lambda i: f"{-1.2 if i == 4 else 0.025},{'' if i == 0 else 'BTC'}")),
    "guess_pct": lines("opened,closed,pnl", *pairs(lambda i: 2.5)),
    "guess_dec": lines("opened,closed,pnl", *pairs(lambda i: 0.025)),
    "vague": lines("opened,closed,pnl", *pairs(lambda i: 0.7)),
    "money": lines("opened,closed,pnl", *pairs(lambda i: 250)),
    "usd": lines("entry time,exit time,pnl_usd", *pairs(lambda i: 250)),
    "few": lines("entry time,exit time,pnl_pct", *pairs(lambda i: 2.5, 2)),
    "none": lines("entry time,exit time,pnl_pct", *pairs(lambda i: "n/a")),
    "holes": lines("entry time,exit time,pnl_pct", *pairs(lambda i: "n/a" if i == 3 else 2.5), "2024-12-30,soon,1", "2024-12-30,2024-12-31,3"),
    "back": lines("entry time,exit time,pnl_pct", *[f"2024-{1 + i:02d}-09,2024-{1 + i:02d}-02,1" for i in range(6)]),
    "events": lines("trade_number,type,date_time,net_pnl_pct,ticker", *events(5)),
    "entries": lines("trade_number,signal,type,date_time,net_pnl_pct,ticker", *(x.replace(",", ",x,", 1) for x in events(5, ("进场", "TP hit")))),
    "noids": lines("trade_number,type,date_time,net_pnl_pct,ticker", *events(5, ids=False)),
    "mute": lines("trade_number,type,date_time,net_pnl_pct,ticker", *events(4, ("buy", "sell"))),
    "plain": lines("date,return", *[f"2024-01-{1 + i:02d},0.01" for i in range(20)]),
    "wild": lines("entry time,exit time,profit_ratio", *pairs(lambda i: 99)),
    "blank": b"",
}


@pytest.fixture(scope="module")
def uploads(spark):
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in FILES.items()], "path string, content binary")
    sheets = FI.good_cells(stage(FI.decode_files(files))).withColumnRenamed("path", "file").withColumn("sheet", F.lit("S1"))
    return loader.load_uploads(FI.promote_header(sheets).drop("sheet"))


def test_every_log_ends_in_trades_or_rejects(uploads):
    assert {(r.strategy_id, r.code) for r in uploads.rejects.collect()} == {
        ("money", "unit_refused"), ("usd", "absolute_only"), ("few", "few_trades"), ("none", "few_trades"), ("wild", "implausible_growth")}
    assert {r.strategy_id for r in uploads.returns.series.select("strategy_id").distinct().collect()} == {"plain"}
    logs = {r.strategy_id for r in uploads.logs.trades.select("strategy_id").distinct().collect()}
    assert logs == set(FILES) - {"money", "usd", "few", "none", "wild", "plain", "blank"} == {r.strategy_id for r in uploads.logs.meta.collect()}


def test_units_and_trades(uploads):
    t = uploads.logs.trades.toPandas()
    for name in ("percent", "signed", "guess_pct", "guess_dec"):
        assert len(t[t.strategy_id == name]) == 12 and np.allclose(t[t.strategy_id == name].ret, 0.025), name
    assert sorted(t[t.strategy_id == "ratio"].ret.round(3))[0] == -0.999 and np.allclose(t[t.strategy_id == "vague"].ret, 0.7)
    holes = t[t.strategy_id == "holes"].sort_values("trade_no")
    assert len(holes) == 12 and list(holes.trade_no)[:4] == [1, 2, 3, 5] and str(holes.exit_ts.iloc[-1])[:10] == "2024-12-31"
    e = t[t.strategy_id == "events"].sort_values("trade_no")
    assert list(e.trade_no) == [2, 4, 6, 8, 10] and np.allclose(e.ret, 0.015) and ((e.exit_ts - e.entry_ts) == pd.Timedelta(days=2)).all()
    assert len(t[t.strategy_id == "entries"]) == 5 and t[t.strategy_id == "entries"].entry_ts.notna().all()
    assert len(t[t.strategy_id == "noids"]) == 5 and t[t.strategy_id == "noids"].entry_ts.isna().all()
    assert len(t[t.strategy_id == "mute"]) == 4 and t[t.strategy_id == "mute"].entry_ts.isna().all()


def test_facts_and_warnings(uploads):
    meta = {r.strategy_id: r for r in uploads.logs.meta.collect()}
    codes = {}
    for r in uploads.logs.warnings.collect():
        codes.setdefault(r.strategy_id, set()).add(r.code)
    assert codes["percent"] == {"percent"} and codes["guess_pct"] == {"percent", "unit_guessed"} and codes["vague"] == {"decimal", "unit_guessed", "unit_ambiguous"}
    assert codes["ratio"] == {"decimal", "clipped"} and codes["holes"] == {"percent", "rows_dropped"} and codes["events"] == {"percent", "event_log"}
    assert (meta["ratio"].symbol, meta["events"].symbol, meta["percent"].symbol) == ("BTC", "AAA", None)
    assert (meta["events"].n, meta["events"].n_ignored, meta["events"].n_dropped, meta["events"].holding_median) == (5, 5, 0, 2.0)
    assert (meta["holes"].n, meta["holes"].n_dropped) == (12, 2) and meta["back"].holding_median is None and meta["back"].n_timed == 0
    assert meta["events"].caliber == "closed_trade" and meta["events"].value_column == "net_pnl_pct"


def test_no_cells_no_logs(spark):
    none = spark.createDataFrame([], "file string, row_no long, col_no int, name string, txt string")
    out = loader.load_trade_logs(none)
    assert out.trades.count() == out.meta.count() == out.rejects.count() == out.warnings.count() == 0


def test_each_strategy_meets_the_control_of_its_kind_once(spark):
    days = pd.date_range("2020-01-01", periods=400, freq="D")
    rng = np.random.default_rng(4)
    asset = rng.normal(0.001, 0.02, 400)
    px = frame(spark, pd.DataFrame({"asset_key": "A", "ts": days, "close": 100 * np.cumprod(1 + asset)}))
    plain = pd.DataFrame({"strategy_id": 1, "ts": days, "ret": 0.5 * asset})
    sparse = record(400, 3, 4)  # a log with bar returns but too few timed trades: the bar control takes it
    trades = [(sid, k, days[k * 20], days[k * 20 + 7], 0.01 * (-1) ** k) for sid, n in ((2, 12), (3, 5)) for k in range(n)]
    logs = frame(spark, pd.DataFrame(trades + [(4, 0, days[3], days[9], 0.1)], columns=["strategy_id", "trade_no", "entry_ts", "exit_ts", "ret"]))
    closed = logs.where("strategy_id <> 4").select("strategy_id", F.col("exit_ts").alias("ts"), "ret")
    ret = stage(frame(spark, pd.concat([plain, sparse])).select("strategy_id", "ts", "ret").unionByName(closed))
    mp = spark.createDataFrame([(i, "A") for i in (1, 2, 3, 4)], "strategy_id long, asset_key string")
    bars = B.asset_bars(px)
    w = B.overlap_windows(ret, px, mp)
    ppy = spark.createDataFrame([(i, 50.0) for i in (1, 2, 3, 4)], "strategy_id long, ppy double")
    out = R.random_control(spark.createDataFrame([(2,), (3,), (4,), (2,)], "strategy_id long"), logs, B.strategy_side(ret, w), B.asset_side(bars, w), B.bar_returns(ret, bars, w), ppy)
    assert {(r.strategy_id, r.method, r.random_events) for r in out.collect()} == {(1, "bar_long_flat", None), (2, "event_window", 12), (4, "bar_long_flat", None)}
