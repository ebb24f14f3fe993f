"""From bytes to return series: every file ends in the series or in the rejects."""
from pathscreen.operators import batch, loader, scan
from pathscreen.sources import files as FI
from pathscreen.staging import stage


def lines(head, *rows):
    return "\n".join([head, *rows]).encode()


def days(value, n=40):
    return [f"2024-{1 + i // 28:02d}-{1 + i % 28:02d},{value(i)}" for i in range(n)]


FILES = {
    "good": lines("date,return", *days(lambda i: f"{(-1) ** i * 0.01:.4f}")),
    "curve": lines("date,equity", *days(lambda i: 100 + i)),
    "percent": lines("date,return", *days(lambda i: f"{(-1) ** i * 1.5}%")),
    "holes": lines("date,return", *days(lambda i: "n/a" if i % 10 == 0 else "0.01"), "not a day,0.01"),
    "again": lines("date,return", *days(lambda i: "0.01"), "2024-01-01,0.05"),
    "loss": lines("date,return", *days(lambda i: -1.5 if i == 7 else 0.01)),
    "sunk": lines("date,equity", *days(lambda i: i)),
    "wide": lines("date,a,b", *days(lambda i: f"{i},{i + 1}")),
    "words": lines("date,note", *days(lambda i: "hello")),
    "undated": lines("x,y", *[f"w{i},{i}" for i in range(20)]),
    "short": lines("date,return", *days(lambda i: "0.01", 2)),
    "trades": lines("entry time,exit time,profit_ratio", *days(lambda i: "2024-06-01,0.01")),
    "one": lines("date", "2024-01-01", "2024-01-02", "2024-01-03"),
    "empty": b"",
    "long": lines("date,note", "2024-01-01," + "x" * 200_000),
}


def test_each_file_is_loaded_or_rejected(spark):
    decoded = stage(FI.decode_files(spark.createDataFrame([*FILES.items(), ("none", None)], "path string, content binary")))
    sheets = FI.good_cells(decoded).withColumnRenamed("path", "file").selectExpr("*", "'s' AS sheet")
    out = loader.load_returns(FI.promote_header(sheets).drop("sheet"))
    meta = out.meta.toPandas().set_index("strategy_id")
    rejects = {(r.strategy_id, r.code) for r in out.rejects.collect()} | {(r.path, r.code) for r in FI.file_rejects(decoded).collect()}
    assert rejects == {("loss", "total_loss"), ("sunk", "non_positive_equity"), ("wide", "ambiguous_value"), ("words", "no_numeric"), ("undated", "no_date"),
                       ("short", "short_series"), ("trades", "trade_log"), ("one", "few_columns"), ("empty", "empty_file"), ("none", "empty_file"), ("long", "no_numeric")}
    assert set(meta.index) | {f for f, _ in rejects} == {*FILES, "none"}
    assert meta.loc["good", ["n", "n_dropped", "input_type", "bar_freq"]].tolist() == [40, 0, "returns", "daily"]
    assert meta.loc["curve", ["n", "input_type"]].tolist() == [39, "equity"]
    assert meta.n_dropped["holes"] == 5 and meta.n["again"] == 40
    series = {(r.strategy_id, str(r.ts)[:10]): r.ret for r in out.series.collect()}
    assert series["again", "2024-01-01"] == 0.05 and abs(series["percent", "2024-01-01"] - 0.015) < 1e-12
    codes = {(r.strategy_id, r.code) for r in out.warnings.collect()}
    assert ("percent", "percent") in codes and ("holes", "rows_dropped") in codes and not {c for f, c in codes if f == "good"}


def test_sheet_sizes_and_columns_without_a_header(spark):
    cells = spark.createDataFrame([("f", "s", 0, 0, "date"), ("f", "s", 0, 1, ""), ("f", "s", 1, 0, "2024-01-01"), ("f", "s", 1, 1, "5")], "file string, sheet string, row_no long, col_no int, txt string")
    data = FI.promote_header(cells)
    assert {(r.col_no, r.name) for r in data.collect()} == {(0, "date"), (1, "")}
    assert loader.sheet_sizes(data).collect()[0][2:] == (1, 2)


def test_rows_without_a_time_stay_first(spark):
    rows = spark.createDataFrame([(1, None, 1.0), (1, "2024-01-01", 2.0), (1, "2024-02-01", 3.0)], "k int, t string, v double")
    out = scan.running(rows.selectExpr("k", "CAST(t AS TIMESTAMP_NTZ) ts", "v"), ["k"], ["ts"], counts=True, sums={"s": "v"}).orderBy("idx").toPandas()
    assert out.idx.tolist() == [1, 2, 3] and out.s.tolist() == [1.0, 3.0, 6.0]


def test_one_row_or_one_error_per_input(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = batch.results(frame([("a",), ("b",), ("c",), ("c",)], "strategy_id string"), frame([("a", 5)], "strategy_id string, n long"),
                        frame([("b", "y"), ("b", "x")], "strategy_id string, code string"))
    assert {tuple(r) for r in out.select("strategy_id", "n", "ok", "error").collect()} == {("a", 5, True, ""), ("b", None, False, "x|y"), ("c", None, False, "lost")}
    assert tuple(batch.totals(out).first()) == (3, 1, 2, 0.333333)
    assert tuple(batch.totals(out.limit(0)).first()) == (0, 0, 0, 0.0)
