"""What the loader sends through the driver: plans that stay short, and no table that grows with the files broadcast by the size of its compressed file."""
import re

import pytest
from pyspark.sql import functions as F

from pathscreen.functions import names as N
from pathscreen.operators import loader as L, mapping as MP, scan, trades as T
from pathscreen.sources import files as FI
from pathscreen.staging import stage


def plan(df) -> str:
    """The joins as first planned, before any runtime size is known."""
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture(scope="module")
def sheets(spark):
    rows = [(f"f{k}", i, j, ("entry time", "exit time", "pnl_pct")[j] if i == 0 else (f"2024-01-{i:02d}", f"2024-02-{i:02d}", f"{k + i}.5")[j])
            for k in range(5) for i in range(25) for j in range(3)]
    rows += [(None, 0, 0, "date"), (None, 1, 0, "2024-01-01"), ("late", 40, 0, "date"), ("late", 41, 0, "2024-01-01")]
    return stage(spark.createDataFrame(rows, "file string, row_no long, col_no int, txt string").withColumn("sheet", F.lit("S1")))


def test_cells_are_never_the_side_that_is_broadcast(sheets):
    data = FI.promote_header(sheets)
    assert "BuildLeft" not in plan(data)
    assert plan(data).count("BroadcastHashJoin") == len(re.findall("BroadcastHashJoin .*LeftOuter, BuildRight", plan(data)))  # an inner join may take either side
    assert {r.file for r in data.select("file").distinct().collect()} == {f"f{k}" for k in range(5)}  # no header row: no data
    assert data.count() == 5 * 24 * 3 and {r.name for r in data.select("name").distinct().collect()} == {"entry time", "exit time", "pnl_pct"}


def test_rules_of_columns_are_not_broadcast(sheets):
    cells = FI.promote_header(sheets).drop("sheet")
    lost = cells.limit(1).withColumn("file", F.lit(None).cast("string"))
    typed = L.typed_cells(cells.unionByName(lost))
    assert "BroadcastHashJoin" not in plan(typed)
    assert typed.count() == 5 * 24 * 3 and typed.where("file IS NULL OR norm IS NULL").count() == 0


def test_ranks_broadcast_no_values(spark):
    values = stage(spark.createDataFrame([(k, float(i % 40)) for k in ("a", "b", None) for i in range(200)], "file string, v double"))
    for how in ({}, {"staged": True}):
        ranks = scan.ordered_values(values, ["file"], "v", **how)
        assert not re.search("BroadcastHashJoin .*Inner", plan(ranks))
        assert ranks.count() == 3 * 40 and {(r.file, r.q) for r in scan.exact_quantiles(values, ["file"], "v", {"q": 0.5}, **how).collect()} == {("a", 19.5), ("b", 19.5), (None, 19.5)}


def test_entries_are_not_broadcast(spark):
    rows = [("a", f"t{i}", f"2024-01-{1 + i % 20:02d}", 0.1, e) for i in range(30) for e in (True, False)]
    marked = spark.createDataFrame(rows, "strategy_id string, trade_id string, day string, ret double, is_entry boolean")
    marked = stage(marked.select("strategy_id", "trade_id", F.col("day").cast("timestamp_ntz").alias("ts"), "ret", "is_entry", (~F.col("is_entry")).alias("is_exit")))
    seen = []
    inner, T.stage = T.stage, lambda df: inner(seen.append(plan(df)) or df)
    try:
        out = T.pair_first_entry(marked)
    finally:
        T.stage = inner
    assert "BroadcastHashJoin" not in seen[0] and out.where("entry_ts = exit_ts").count() == 30


def test_roles_of_a_log_plan_short(spark):
    names = ["entry_time", "exit_time", "net_pnl_pct", "cumulative_pnl", "symbol", "pnl_usd", "pl", "profit_ratio", "type", None, "", "trade_number", "total_return_pct"]
    columns = stage(spark.createDataFrame([(f"f{k}", j, n) for k in range(3) for j, n in enumerate(names[k:])], "file string, col_no int, norm string"))
    logs = MP.detect_trade_log(columns)
    assert len(logs._jdf.queryExecution().toString()) < 60_000
    assert [(r.file, r.entry, r.exit, r.pnl, r.entry_col, r.pnl_col, r.unit) for r in logs.collect()] == [("f0", "entry_time", "exit_time", "net_pnl_pct", 0, 2, "percent_by_name"), ("f1", None, "exit_time", "net_pnl_pct", None, 1, "percent_by_name")]
    for hints in (N.ENTRY_HINTS, N.NOT_PNL, N.DEC_HINTS, N.TRADE_HINTS):
        for n, place in columns.select("norm", N.first_hint(F.col("norm"), hints)).collect():
            assert place == next((i for i, h in enumerate(hints, 1) if n is not None and f"_{h}_" in f"_{n}_"), 0)
        assert {(r.file, r.hint, r.column) for r in MP.match_hint(columns, hints).collect()} == {
            (f"f{k}", *best[1::2]) for k in range(3) if (best := min(((i, h, j, n) for j, n in enumerate(names[k:]) if n is not None for i, h in enumerate(hints) if f"_{h}_" in f"_{n}_"), default=None))}
