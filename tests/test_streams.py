"""Streams: a replayed batch changes nothing, late rows are kept aside, the store rewrites only what is touched."""
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathscreen.sources import prices as P
from pathscreen.streaming import drawdown, prices as SP, windows



def bars(spark, *rows):
    return spark.createDataFrame([(k, t, c, 1.0, s) for k, t, c, s in rows], "asset_key string, t string, close double, volume double, seq int").selectExpr(
        "asset_key", "CAST(t AS timestamp_ntz) ts", "close", "volume", "seq")


def stored(spark, path):
    return {(r.asset_key, str(r.ts)[:10], r.close) for r in P.read_store(spark, path).collect()}


def test_replayed_batches_and_withdrawn_bars(spark, tmp_path):
    store, late, marks = (str(tmp_path / n) for n in ("store", "late", "marks"))
    step = lambda k, batch: SP.upsert_batch(spark, batch, store, late, marks, "2 days", k)
    first = bars(spark, ("000300", "2023-12-29", 1.0, 0), ("000300", "2024-01-05", 2.0, 0), ("B", "2024-01-05", 7.0, 0))
    second = bars(spark, ("000300", "2024-01-04", 3.0, 1), ("000300", "2024-01-09", 4.0, 1), ("000300", "2023-12-29", 9.0, 1), ("B", "2024-01-05", 0.0, 1))
    step(0, first)
    step(0, first)
    assert stored(spark, store) == {("000300", "2023-12-29", 1.0), ("000300", "2024-01-05", 2.0), ("B", "2024-01-05", 7.0)}
    kept = set(os.listdir(f"{store}/asset_key=000300/period=2023"))
    for _ in range(2):  # the replay sees a store that already holds 2024-01-09
        step(1, second)
        assert stored(spark, store) == {("000300", "2023-12-29", 1.0), ("000300", "2024-01-05", 2.0), ("000300", "2024-01-04", 3.0), ("000300", "2024-01-09", 4.0)}
        assert [str(r.ts)[:10] for r in spark.read.parquet(f"{late}/batch_id=1").collect()] == ["2023-12-29"]
    assert set(os.listdir(f"{store}/asset_key=000300/period=2023")) == kept
    assert P.load_close(spark, store, "000300").count() == 4


def test_store_by_month(spark, tmp_path):
    store = str(tmp_path / "store")
    P.write_store(bars(spark, ("A", "2024-01-30", 1.0, 0), ("A", "2024-02-01", 2.0, 0)).drop("seq"), store, unit="month")
    P.refresh_store(spark, store, bars(spark, ("A", "2024-02-02", 3.0, 0)).drop("seq"), unit="month")
    assert stored(spark, store) == {("A", "2024-01-30", 1.0), ("A", "2024-02-01", 2.0), ("A", "2024-02-02", 3.0)}
    assert sorted(d for d in os.listdir(f"{store}/asset_key=A")) == ["period=202401", "period=202402"]
    with pytest.raises(ValueError):
        P.period("week")


def test_late_rows_of_the_live_drawdown(spark, tmp_path):
    inbox, live, late, mark = (str(tmp_path / n) for n in ("inbox", "live", "late", "mark"))
    for rows in ([("a", 1, 0.1), ("a", 2, -0.5), ("b", 1, 0.2)], [("a", 2, 0.3), ("a", 3, 0.0)]):
        spark.createDataFrame(rows, "strategy_id string, us long, ret double").write.mode("append").parquet(inbox)
        source = spark.readStream.schema("strategy_id string, us long, ret double").parquet(inbox)
        drawdown.stream_live_drawdown(source, live, late, mark).awaitTermination()
    assert [tuple(r)[:3] for r in spark.read.parquet(late).collect()] == [("a", 2, 0.3)]
    now = {r.strategy_id: r for r in spark.read.parquet(live).orderBy("n").collect()}
    assert now["a"].n == 3 and now["a"].late == 1 and abs(now["a"].mdd + 0.5) < 1e-12 and now["b"].n == 1


class Held:
    """A value or map state in memory."""

    def __init__(self):
        self.value, self.rows = None, {}

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def updateValue(self, key, value):
        self.rows[key] = value

    def getValue(self, key):
        return self.rows[key]

    def removeKey(self, key):
        del self.rows[key]


def test_a_hot_strategy_is_never_in_one_frame(monkeypatch):
    rng = np.random.default_rng(1)
    us, ret = rng.permutation(5000) * 10, rng.normal(0, 0.02, 5000)
    sizes, plain = [], drawdown.advance
    monkeypatch.setattr(drawdown, "advance", lambda state, us, ret: sizes.append(len(us)) or plain(state, us, ret))
    work = drawdown.LiveDrawdown(span=1000)
    work.now, work.runs = Held(), Held()
    out = list(work.handleInputRows(("a",), iter([pd.DataFrame({"us": us[i:i + 300], "ret": ret[i:i + 300]}) for i in range(0, 5000, 300)]), None))
    assert max(sizes) <= 100 and sum(sizes) == 5000 and not work.runs.rows and len(out) == 1
    path = np.cumprod(1 + ret[np.argsort(us)])
    tops = np.maximum(np.maximum.accumulate(path), 1)
    got = out[0].iloc[0]
    assert got.n == 5000 and got.late == 0 and np.isclose(got.growth, path[-1]) and np.isclose(got.mdd, (path / tops - 1).min()) and np.isclose(got.drawdown, path[-1] / tops[-1] - 1)


def arrivals(spark, tmp, parts, history=None, span=drawdown.SPAN):
    inbox, live, late, mark = (f"{tmp}/{n}" for n in ("inbox", "live", "late", "mark"))
    for rows in parts:
        spark.createDataFrame(rows, "strategy_id string, us long, ret double").write.mode("append").parquet(inbox)
        source = spark.readStream.schema("strategy_id string, us long, ret double").parquet(inbox)
        drawdown.stream_live_drawdown(source, live, late, mark, history, span).awaitTermination()
    now = {r.strategy_id: r for r in spark.read.parquet(live).orderBy("n", "batch_id").collect()}
    return {k: (r.n, round(r.growth, 9), round(r.mdd, 9), round(r.drawdown, 9), round(r["mean"], 9)) for k, r in now.items()}, sorted(tuple(r)[:3] for r in spark.read.parquet(late).collect())


def test_one_arrival_many_arrivals_and_history_agree(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [("hot" if i % 3 else f"s{i % 7}", i * 40, float(rng.normal(0, 0.03))) for i in range(600)]
    mixed = [rows[i] for i in rng.permutation(600)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)  # the hot strategy comes in several frames
    try:
        one = arrivals(spark, tmp_path / "one", [mixed], span=1000)
        many = arrivals(spark, tmp_path / "many", [rows[:200], rows[200:230], rows[230:]], span=1000)  # each a restart from the checkpoint
        past = spark.createDataFrame([*rows[:300], ("hot", None, 0.5), ("hot", 5, None), (*rows[1][:2], 9.0)], "strategy_id string, us long, ret double")
        grown = arrivals(spark, tmp_path / "grown", [rows[300:], rows[1:2]], past, 1000)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert one == many and one[1] == [] and grown[0] == one[0] and grown[1] == [rows[1]]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != drawdown.ROCKSDB


def test_equal_times_and_rows_without_a_number(spark, tmp_path):
    now, late = arrivals(spark, tmp_path, [[("a", 1, 0.2), ("a", 1, 0.1), ("a", 1, 0.3), ("a", 2, None), ("a", None, 0.1), ("a", 3, float("nan")), (None, 1, 0.5)]])
    assert now["a"][:2] == (1, 1.1) and now[None][:2] == (1, 1.5) and late == [("a", 1, 0.2), ("a", 1, 0.3)]


def daily(spark, tmp, parts):
    inbox, out, mark = (f"{tmp}/{n}" for n in ("inbox", "out", "mark"))
    for seq, rows in enumerate(parts):
        batch = spark.createDataFrame(rows, "strategy_id string, t string, ret double").select("strategy_id", F.col("t").cast("timestamp_ntz").alias("ts"), "ret", F.lit(seq).alias("seq"))
        batch.write.mode("append").parquet(inbox)
        windows.stream_daily_compound(spark.readStream.schema(batch.schema).parquet(inbox), out, mark).awaitTermination()
    rows = spark.read.parquet(inbox).withColumn("day", F.to_date("ts")).withColumn("until", F.date_add("day", 1).cast("timestamp_ntz"))
    days = spark.read.parquet(out)
    dropped = windows.dropped_rows(rows, days, ["strategy_id", "day"], "until", windows.watermark(spark, mark))
    return sorted((r.strategy_id, str(r.day), round(r.ret, 9), r.rows) for r in days.collect()), sorted((r.strategy_id, str(r.ts), r.ret) for r in dropped.collect())


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_days_go_out_once_and_late_rows_are_listed(spark, tmp_path, zone):
    first = [("a", "2024-01-01 23:00:00", 0.1), ("a", "2024-01-01 01:00:00", 0.1), ("b", "2024-01-02 00:00:00", 0.5), ("a", "2024-01-03 12:00:00", 0.2), ("a", None, 0.9)]
    second = [("a", "2024-01-01 05:00:00", 0.7), ("c", "2024-01-01 06:00:00", 0.3), ("b", "2024-01-02 08:00:00", 1.0), ("a", "2024-01-06 00:00:00", 0.1)]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        days, dropped = daily(spark, tmp_path, [first, second])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert days == [("a", "2024-01-01", 0.21, 2), ("a", "2024-01-03", 0.2, 1), ("b", "2024-01-02", 2.0, 2)]
    assert dropped == [("a", "2024-01-01 05:00:00", 0.7), ("c", "2024-01-01 06:00:00", 0.3)]


def test_final_bars_keep_the_last_write(spark, tmp_path):
    inbox, store, closed, mark = (str(tmp_path / n) for n in ("inbox", "store", "closed", "mark"))
    for part in (bars(spark, ("A", "2024-01-01", 1.0, 0), ("A", "2024-01-05", 2.0, 0)), bars(spark, ("A", "2024-01-01", 9.0, 1), ("A", "2024-01-05", 3.0, 1), ("A", "2024-01-05", 4.0, 2), ("A", "2024-01-08", 5.0, 1))):
        part.write.mode("append").parquet(inbox)
        windows.stream_final_bars(spark.readStream.schema(part.schema).parquet(inbox), store, closed, mark).awaitTermination()
    assert stored(spark, store) == {("A", "2024-01-01", 1.0), ("A", "2024-01-05", 4.0)}
    late = windows.dropped_rows(spark.read.parquet(inbox), spark.read.parquet(closed), ["asset_key", "ts"], "ts", windows.watermark(spark, mark)).collect()
    assert [(r.close, r.seq) for r in late] == [(9.0, 1)]
