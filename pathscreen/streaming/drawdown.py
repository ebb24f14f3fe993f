"""Live drawdown per strategy by a state processor; late rows are output rows for a side table."""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pathscreen.functions.exprs import d
from pathscreen.operators import scan
from pathscreen.operators.metrics import ID
from pathscreen.staging import stage, staging

STATE = "last_us long, growth double, high double, mdd double, n long, total double, squares double, late long"
EMPTY = (-(2 ** 62), 1.0, 1.0, 0.0, 0, 0.0, 0.0, 0)
CURRENT = ("n", "growth", "mdd", "drawdown", "mean", "late")
OUTPUT = "kind string, n long, growth double, mdd double, drawdown double, mean double, late long, us long, ret double"
SPAN = 86_400_000_000  # microseconds of time that are sorted at once; shorter for ticks
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fresh_and_late(last: int, us: np.ndarray, ret: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Times and returns, in order, of the rows that count, and of the late ones: those at or before the last time; of the rows of one new time the one of the smallest return counts."""
    order = np.lexsort((ret, us))
    us, ret = us[order], ret[order]
    fresh = (us > last) & np.concatenate(([True], us[1:] != us[:-1]))[:len(us)]
    return us[fresh], ret[fresh], us[~fresh], ret[~fresh]


def advance(state: tuple, us: np.ndarray, ret: np.ndarray) -> tuple:
    """State after rows in any order. Their (growth, high, low, worst drawdown) is put after the state's, as any two neighbouring stretches combine."""
    last, growth, high, mdd, n, total, squares, late = state
    us, ret, behind, _ = fresh_and_late(last, us, ret)
    if len(ret):
        path = np.cumprod(1.0 + ret)
        tops = np.maximum(np.maximum.accumulate(path), 1.0)
        mdd = min(mdd, float((path / tops - 1.0).min()), growth * min(1.0, float(path.min())) / high - 1.0)
        high = max(high, growth * float(tops[-1]))
        last, growth, n = int(us[-1]), growth * float(path[-1]), n + len(ret)
        total, squares = total + float(ret.sum()), squares + float((ret ** 2).sum())
    return last, growth, high, mdd, n, total, squares, late + len(behind)


class LiveDrawdown(StatefulProcessor):
    """Value state: the summary of all rows so far. Rows of a strategy that come in several Arrow batches wait as sorted runs, by stretch of
    time, in map state and are folded one stretch after another, so a hot strategy is never in one frame. Nothing waits from batch to batch."""

    def __init__(self, span: int = SPAN):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", STATE)
        self.runs = handle.getMapState("runs", "stretch long, part long", "us binary, ret binary")

    def close(self) -> None:
        pass

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        if not self.now.exists():
            self.now.update(tuple(initialState[name].iloc[0].item() for name in (x.split()[0] for x in STATE.split(", "))))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.now.get()) if self.now.exists() else EMPTY
        for us, ret in self._stretches(frame for frame in rows if len(frame)):
            _, _, behind_us, behind_ret = fresh_and_late(state[0], us, ret)
            state = advance(state, us, ret)
            if len(behind_us):
                yield _row(key, "late", state).merge(pd.DataFrame({"us": behind_us, "ret": behind_ret}), how="cross")
        self.now.update(state)
        yield _row(key, "current", state).assign(us=state[0], ret=0.0)

    def _stretches(self, frames: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        first, second = next(frames, None), next(frames, None)
        if second is None:
            if first is not None:
                yield first["us"].to_numpy(), first["ret"].to_numpy()
            return
        parts: dict[int, int] = {}
        for frame in (f for some in ((first, second), frames) for f in some):
            us, ret = frame["us"].to_numpy(np.int64), frame["ret"].to_numpy(np.float64)
            order = np.argsort(us, kind="stable")
            us, ret = us[order], ret[order]
            marks, starts = np.unique(us // self.span, return_index=True)
            for mark, a, b in zip(marks.tolist(), starts, [*starts[1:], len(us)]):
                self.runs.updateValue((mark, parts.get(mark, 0)), (us[a:b].tobytes(), ret[a:b].tobytes()))
                parts[mark] = parts.get(mark, 0) + 1
        for mark in sorted(parts):
            held = [self.runs.getValue((mark, part)) for part in range(parts[mark])]
            for part in range(parts[mark]):
                self.runs.removeKey((mark, part))
            yield np.frombuffer(b"".join(x[0] for x in held), np.int64), np.frombuffer(b"".join(x[1] for x in held), np.float64)


def _row(key: tuple, kind: str, state: tuple) -> pd.DataFrame:
    _, growth, high, mdd, n, total, _, late = state
    return pd.DataFrame({ID: [key[0]], "kind": [kind], "n": [n], "growth": [growth], "mdd": [mdd], "drawdown": [growth / high - 1.0], "mean": [total / n if n else 0.0], "late": [late]})


def history_state(history: DataFrame, span: int = SPAN) -> DataFrame:
    """The state that ``history(strategy_id, us, ret)`` leaves, one row per strategy: where a stream goes on from."""
    rows = scan.keep_first(history.select(ID, "us", "ret").where(_valid()), [ID, "us"], ["ret"])
    folds = scan.chunk_folds(rows, [ID], ["us"], "ret", F.floor(F.col("us") / F.lit(span)))
    before = Window.partitionBy(ID).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    steps = folds.withColumn("_bg", F.coalesce(F.product("g").over(before), d(1)))
    steps = steps.withColumn("_bh", F.greatest(d(1), F.max(F.col("_bg") * F.col("hi")).over(before)))
    path = steps.groupBy(ID).agg(F.product("g").alias("growth"), F.greatest(d(1), F.max(F.col("_bg") * F.col("hi"))).alias("high"),
                                 F.least(d(0), F.min(F.least("cdd", F.col("_bg") * F.col("lo") / F.col("_bh") - d(1)))).alias("mdd"))
    sums = rows.groupBy(ID).agg(F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n"), F.sum("ret").alias("total"), F.sum(F.col("ret") * F.col("ret")).alias("squares"))
    return sums.join(path, ID).select(ID, "last_us", "growth", "high", "mdd", "n", "total", "squares", F.lit(0).cast("long").alias("late"))


def _valid():
    return F.col("us").isNotNull() & F.col("ret").isNotNull() & ~F.isnan("ret")


def live_drawdown(source: DataFrame, history: DataFrame | None = None, span: int = SPAN) -> DataFrame:
    """source: streaming (strategy_id of any type, us, ret) with ``us`` in microseconds; rows without a time or a number are left out.

    Per strategy and batch one updated row (``current``), and one row for each late row (``late_rows``). ``history``: rows the stream
    goes on from. The session needs the RocksDB state store (``state_store``).
    """
    rows = source.select(ID, "us", "ret").where(_valid())
    kind = dict(rows.dtypes)[ID]
    start = history_state(history, span).groupBy(ID) if history is not None else None
    return rows.groupBy(ID).transformWithStateInPandas(LiveDrawdown(span), f"{ID} {kind}, {OUTPUT}", "Update", "None", initialState=start)


def current(out: DataFrame) -> DataFrame:
    return out.where(F.col("kind") == "current").select(ID, *CURRENT)


def late_rows(out: DataFrame) -> DataFrame:
    return out.where(F.col("kind") == "late").select(ID, "us", "ret")


@contextmanager
def state_store(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, as state processors need it; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stream_live_drawdown(source: DataFrame, live: str, late: str, checkpoint: str, history: DataFrame | None = None, span: int = SPAN) -> StreamingQuery:
    """Writes both tables per batch over what is available; a replayed batch replaces its own files."""
    def keep(batch: DataFrame, batch_id: int) -> None:
        with staging(batch.sparkSession) as scope:
            rows = stage(batch)
            current(rows).write.mode("overwrite").parquet(f"{live}/batch_id={batch_id}")
            late_rows(rows).write.mode("overwrite").parquet(f"{late}/batch_id={batch_id}")
        scope.remove()

    with state_store(source.sparkSession):
        return (live_drawdown(source, history, span).writeStream.outputMode("update").foreachBatch(keep)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
