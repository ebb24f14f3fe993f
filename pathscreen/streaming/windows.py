"""Event-time windows with Spark's watermark: a day or a bar goes out once, when the watermark has passed it.

The watermark is the latest time of the whole stream less the allowed delay. State holds one row per open window. What
came after its window was closed takes no part in any result; ``dropped_rows`` lists it afterwards from the inputs.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pathscreen.functions.exprs import d, micros
from pathscreen.operators.benchmark import ASSET
from pathscreen.operators.metrics import ID
from pathscreen.session import path_exists
from pathscreen.sources import prices as P
from pathscreen.staging import stage, staging

SEQ = "seq"  # a number of the arrival: it grows from one micro-batch to the next


def _instant(ts: str) -> Column:
    """A zone-less time as the instant it names in UTC, as watermarks need one: windows do not move with the session's zone."""
    return F.timestamp_micros(micros(ts))


def _zoneless(instant: Column) -> Column:
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.unix_micros(instant) / F.lit(1_000_000)).cast("decimal(18,6)"))


def daily_compound(source: DataFrame, delay: str = "1 day") -> DataFrame:
    """source: streaming (strategy_id, ts, ret, seq). One row (strategy_id, day, ret, rows, last_seq) per closed day; append mode.

    Rows without a time take part in nothing; null returns count as rows without growth, as in the batch form (``metrics.daily_compound``).
    """
    timed = source.where("ts IS NOT NULL").withColumn("at", _instant("ts")).withWatermark("at", delay)
    days = timed.groupBy(ID, F.window("at", "1 day")).agg((F.product(d(1) + F.col("ret")) - d(1)).alias("ret"), F.count(F.lit(1)).alias("rows"), F.max(SEQ).alias("last_seq"))
    return days.select(ID, _zoneless(F.col("window.start")).cast("date").alias("day"), "ret", "rows", "last_seq")


def final_bars(source: DataFrame, delay: str = "2 days") -> DataFrame:
    """source: streaming (asset_key, ts, close, volume, seq). One row per (asset_key, ts): the last write, once the watermark has passed its time; append mode.

    Of equal ``seq`` the higher close, then volume stays."""
    timed = source.where("ts IS NOT NULL").withColumn("at", _instant("ts")).withWatermark("at", delay)
    last = timed.groupBy(ASSET, "at").agg(F.max(F.struct(SEQ, "close", "volume")).alias("bar"))
    return last.select(ASSET, _zoneless(F.col("at")).alias("ts"), "bar.close", "bar.volume", F.col(f"bar.{SEQ}").alias("last_seq"))


def stream_daily_compound(source: DataFrame, out: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Appends closed days to the Parquet folder ``out`` over what is available; the sink's log makes a replayed batch count once."""
    return daily_compound(source, delay).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_final_bars(source: DataFrame, store: str, closed: str, checkpoint: str, delay: str = "2 days", unit: str = "year") -> StreamingQuery:
    """Merges closed bars into the price store and lists them under ``closed``, over what is available. No lateness is decided against the store: the watermark has, and it survives in the checkpoint."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with staging(spark) as scope:
            bars = stage(batch)
            bars.write.mode("overwrite").parquet(f"{closed}/batch_id={batch_id}")
            fresh = bars.drop("last_seq")
            if not bars.isEmpty():
                P.refresh_store(spark, store, fresh, unit) if path_exists(spark, f"{store}/{ASSET}=*") else P.write_store(fresh, store, unit=unit)
        scope.remove()

    return final_bars(source, delay).writeStream.outputMode("append").foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watermark(spark: SparkSession, checkpoint: str) -> int | None:
    """The last watermark that the stream's checkpoint names, in microseconds since 1970; None before the first."""
    at = F.get_json_object("value", "$.batchWatermarkMs").cast("long")
    last = spark.read.text(f"{checkpoint}/offsets/[0-9]*").agg(F.max(at)).first()[0]
    return last * 1000 if last else None


def dropped_rows(rows: DataFrame, closed: DataFrame, keys: list[str], until: str, mark: int | None) -> DataFrame:
    """The rows of a stream's input that its watermark dropped.

    ``rows`` has ``keys``, ``until`` (zone-less end of the row's window) and ``seq``; ``closed`` has ``keys`` and last_seq for every window that went out; ``mark`` is the
    stream's ``watermark``. A row is dropped if its window went out before its arrival, or was closed before any row of it came. Rows without a time are not listed.
    """
    gone = closed.select(*(F.col(k).alias(f"_{k}") for k in keys), "last_seq")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    never = F.col("last_seq").isNull() & (micros(until) <= F.lit(mark)) if mark is not None else F.lit(False)
    return rows.where(F.col(until).isNotNull()).join(gone, same, "left").where(F.coalesce(F.col(SEQ) > F.col("last_seq"), never)).select(*rows.columns)
