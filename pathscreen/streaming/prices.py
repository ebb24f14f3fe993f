"""Continuous price refresh: last write wins, late bars go to a side table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pathscreen.operators import scan
from pathscreen.operators.benchmark import ASSET
from pathscreen.session import path_exists
from pathscreen.sources import prices as P
from pathscreen.staging import stage


def upsert_batch(spark: SparkSession, batch: DataFrame, store: str, late: str, marks: str, delay: str, batch_id: int, unit: str = "year") -> None:
    """Merge one micro-batch. A replayed batch gives the same store and the same late table: the last times that decide
    lateness are written under ``marks`` before the store changes, and a replay reads them from there."""
    fresh = stage(scan.keep_last(batch.where("ts IS NOT NULL"), [ASSET, "ts"], ["seq"]).drop("seq"))
    stored = path_exists(spark, f"{store}/{ASSET}=*")  # some partition; a first write that was cut short is merged with
    mark = f"{marks}/batch_id={batch_id}"
    if not path_exists(spark, f"{mark}/_SUCCESS"):
        last = P.last_times(spark, store, fresh) if stored else fresh.select(ASSET, F.col("ts").alias("last")).limit(0)
        last.write.mode("overwrite").parquet(mark)
    kinds = fresh.select(ASSET, F.col("ts").alias("last")).schema
    marked = fresh.join(spark.read.schema(kinds).parquet(mark), ASSET, "left").withColumn("_late", F.coalesce(
        F.col("ts") < F.col("last") - F.expr(f"INTERVAL {delay}"), F.lit(False)))
    marked.where("_late").drop("_late", "last").withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{late}/batch_id={batch_id}")
    on_time = marked.where("NOT _late").drop("_late", "last")
    if stored:
        P.refresh_store(spark, store, on_time, unit)
    else:
        P.write_store(on_time, store, unit=unit)


def stream_price_upsert(source: DataFrame, store: str, late: str, checkpoint: str, delay: str = "2 days", unit: str = "year") -> StreamingQuery:
    """source: streaming (asset_key, ts, close, volume, seq); runs over what is available and stops."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        upsert_batch(batch.sparkSession, batch, store, late, f"{checkpoint}/last_times", delay, batch_id, unit)

    return (source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
