"""Price tables and the price store (Parquet partitioned by asset and period)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pathscreen.operators import metrics as M, scan
from pathscreen.operators.benchmark import ASSET
from pathscreen.staging import stage

PERIOD = "period"
UNITS = ("year", "month")


def load_prices(raw: DataFrame) -> DataFrame:
    """Positive closes, the last row per (asset, time); assets with a single bar go.

    raw: (asset_key, ts, close, row_no) after role mapping (``mapping.match_hint`` with PRICE_HINTS).
    """
    ok = raw.where("ts IS NOT NULL AND close > 0 AND NOT isnan(close)")
    kept = scan.keep_last(ok, [ASSET, "ts"], ["row_no"])
    enough = kept.groupBy(ASSET).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select(ASSET)
    return kept.join(enough, ASSET, "left_semi")


def _latest(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    both = existing.withColumn("_batch", F.lit(0)).unionByName(fresh.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return scan.keep_last(both, [ASSET, "ts"], ["_batch"]).drop("_batch")


def merge_bars(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Existing and fresh bars by name; the fresh one wins, bars without a positive close go."""
    return _latest(existing, fresh).where("close > 0")


def period(unit: str) -> Column:
    """2024 or 202405: the part of an asset's history that is rewritten as one."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    return F.year("ts") if unit == "year" else F.year("ts") * 100 + F.month("ts")


def write_store(prices: DataFrame, path: str, mode: str = "overwrite", unit: str = "year") -> None:
    """Bars by asset and period, each written by one task: a year suits daily bars, a month intraday bars. One unit per store."""
    spread = prices.withColumn(PERIOD, period(unit)).repartition(F.col(ASSET), F.col(PERIOD))
    spread.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(ASSET, PERIOD).parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """All rows with ``period``; keys are text, also those that look like numbers."""
    found = spark.read.parquet(path).schema
    kinds = T.StructType([T.StructField(f.name, T.StringType() if f.name == ASSET else f.dataType) for f in found])
    return spark.read.schema(kinds).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Bars of the store; a bar whose latest row has no positive close was withdrawn."""
    return _stored(spark, path).drop(PERIOD).where("close > 0")


def refresh_store(spark: SparkSession, path: str, fresh: DataFrame, unit: str = "year") -> None:
    """Merge fresh bars into the store; only the periods of an asset that they touch are read and rewritten.

    A withdrawn bar stays in the files as a row without a positive close, so a period that loses its last bar is rewritten too.
    """
    touched = fresh.select(ASSET, period(unit).alias(PERIOD)).distinct()
    existing = _stored(spark, path).join(touched, [ASSET, PERIOD], "left_semi").drop(PERIOD)
    merged = stage(_latest(existing, fresh))  # written aside first: the store cannot be read and replaced at once
    write_store(merged, path, unit=unit)


def last_times(spark: SparkSession, path: str, assets: DataFrame) -> DataFrame:
    """(asset_key, last) of the given assets; other assets' partitions are not read."""
    return read_store(spark, path).join(assets.select(ASSET).distinct(), ASSET, "left_semi").groupBy(ASSET).agg(F.max("ts").alias("last"))


def load_close(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Closes of one asset; the filter prunes to its partitions and reads two columns."""
    return read_store(spark, path).where(F.col(ASSET) == key).select(ASSET, "ts", "close")


def daily_returns(closes: DataFrame) -> DataFrame:
    return M.pct_change(closes, [ASSET], "ts", "close", "aret")
