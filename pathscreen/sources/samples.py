"""Seeded sample records per given id: plain returns, an equity curve, a too-smooth AR(1) curve."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pathscreen.functions.exprs import as_uniform, d, norm_ppf, stream_key, with_hash

PHI, MEAN, NOISE, FIRST = 0.6, 0.0014, 0.0007, 0.0016


def normals(ids: DataFrame, key: str, days: int, seed: int, salt: int) -> DataFrame:
    """(key, day, z): standard normals by hash of (seed, key, day)."""
    rows = ids.select(key).withColumn("_k", stream_key(F.col(key), seed, salt)).withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(days))))
    rows = with_hash(rows, "_h", "_k", F.col("day")).withColumn("_u", as_uniform("_h") + d(0.5 / 4294967296))
    return rows.select(key, "day", norm_ppf(F.col("_u")).alias("z"))


def returns(ids: DataFrame, key: str, days: int = 1100, mean: float = 0.0013, sd: float = 0.011, seed: int = 7) -> DataFrame:
    return normals(ids, key, days, seed, 11).select(key, "day", (d(mean) + d(sd) * F.col("z")).alias("ret"))


def flagged(ids: DataFrame, key: str, days: int = 800, seed: int = 7) -> DataFrame:
    """AR(1) returns with little noise: a record that must be flagged. ``days`` bounds the array per id."""
    z = normals(ids, key, days, seed, 12).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "z"))), lambda s: s["z"]).alias("_z"))
    step = F.aggregate(F.slice("_z", 2, days), F.array(d(FIRST)), lambda acc, e: F.concat(acc, F.array(
        d(MEAN) + d(PHI) * (F.element_at(acc, -1) - d(MEAN)) + d(NOISE) * e)))
    return z.select(key, F.posexplode(step).alias("day", "ret"))
