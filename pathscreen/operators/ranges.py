"""Growth and drawdown over many windows of one path, without a copy of its rows per window.

A path is summed up by calendar chunk, and over the chunks stands a sparse table: the summaries of all runs of 1, 2, 4, ... chunks.
Summaries (rows, growth, highest and lowest level, worst drawdown) of neighbouring stretches combine, so a window is the rows of its first and
last chunk, read in place, and one run for every binary digit of the number of chunks between. What moves per window is two chunks and a dozen summaries, however long it is.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pathscreen.functions.exprs import d, micros
from pathscreen.operators import scan
from pathscreen.staging import stage

_MICROS = {"day": 86_400_000_000, "hour": 3_600_000_000}


def chunk_number(ts: str, unit: str) -> Column:
    """Whole number of the calendar unit a time lies in."""
    if unit == "month":
        return (F.year(ts) * 12 + F.month(ts)).cast("long")
    if unit not in _MICROS:
        raise ValueError(f"unit is month, {' or '.join(_MICROS)}")
    return F.floor(micros(ts) / F.lit(_MICROS[unit]))


def empty_stretch() -> Column:
    return F.struct(F.lit(0).cast("long").alias("n"), d(1).alias("g"), d(1).alias("hi"), d(1).alias("lo"), d(0).alias("dd"))


def combined(a: Column, b: Column) -> Column:
    """The summary of two neighbouring stretches."""
    return F.struct((a["n"] + b["n"]).alias("n"), (a["g"] * b["g"]).alias("g"), F.greatest(a["hi"], a["g"] * b["hi"]).alias("hi"), F.least(a["lo"], a["g"] * b["lo"]).alias("lo"),
                    F.least(a["dd"], b["dd"], a["g"] * b["lo"] / a["hi"] - d(1)).alias("dd"))


def _summary() -> Column:
    return F.struct(F.col("rows").alias("n"), "g", "hi", "lo", F.col("cdd").alias("dd"))


def sparse_table(folds: DataFrame, key: str, ends: DataFrame) -> DataFrame:
    """(key, level, at, s): s sums up the 2^level chunks from ``at`` on, of ``folds(key, _chunk, ...)`` (``scan.chunk_folds`` by chunk numbers) and their first and last chunk
    ``ends(key, first, last)``. Chunks without rows count as empty; runs that reach beyond the last chunk are left out. A key has as many rows as chunks in its calendar, times the levels."""
    longest = ends.agg(F.max(F.col("last") - F.col("first") + 1)).first()[0] or 1
    spine = ends.select(key, "last", F.explode(F.sequence("first", "last")).alias("_chunk"))
    rows = spine.join(folds, [key, "_chunk"], "left").select(key, "last", F.col("_chunk").alias("at"), F.when(F.col("rows").isNotNull(), _summary()).otherwise(empty_stretch()).alias("s0"))
    along = Window.partitionBy(key).orderBy("at")
    levels = longest.bit_length()
    for level in range(1, levels):
        rows = rows.withColumn("ahead", F.lead(f"s{level - 1}", 1 << (level - 1)).over(along)).withColumn(f"s{level}", combined(F.col(f"s{level - 1}"), F.col("ahead")))
    runs = F.explode(F.array(*(F.struct(F.lit(level).alias("level"), F.lit(1 << level).cast("long").alias("size"), F.col(f"s{level}").alias("s")) for level in range(levels))))
    return rows.select(key, "at", "last", runs.alias("r")).where(F.col("at") + F.col("r.size") - 1 <= F.col("last")).select(key, "at", "r.level", "r.s")


def window_folds(bars: DataFrame, windows: DataFrame, key: str, name: str, ret: str, chunk: str = scan.CHUNK) -> DataFrame:
    """(name, n, growth, mdd) per window: ``bars(key, ts, ret)`` inside ``windows(name, key, lo, hi)``, both ends included; a window begins at its first bar, whose own
    return does not count.

    One window per ``name``; windows without a bar have no row. Null returns count as zero. Returns at or below -1 end the path at zero, as in ``scan.fold_path``. Runs jobs: the bars are staged
    by chunk. Times are unique per key; an empty table gives an empty result.
    """
    rows = stage(bars.where("ts IS NOT NULL").select(key, "ts", F.coalesce(ret, d(0)).alias("ret"), chunk_number("ts", chunk).alias("at")))
    table = sparse_table(scan.chunk_folds(rows, [key], ["ts"], "ret", F.col("at")), key, rows.groupBy(key).agg(F.min("at").alias("first"), F.max("at").alias("last")))
    spans = windows.select(name, key, "lo", "hi", chunk_number("lo", chunk).alias("c_lo"), chunk_number("hi", chunk).alias("c_hi"))

    firsts = rows.groupBy(key, "at").agg(F.min("ts").alias("first_ts"))
    later = Window.partitionBy(key).orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    ends = firsts.groupBy(key).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    spine = ends.select(key, F.explode(F.sequence(F.col("first"), F.col("last"))).alias("at"))
    nexts = spine.join(firsts, [key, "at"], "left").withColumn("next_ts", F.last("first_ts", ignorenulls=True).over(later)).select(key, F.col("at").alias("c_lo"), "next_ts")
    inside = spans.join(rows.select(key, F.col("at").alias("c_lo"), "ts"), [key, "c_lo"]).where("ts >= lo").groupBy(name).agg(F.min("ts").alias("in_chunk"))
    before = spans.join(ends, key).where("c_lo < first").join(firsts.withColumnRenamed("at", "first"), [key, "first"]).select(name, F.col("first_ts").alias("from_start"))
    found = spans.join(inside, name, "left").join(nexts, [key, "c_lo"], "left").join(before, name, "left")
    begun = found.withColumn("begin", F.coalesce("in_chunk", "next_ts", "from_start")).where("begin <= hi")
    begun = stage(begun.select(name, key, "begin", "hi", chunk_number("begin", chunk).alias("c_lo"), "c_hi"))

    head = begun.join(rows.withColumnRenamed("at", "c_lo"), [key, "c_lo"]).where("ts > begin AND ts <= hi").select(name, "ts", "ret", F.lit(0).alias("at"))
    tail = begun.where("c_hi > c_lo").join(rows.withColumnRenamed("at", "c_hi"), [key, "c_hi"]).where("ts <= hi").select(name, "ts", "ret", F.lit(99).alias("at"))
    ragged = scan.chunk_folds(head.unionByName(tail), [name], ["ts"], "ret", F.col("at")).select(name, F.col("_chunk").alias("place"), _summary().alias("s"))

    between = begun.join(ends, key).withColumn("from", F.col("c_lo") + 1).withColumn("size", F.least(F.col("c_hi") - 1, "last") - F.col("c_lo")).where("size > 0")
    digit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(40)), lambda b: F.expr("size").bitwiseAND(F.lit(1).cast("long") * F.pow(F.lit(2.0), b).cast("long")) != 0))
    runs = between.select(name, key, "from", "size", digit.alias("level"))
    higher = F.expr("(size div CAST(power(2, level + 1) AS BIGINT)) * CAST(power(2, level + 1) AS BIGINT)")  # what longer runs cover comes first
    runs = runs.select(name, key, "level", (F.col("from") + higher).alias("at"), (F.lit(50) - F.col("level")).alias("place"))
    middle = runs.join(table, [key, "level", "at"]).select(name, "place", "s")

    parts = ragged.unionByName(middle).groupBy(name).agg(F.array_sort(F.collect_list(F.struct("place", "s"))).alias("parts"))  # at most one per binary digit, and two ends
    whole = begun.select(name).join(parts, name, "left").select(name, F.aggregate(F.coalesce("parts", F.array().cast("array<struct<place:int,s:struct<n:bigint,g:double,hi:double,lo:double,dd:double>>>")),
                                                                                   empty_stretch(), lambda a, p: combined(a, p["s"])).alias("s"))
    return whole.select(name, (F.col("s.n") + 1).alias("n"), F.col("s.g").alias("growth"), F.col("s.dd").alias("mdd"))
