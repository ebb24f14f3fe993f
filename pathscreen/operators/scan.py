"""Ordered scans that never put a whole strategy into one task.

Running values (row number, equity, running peak) and exact ranks both need an order inside a group,
and one group may hold a third of all rows. Both are therefore done in two levels:

1. rows are hashed by (group, chunk), where the chunk is a monotone function of the order column
   (calendar month for time, a logarithmic bucket for values); every chunk is sorted on its own;
2. one summary row per chunk is scanned per group. The number of chunks of a group is bounded by the
   calendar or by the bucket grid, not by the data, so this second window stays small;
3. the carry of the previous chunks is joined back on (group, chunk). The rows are already hashed on
   that key, so only the summary moves.

A finer ``chunk`` ("day", "hour") suits second and tick bars.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pathscreen.functions.exprs import d
from pathscreen.staging import stage

CHUNK = "month"
_BEFORE = (Window.unboundedPreceding, -1)
_UPTO = (Window.unboundedPreceding, Window.currentRow)


def time_chunk(ts, unit: str) -> Column:
    """Start of the calendar unit; a null time has a chunk of its own before all others, so its row stays."""
    start = F.date_trunc(unit, F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")
    return F.coalesce(start, F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, chunk: str | Column = CHUNK,
            keep_chunk: bool = False, counts: bool = False, sums: dict | None = None, maxes: dict | None = None,
            maxes_before: dict | None = None, lags: dict | None = None, compound: str | None = None) -> DataFrame:
    """Add running columns to every row, ordered by ``order`` within ``keys``.

    counts    -> idx (1-based row number), n (rows of the group)
    sums      -> {out: column} inclusive running sum
    maxes     -> {out: column} inclusive running maximum
    maxes_before -> {out: column} maximum of the earlier rows only (null on the first)
    lags      -> {out: column} value of the previous row (null on the first)
    compound  -> growth factors of this return column: equity, peak (both starting at 1), dd
    order[0] is a timestamp unless ``chunk`` is a column of its own; further columns break ties.
    keep_chunk leaves the hashed ``_chunk`` column in place for a following co-located step.
    """
    keys, sums, lags, earlier = list(keys), sums or {}, lags or {}, maxes_before or {}
    maxes = {**(maxes or {}), **earlier}
    part = [*keys, "_chunk"]
    w = Window.partitionBy(*part).orderBy(*order)
    upto, before = w.rowsBetween(*_UPTO), Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(*_BEFORE)
    over_chunks = Window.partitionBy(*keys).orderBy("_chunk")

    unit = time_chunk(order[0], chunk) if isinstance(chunk, str) else chunk
    rows = df.withColumn("_chunk", unit).withColumn("_i", F.row_number().over(w))
    for out, src in sums.items():
        rows = rows.withColumn(f"_s_{out}", F.sum(src).over(upto))
    for out, src in maxes.items():
        rows = rows.withColumn(f"_m_{out}", F.max(src).over(w.rowsBetween(*_BEFORE) if out in earlier else upto))
    for out, src in lags.items():
        rows = rows.withColumn(f"_l_{out}", F.lag(src).over(w))
    if compound:
        rows = rows.withColumn("_g", F.product(d(1) + F.col(compound)).over(upto))
        rows = rows.withColumn("_h", F.max("_g").over(upto))

    aggs = [F.count(F.lit(1)).alias("_cn")]
    aggs += [F.sum(src).alias(f"_cs_{out}") for out, src in sums.items()]
    aggs += [F.max(src).alias(f"_cm_{out}") for out, src in maxes.items()]
    aggs += [F.max_by(F.col(src), F.col("_i")).alias(f"_cl_{out}") for out, src in lags.items()]
    if compound:
        aggs += [F.max_by("_g", "_i").alias("_cg"), F.max("_h").alias("_ch")]
    summary = rows.groupBy(*part).agg(*aggs)

    cols = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)] + [F.col("_chunk").alias("_kc")]
    if counts:
        cols += [F.coalesce(F.sum("_cn").over(before), F.lit(0)).alias("_bn"),
                 F.sum("_cn").over(Window.partitionBy(*keys)).alias("n")]
    cols += [F.coalesce(F.sum(f"_cs_{o}").over(before), d(0)).alias(f"_bs_{o}") for o in sums]
    cols += [F.max(f"_cm_{o}").over(before).alias(f"_bm_{o}") for o in maxes]
    cols += [F.lag(f"_cl_{o}").over(over_chunks).alias(f"_bl_{o}") for o in lags]
    if compound:
        summary = summary.withColumn("_bg", F.coalesce(F.product("_cg").over(before), d(1)))
        cols += [F.col("_bg"), F.greatest(d(1), F.max(F.col("_bg") * F.col("_ch")).over(before)).alias("_bp")]
    carry = summary.select(*cols)

    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_chunk") == F.col("_kc")]
    out = rows.join(carry, on)
    if counts:
        out = out.withColumn("idx", F.col("_i") + F.col("_bn"))
    for o in sums:
        out = out.withColumn(o, F.col(f"_bs_{o}") + F.col(f"_s_{o}"))
    for o in maxes:
        out = out.withColumn(o, F.greatest(f"_bm_{o}", f"_m_{o}"))
    for o in lags:
        out = out.withColumn(o, F.when(F.col("_i") == 1, F.col(f"_bl_{o}")).otherwise(F.col(f"_l_{o}")))
    if compound:
        out = (out.withColumn("equity", F.col("_bg") * F.col("_g"))
                  .withColumn("peak", F.greatest(F.col("_bp"), F.col("_bg") * F.col("_h")))
                  .withColumn("dd", F.col("equity") / F.col("peak") - d(1)))
    made = (["idx", "n"] if counts else []) + [*sums, *maxes, *lags] + (["equity", "peak", "dd"] if compound else [])
    kept = [c for c in df.columns if c not in made and c != "_chunk"]
    return out.select(*kept, *made, *(["_chunk"] if keep_chunk else []))


# --- drawdown without carrying rows -----------------------------------------------
def chunk_folds(df: DataFrame, keys: Sequence[str], order: Sequence[str], ret: str,
                chunk: Column | str = CHUNK) -> DataFrame:
    """One (g, hi, lo, dd) summary per (keys, chunk): growth, largest and smallest prefix, worst drawdown.

    Summaries combine associatively, so drawdowns of any length need only these rows (``fold_path``).
    """
    expr = time_chunk(order[0], chunk) if isinstance(chunk, str) else chunk
    part = [*keys, "_chunk"]
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(*_UPTO)
    rows = df.withColumn("_chunk", expr).withColumn("_g", F.product(d(1) + F.col(ret)).over(w))
    rows = rows.withColumn("_h", F.greatest(d(1), F.max("_g").over(w)))
    return rows.groupBy(*part).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(ret).alias("sum_ret"),
        F.product(d(1) + F.col(ret)).alias("g"),
        F.greatest(d(1), F.max("_g")).alias("hi"),
        F.least(d(1), F.min("_g")).alias("lo"),
        F.least(d(0), F.min(F.col("_g") / F.col("_h") - d(1))).alias("cdd"),
    )


def fold_path(folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Combine chunk summaries: rows, growth and the exact maximum drawdown of each group."""
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(*_BEFORE)
    step = folds.withColumn("_bg", F.coalesce(F.product("g").over(before), d(1)))
    step = step.withColumn("_bp", F.greatest(d(1), F.max(F.col("_bg") * F.col("hi")).over(before)))
    step = step.withColumn("_dd", F.least(F.col("cdd"), F.col("_bg") * F.col("lo") / F.col("_bp") - d(1)))
    return step.groupBy(*keys).agg(
        F.sum("rows").alias("n"), F.product("g").alias("growth"), F.min("_dd").alias("mdd"))


# --- exact ranks ----------------------------------------------------------------------
RESOLUTION = 16  # buckets per octave
FULL = 100_000   # distinct values of a bucket in one part; more are divided over its range


def value_bucket(v: Column, resolution: int = RESOLUTION) -> Column:
    """Monotone integer bucket of a double; at most about 4300 * resolution distinct buckets."""
    size = F.floor(F.log2(F.abs(v)) * d(resolution)) + F.lit(1100 * resolution)
    endless = F.abs(v) == d(float("inf"))  # infinities have end buckets of their own
    return F.when(endless, F.signum(v) * F.lit(4400 * resolution)).when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("long")


def ordered_values(df: DataFrame, keys: Sequence[str], value: str,
                   resolution: int = RESOLUTION, full: int = FULL, staged: bool = False) -> DataFrame:
    """Distinct values of each group with ``cnt``, ``below`` (rows before it in value order) and ``n``.

    Equal values are merged before the shuffle; buckets are then ordered independently. A bucket of many distinct
    values (times of some years, levels close to 1) is cut into equal parts of the range that its values take.
    ``staged`` writes the values with their parts (a job), so that the driver plans the ranks apart from what comes before.
    """
    keys = list(keys)
    part = [*keys, "_b", "_d"]
    distinct = (
        df.where(F.col(value).isNotNull() & ~F.isnan(value))
        .groupBy(*keys, value_bucket(F.col(value), resolution).alias("_b"), F.col(value))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    bounds = distinct.groupBy(*keys, "_b").agg(F.ceil(F.count(F.lit(1)) / full).alias("_p"), F.min(value).alias("_lo"), F.max(value).alias("_hi")).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), "_p", "_lo", "_hi")
    place = F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_p"))
    divided = F.when((F.col("_p") > 1) & (F.col("_hi") > F.col("_lo")), F.least(place, F.col("_p") - 1)).otherwise(F.lit(0)).cast("long")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_b") == F.col("_kb")]
    # left joins, here and below: every value has its row, and the values are never the side that is broadcast
    distinct = distinct.join(bounds, same, "left").select(*keys, "_b", divided.alias("_d"), value, "cnt")
    distinct = stage(distinct) if staged else distinct
    inside = Window.partitionBy(*part).orderBy(value).rowsBetween(*_BEFORE)
    rows = distinct.withColumn("_in", F.coalesce(F.sum("cnt").over(inside), F.lit(0)))
    before = Window.partitionBy(*keys).orderBy("_b", "_d").rowsBetween(*_BEFORE)
    carry = rows.groupBy(*part).agg(F.sum("cnt").alias("_c")).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), F.col("_d").alias("_kd"),
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"),
        F.sum("_c").over(Window.partitionBy(*keys)).alias("n"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_b") == F.col("_kb"), F.col("_d") == F.col("_kd")]
    return rows.join(carry, on, "left").select(
        *keys, value, "cnt", (F.col("_before") + F.col("_in")).alias("below"), "n")


def at_rank(value: str, rank: Column) -> Column:
    """Aggregate over ``ordered_values``: the value at a 0-based rank."""
    return F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("cnt")), F.col(value)))


def quantile_aggs(value: str, probs: dict[str, float]) -> list[Column]:
    """Linear-interpolated exact quantiles as aggregates over ``ordered_values`` rows."""
    out = []
    for name, p in probs.items():
        pos = d(p) * (F.col("n") - F.lit(1))
        lo, hi = at_rank(value, F.floor(pos)), at_rank(value, F.ceil(pos))
        frac = F.max(pos - F.floor(pos))
        out.append((lo + (hi - lo) * frac).alias(name))
    return out


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                    resolution: int = RESOLUTION, staged: bool = False) -> DataFrame:
    return ordered_values(df, keys, value, resolution, staged=staged).groupBy(*keys).agg(*quantile_aggs(value, probs))


# --- keep-last, keep-top --------------------------------------------------------------
def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key. The rank filter lets Spark drop losers before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def keep_last_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int,
                chunk: str = CHUNK) -> DataFrame:
    """The last ``limit`` rows of each group, by the chunked row number."""
    return running(df, keys, order, chunk=chunk, counts=True).where(
        F.col("idx") > F.col("n") - F.lit(limit)).drop("idx", "n")


def first_at_or_after(targets: DataFrame, bars: DataFrame, key: str, target_ts: str, bar_ts: str,
                      bar_cols: Sequence[str], chunk: str = CHUNK) -> DataFrame:
    """Forward as-of: each target gets the first bar of its key with bar_ts >= target_ts.

    Targets and bars meet in (key, chunk); a target with no later bar in its chunk takes the first bar
    of the next chunk that has one. ``bar_cols`` come back as a struct column ``bar`` (null if none).
    Both inputs are read twice: pass tables (or staged rows), not long derivations.
    """
    tcols = [c for c in targets.columns if c not in (key,)]
    bar = F.struct(F.col(bar_ts).alias("ts"), *[F.col(c).alias(c) for c in bar_cols])
    t = targets.select(F.col(key), F.col(target_ts).alias("_ts"), F.struct(*tcols).alias("_t"),
                       F.lit(0).alias("_kind"))
    b = bars.select(F.col(key), F.col(bar_ts).alias("_ts"), bar.alias("_bar"), F.lit(1).alias("_kind"))
    rows = t.unionByName(b, allowMissingColumns=True).withColumn("_chunk", time_chunk("_ts", chunk))
    # latest first, so that "the next bar" is the last one seen: a running window, linear in the rows
    ahead = Window.partitionBy(key, "_chunk").orderBy(F.desc("_ts"), F.desc("_kind")).rowsBetween(*_UPTO)
    rows = rows.withColumn("_hit", F.last("_bar", ignorenulls=True).over(ahead))
    firsts = rows.groupBy(key, "_chunk").agg(F.min_by("_bar", F.when(F.col("_kind") == 1, F.col("_ts"))).alias("_fb"))
    later = Window.partitionBy(key).orderBy(F.desc("_chunk")).rowsBetween(*_BEFORE)
    nxt = firsts.select(F.col(key).alias("_k"), F.col("_chunk").alias("_kc"),
                        F.last("_fb", ignorenulls=True).over(later).alias("_next"))
    out = rows.where("_kind = 0").join(nxt, (F.col(key) == F.col("_k")) & (F.col("_chunk") == F.col("_kc")))
    return out.select(key, "_t.*", F.coalesce("_hit", "_next").alias("bar"))
