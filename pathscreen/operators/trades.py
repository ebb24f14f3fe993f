"""Closed-trade logs: events, round trips, overlap, daily paths and concentration."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pathscreen.functions.exprs import MICROS_PER_DAY, d, first_when, micros
from pathscreen.operators import scan
from pathscreen.operators.metrics import ID
from pathscreen.staging import stage

# Words that mark entry and exit rows.
EXIT_WORDS = r"\b(exit|close|closed|cover)\b|出场|平仓|离场"
ENTRY_WORDS = r"\b(entry|open|opened)\b|进场|开仓|入场"


def event_masks(events: DataFrame, event: str = "event") -> DataFrame:
    """Mark entry and exit rows. Without any exit word, the rows that are not entries are exits."""
    text = F.lower(F.trim(F.coalesce(F.col(event), F.lit(""))))
    rows = events.withColumn("exit_like", text.rlike(EXIT_WORDS)).withColumn("entry_like", text.rlike(ENTRY_WORDS))
    rule = rows.groupBy(ID).agg(F.bool_or("exit_like").alias("_any_exit"), F.bool_or("entry_like").alias("_any_entry"))
    rows = rows.join(rule, ID)
    is_exit = (F.when(F.col("_any_exit"), F.col("exit_like"))
               .when(F.col("_any_entry"), ~F.col("entry_like")).otherwise(F.lit(False)))
    return rows.withColumn("is_exit", is_exit).withColumn("is_entry", F.col("entry_like")).drop(
        "exit_like", "entry_like", "_any_exit", "_any_entry")


def pair_first_entry(marked: DataFrame, min_share: float = 0.7, kept: tuple[str, ...] = ()) -> DataFrame:
    """Exit rows, with their columns ``kept``, and the first entry time of their trade; dropped where under 70% of exits map.

    Runs a job: the pairs are staged, as the shares and the result read them."""
    entries = marked.where("is_entry AND ts IS NOT NULL").groupBy(ID, "trade_id").agg(F.min("ts").alias("entry_ts"))
    exits = marked.where("is_exit").select(ID, "trade_id", F.col("ts").alias("exit_ts"), "ret", *kept)
    # by sort and merge: there are as many entries as exits, and their compressed file looks small enough to broadcast
    rows = stage(exits.hint("merge").join(entries, [ID, "trade_id"], "left"))
    share = rows.groupBy(ID).agg(F.avg(F.col("entry_ts").isNotNull().cast("double")).alias("_share"))
    rows = rows.join(share, ID)
    return rows.withColumn("entry_ts", F.when(F.col("_share") >= min_share, F.col("entry_ts"))).drop("_share")


def round_trips(marked: DataFrame) -> DataFrame:
    """First entry and last exit per trade id; trades without both or without a return are dropped."""
    last = F.struct("ts", "ret")
    out = marked.where("ts IS NOT NULL AND trade_id IS NOT NULL").groupBy(ID, "trade_id").agg(
        F.min(F.when(F.col("is_entry"), F.col("ts"))).alias("entry_ts"),
        F.max(F.when(F.col("is_exit"), last)).alias("_x"))
    return out.where("entry_ts IS NOT NULL AND _x.ret IS NOT NULL").select(
        ID, "trade_id", "entry_ts", F.col("_x.ts").alias("exit_ts"), F.col("_x.ret").alias("ret"))


def load_trades(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trades, facts per strategy, rejects) from raw trades with ``is_pct``.

    Percent values are divided by 100 and returns at or below -100% become -99.9%. The symbol is the
    first one given.
    """
    ok = raw.where("exit_ts IS NOT NULL AND ret IS NOT NULL AND NOT isnan(ret)")
    unit = F.when(F.col("is_pct"), F.col("ret") / d(100)).otherwise(F.col("ret"))
    rows = ok.withColumn("_r", unit)
    facts = rows.groupBy(ID).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("_r") <= -1).cast("long")).alias("clipped"),
        F.min_by("symbol", F.when(F.col("symbol").isNotNull(), F.col("trade_no"))).alias("symbol"))
    rows = rows.withColumn("ret", F.when(F.col("_r") <= -1, d(-0.999)).otherwise(F.col("_r"))).drop("_r")
    few = facts.where("n < 3").select(ID, F.lit("few_trades").alias("code"), F.lit("fewer than 3 valid trades").alias("message"))
    kept = rows.join(facts.where("n >= 3").select(ID), ID, "left_semi")
    return kept.drop("is_pct"), facts.where("n >= 3"), few


def holding_stats(trades: DataFrame, resolution: int = scan.RESOLUTION) -> DataFrame:
    """Median and mean holding days where enough trades have entry <= exit."""
    days = (micros("exit_ts") - micros("entry_ts")).cast("double") / d(MICROS_PER_DAY)
    rows = trades.withColumn("days", F.when(F.col("entry_ts") <= F.col("exit_ts"), days))
    agg = rows.groupBy(ID).agg(F.count(F.lit(1)).alias("n"), F.count("days").alias("valid"), F.avg("days").alias("holding_mean"))
    med = scan.exact_quantiles(rows, [ID], "days", {"holding_median": 0.5}, resolution, staged=True)
    need = F.greatest(F.lit(3), F.floor(d(0.7) * F.col("n")))
    return agg.where(F.col("valid") >= need).hint("merge").join(med, ID).select(ID, "n", "valid", "holding_median", "holding_mean")


def overlap_check(trades: DataFrame, chunk: str = scan.CHUNK) -> DataFrame:
    """Whether any trade starts before an earlier one has ended (a hand-over at the same time is fine)."""
    rows = scan.running(trades.select(ID, "trade_no", "entry_ts", "exit_ts"), [ID], ["entry_ts", "exit_ts", "trade_no"],
                        chunk=chunk, maxes_before={"latest_end": "exit_ts"})
    hit = F.coalesce(F.col("entry_ts") < F.col("latest_end"), F.lit(False))
    return rows.groupBy(ID).agg(F.count(F.lit(1)).alias("trades"), F.sum(hit.cast("long")).alias("overlap_count"),
                                F.bool_or(hit).alias("rejected"))


def trades_to_daily(trades: DataFrame, chunk: str = scan.CHUNK) -> DataFrame:
    """Spread each trade geometrically over its inclusive days; flat days return 0.

    Strategies with overlapping trades or fewer than 3 valid ones have no daily path. Runs jobs: the valid trades and the
    usable strategies are staged, as the check, the calendar and the growth read them.
    """
    valid = trades.where("entry_ts IS NOT NULL AND exit_ts >= entry_ts AND ret IS NOT NULL")
    valid = stage(valid.select(ID, "trade_no", "entry_ts", "exit_ts", "ret"))
    usable = stage(overlap_check(valid, chunk).where("NOT rejected AND trades >= 3").select(ID))
    rows = valid.join(usable, ID, "left_semi").withColumn("first_day", F.to_date("entry_ts")).withColumn("last_day", F.to_date("exit_ts"))
    span = rows.groupBy(ID).agg(F.min("first_day").alias("_a"), F.max("last_day").alias("_b"))
    spine = span.select(ID, F.explode(F.sequence("_a", "_b")).alias("day"))  # bounded by the calendar
    days = F.datediff("last_day", "first_day") + F.lit(1)
    factor = F.pow(d(1) + F.greatest(F.col("ret"), d(-0.999)), d(1) / days)
    growth = (rows.withColumn("_f", factor)
              .select(ID, "_f", F.explode(F.sequence("first_day", "last_day")).alias("day"))
              .groupBy(ID, "day").agg(F.product("_f").alias("_g")))
    return spine.join(growth, [ID, "day"], "left").select(ID, "day", (F.coalesce("_g", d(1)) - d(1)).alias("ret"))


def top_contributors(trades: DataFrame) -> DataFrame:
    """Shares of the 1, 3 and 5 largest wins and the compound return without the top 3.

    The rank filter is applied before the shuffle, so a hot strategy sends five rows per task.
    """
    r = F.col("ret")
    w = Window.partitionBy(ID).orderBy(F.col("ret").desc(), "trade_no")
    top = trades.where(r > 0).withColumn("_rk", F.row_number().over(w)).where("_rk <= 5").groupBy(ID).agg(
        *[F.sum(F.when(F.col("_rk") <= k, r).otherwise(d(0))).alias(f"_t{k}") for k in (1, 3, 5)],
        F.product(F.when(F.col("_rk") <= 3, d(1) + r).otherwise(d(1))).alias("_g3"))
    tot = trades.groupBy(ID).agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg((r > 0).cast("double")).alias("win_rate"),
        F.sum(F.when(r > 0, r).otherwise(d(0))).alias("_gain"), F.sum(F.when(r < 0, -r).otherwise(d(0))).alias("_loss"),
        F.product(d(1) + r).alias("_g"))
    j = tot.join(top, ID, "left")
    for k in (1, 3, 5):
        j = j.withColumn(f"top{k}_share", F.when(F.col("_gain") > 0, F.col(f"_t{k}") / F.col("_gain")).otherwise(d(0)))
    j = j.withColumn("compound_without_top3", F.col("_g") / F.coalesce("_g3", d(1)) - d(1))
    j = j.withColumn("trade_profit_factor", F.when(F.col("_loss") > 0, F.col("_gain") / F.col("_loss")))
    # diversification: high is good; dependency is its opposite
    j = j.withColumn("diversification", first_when((F.col("top3_share") < 0.45, "high"), (F.col("top3_share") < 0.70, "medium"), (None, "low")))
    j = j.withColumn("dependency", first_when((F.col("top3_share") < 0.45, "low"), (F.col("top3_share") < 0.70, "medium"), (None, "high")))
    return j.select(ID, "n_trades", "win_rate", "trade_profit_factor", "top1_share", "top3_share", "top5_share",
                    "compound_without_top3", "diversification", "dependency")
