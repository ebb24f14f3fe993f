"""Mixing sources to target weights with a time-varying curriculum.

Every source has a weight schedule over training time 0..1. The integral of the schedule up to t, scaled to the
source's token target, is its cumulative demand; a document copy that starts at the source's x-th word is trained at the
time at which demand reaches x. Copies are then sorted by ranges of that position.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pathscreen.llm.common import unused, words
from pathscreen.staging import stage

WEIGHTS = (5, 2, 1)       # of the sources in code point order, repeating
SHARE = 1.5               # of all words
MOST = 2                  # passes over a source at most
ROWS_PER_BUCKET = 2_000   # of one source's documents, for running sums
#: Weight at the start and at the end of training, by place in the order of sources; linear between.
SLOPES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, early, late from ``sizes(source, source_size)``, one row per source.

    Shares go by weight; a source above twice its size stops there and the excess goes to the others by weight. With the sources sorted by
    how soon they stop, running sums give the level at which no further one does.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS)))
    rows = sizes.withColumn("place", place).withColumn("weight", F.array(*map(F.lit, WEIGHTS))[F.col("place")].cast("double"))
    limit = F.col("source_size") * MOST / F.col("weight")
    by_limit = Window.orderBy(limit, F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    want = F.sum("source_size").over(every) * SHARE
    level = (want - F.coalesce(F.sum(F.col("source_size") * MOST).over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level).withColumn("limit", limit)
    found = F.min(F.when(F.col("level") <= F.col("limit"), F.struct("limit", "level"))).over(every)["level"]
    target = F.least((F.col("source_size") * MOST).cast("double"), F.col("weight") * found)
    slopes = F.array(*(F.struct(F.lit(a).alias("early"), F.lit(b).alias("late")) for a, b in SLOPES))
    return rows.select("source", "source_size", F.coalesce(target, (F.col("source_size") * MOST).cast("double")).alias("target"), slopes[F.col("place")]["early"].alias("early"), slopes[F.col("place")]["late"].alias("late"))


def when_reached(share: Column, early: Column, late: Column) -> Column:
    """The time t in 0..1 at which a demand with the linear schedule early..late has reached ``share`` of its total."""
    total = (early + late) / 2
    a, c = (late - early) / 2, share * total
    return F.least(F.lit(1.0), F.when(a == 0, share).otherwise((F.sqrt(F.greatest(F.lit(0.0), early * early + 4 * a * c)) - early) / (2 * F.when(a != 0, a))) + F.lit(0.0))


def _key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def mix_plan(docs: DataFrame, seed: int = 3) -> DataFrame:
    """doc_id, source, key, row, size, source_size, target, taken, positions of every row of ``docs(doc_id, text, source)``.

    size: words of the text. taken: size times the number of copies. positions: training time of each copy, ascending. A source's
    documents go in hashed order, pass after pass, as long as a copy ends within the target; then the one open document whose size is
    nearest to the rest is taken if that comes nearer. So the taken words miss the target by less than one document.
    Null or empty texts have size 0 and no copy, the null source is the last; ties and repeated rows are numbered (``row``)
    and count each; an empty table gives an empty result; other columns are not read. Runs jobs; no text is moved.
    """
    small = stage(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), _key(seed).alias("key")))
    sizes = stage(small.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    plan = targets(sizes.select("source", "source_size")).alias("p").join(sizes.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")))
    plan = stage(plan.select(F.col("p.source").alias("own"), "p.source_size", "target", "early", "late", F.ceil(F.col("n_docs") / ROWS_PER_BUCKET).alias("buckets")))
    small = small.join(plan, F.col("own").eqNullSafe(F.col("source"))).drop("own").withColumn("bucket", F.floor(F.pmod("key", F.lit(1 << 30)) * F.col("buckets") / (1 << 30)))
    bases = small.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    bases = stage(bases.select(F.col("source").alias("own"), F.col("bucket").alias("in"), (F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")).alias("base")))
    order = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    small = small.withColumn("within", before).withColumn("row", F.row_number().over(order))
    small = small.join(bases, F.col("source").eqNullSafe(F.col("own")) & (F.col("bucket") == F.col("in"))).withColumn("start", F.col("within") + F.col("base"))
    passes = F.floor((F.col("target") - F.col("start") - F.col("size")) / F.col("source_size")) + 1
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(MOST), passes)))
    small = stage(small.select("doc_id", "source", "size", "key", "row", "source_size", "target", "early", "late", "start", copies.alias("copies")))
    rest = stage(small.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("rest")).select(F.col("source").alias("own"), "rest"))
    fill = small.where((F.col("size") > 0) & (F.col("copies") < MOST)).join(rest, F.col("source").eqNullSafe(F.col("own")))
    one = F.struct("key", F.col("doc_id").isNull().alias("none"), "doc_id", "size", "row")
    fill = fill.groupBy("source").agg(F.min(F.struct(F.abs(F.col("rest") - F.col("size")).alias("miss"), one.alias("one"))).alias("best"), F.first("rest").alias("rest"))
    fill = stage(fill.where(F.col("best.miss") < F.col("rest")).select(F.col("source").alias("own"), "best.one"))
    small = small.join(fill, F.col("source").eqNullSafe(F.col("own")) & (F.col("one.key") == F.col("key")), "left")
    small = small.withColumn("copies", F.col("copies") + F.when(F.col("one").eqNullSafe(one) & F.col("one").isNotNull(), 1).otherwise(0))
    at = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.col("copies").cast("int")) - 1), lambda k: when_reached(
        F.least(F.lit(1.0), (F.col("start") + k * F.col("source_size")) / F.greatest(F.col("target"), F.lit(1.0))), F.col("early"), F.col("late")))
    at = F.when(F.col("copies") > 0, at).otherwise(F.array().cast("array<double>"))
    return small.select("doc_id", "source", "key", "row", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), at.alias("positions"))


def in_training_order(docs: DataFrame, seed: int = 3, position: str = "_position") -> DataFrame:
    """One row of ``docs`` per copy that the mix takes, with its training time, sorted by ranges of it.

    Cases as in ``mix_plan``; other columns, whatever their names, pass through, but for one named like ``position``, which is replaced."""
    plan, docs = mix_plan(docs, seed), docs.drop(position)
    key, nth, p_key, p_nth, at = unused([*docs.columns, position], "_key", "_nth", "_p_key", "_p_nth", "_p_positions")
    same = Window.partitionBy("_p_key").orderBy("_p_source", "_p_doc_id", "_p_row")
    plan = plan.select(*(F.col(c).alias(f"_p_{c}") for c in ("doc_id", "source", "key", "row", "positions"))).withColumn("_p_nth", F.row_number().over(same))
    plan = stage(plan.where(F.size("_p_positions") > 0).select("_p_key", "_p_nth", "_p_positions")).toDF(p_key, p_nth, at)
    # rows of one key are numbered alike on both sides; the window's partitioning also serves the join, so the text moves once before the sort
    rows = docs.withColumn(key, _key(seed)).withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy("source", "doc_id")))
    rows = rows.join(plan, (F.col(key) == F.col(p_key)) & (F.col(nth) == F.col(p_nth)))
    copies = rows.select(*docs.columns, F.explode(at).alias(position))
    return copies.repartitionByRange(F.col(position), F.col("doc_id")).sortWithinPartitions(position, "doc_id")
