"""Sinks: strict JSON reports, audit tables, minimal daily text."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pathscreen.functions.exprs import d, finite
from pathscreen.operators import metrics as M, scan
from pathscreen.operators.metrics import ID

_METRICS = ("cagr", "sharpe", "sortino", "calmar", "mdd", "cvar", "psr", "dsr", "bootstrap_p5")


def report_json(score: DataFrame) -> DataFrame:
    """(strategy_id, report): nested JSON text, non-finite numbers as null."""
    def clean(names):
        kinds = dict(score.dtypes)
        return [(finite(F.col(n)) if kinds[n] == "double" else F.col(n)).alias(n) for n in names]

    evidence = F.struct(F.col("evidence_status").alias("status"), F.col("evidence_reasons").alias("reason_codes"),
                        "benchmark_available", "benchmark_comparable", F.col("random_available").alias("random_control_available"), "metal_eligible")
    doc = F.struct(*clean(["display", "grade", "judgement", "tier", "headline", "overfit_risk", "uncapped", "capped", "random_p", "trial_budget"]),
                   F.struct(F.col("sample_hard").alias("thin"), F.col("edge_light").alias("edge")).alias("lights"), evidence.alias("evidence"),
                   F.struct(*clean(["return_quality", "credibility", "risk", "edge_score"])).alias("pillars"),
                   F.struct(*clean(_METRICS)).alias("metrics"), "flags", "cap_reasons", "subscore_flags")
    return score.select(ID, F.to_json(doc).alias("report"))


def write_reports(score: DataFrame, path: str, mode: str = "error") -> None:
    report_json(score).select("report").write.mode(mode).text(path)


def write_audit(rows: DataFrame, path: str, fmt: str = "csv", mode: str = "error") -> None:
    """Batch results as CSV (arrays joined by ' | '), JSON or Parquet."""
    if fmt == "csv":
        flat = [F.array_join(F.col(n).cast("array<string>"), " | ").alias(n) if t.startswith("array<string") else F.col(n)
                for n, t in rows.dtypes if not t.startswith(("struct", "array<struct", "map"))]
        rows.select(*flat).write.mode(mode).option("header", True).csv(path)
    else:
        rows.write.mode(mode).format(fmt).save(path)


@F.pandas_udf(T.StringType())
def _fixed(x: pd.Series, digits: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or v != v else f"{v:.{k}f}" for v, k in zip(x, digits)], dtype=object)


def number_text(x: Column, digits: int = 10) -> Column:
    """Plain decimal text with a fixed number of digits, trailing zeros removed. Rounded from the exact binary value, as C and Python do; Java's formatter
    rounds the shortest decimal text, which differs where that ends in a 5."""
    text = _fixed(x.cast("double"), F.lit(digits))
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def daily_minimal(returns: DataFrame, max_rows: int | None = None, min_rows: int = 30, chunk: str = scan.CHUNK) -> DataFrame:
    """Ordered ``date,return`` text per strategy with its SHA-256.

    A format that takes only so many days gets the last ``max_rows``; ``rows_total`` says how many there are.
    """
    daily = M.daily_compound(returns).withColumn("ts", F.col("day").cast("timestamp_ntz"))
    rows = scan.running(daily, [ID], ["ts"], chunk=chunk, counts=True)
    bad = rows.groupBy(ID).agg(F.bool_or(F.isnan("ret") | (F.col("ret") <= -1)).alias("_bad"))
    rows = rows.where((F.col("n") >= min_rows) & (F.lit(True) if max_rows is None else F.col("idx") > F.col("n") - max_rows)).join(bad.where("NOT _bad"), ID, "left_semi")
    line = F.struct("day", F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(","), number_text(F.col("ret"))).alias("line"))
    out = rows.groupBy(ID).agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("rows_total"), F.min("day").alias("start"), F.max("day").alias("end"),
                               F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]).alias("_l"))
    text = F.concat(F.lit("date,return\n"), F.array_join("_l", "\n"), F.lit("\n"))
    return out.withColumn("csv", text).withColumn("sha256", F.sha2(F.col("csv"), 256)).drop("_l")


def store_manifest(prices: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows and date range per asset of the store; expected assets without rows are failed."""
    have = prices.groupBy("asset_key").agg(F.count(F.lit(1)).alias("rows"), F.to_date(F.min("ts")).alias("start"), F.to_date(F.max("ts")).alias("end"))
    return expected.select("asset_key").distinct().join(have, "asset_key", "left").select(
        "asset_key", F.coalesce("rows", F.lit(0)).alias("rows"), "start", "end", F.col("rows").isNotNull().alias("ok"))
