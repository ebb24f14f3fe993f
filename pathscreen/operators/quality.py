"""Upload checks: shape, personal data, time zones, units, date quality."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pathscreen.functions.exprs import d, first_when
from pathscreen.operators import scan
from pathscreen.staging import stage

# Column names per role.
DATE_NAMES = ("exit_date", "exit_dt", "exit_time", "close_time", "closed_time", "close_datetime", "date", "bar_dt", "datetime", "timestamp",
              "time", "entry_date", "entry_dt", "entry_time")
RETURN_NAMES = ("return", "returns", "return_pct", "trade_return", "trade_return_pct", "strategy_ret", "strategy_return", "daily_ret",
                "daily_return", "ret", "ret_pct", "net_pnl_pct", "pnl_pct", "pnl", "profit_pct", "profit_ratio", "chg", "change")
EQUITY_NAMES = ("equity", "nav", "balance", "cumulative_return", "cum_return", "value", "wealth")
PRICE_NAMES = ("close", "adj_close", "price", "last", "settle")
POSITION_NAMES = ("signal", "position", "qty", "quantity", "side")
ENTRY_NAMES = ("entry_date", "entry_dt", "entry_time", "open_date", "open_time")
# Patterns of personal column names and of personal values, in order of precedence.
PII_NAMES = (
    ("email", r"email|e_mail|mail"), ("phone", r"phone|mobile|tel|whatsapp|wechat|weixin"),
    ("account", r"account|acct|client|customer|user_id|uid|姓名|名字|客户|账户"),
    ("credential", r"api[_-]?key|secret|token|password|private[_-]?key|mnemonic"),
    ("address", r"wallet|address|addr|iban|swift"), ("note", r"note|comment|remark|memo"))
PII_VALUES = (
    ("email", r"[\w.+-]+@[\w-]+\.[\w.-]+"), ("credential", r"(?i)(sk_live_|rk_live_|whsec_|api[_-]?key|secret|token)"),
    ("phone", r"\+?\d(?:[\s().-]*+\+?\d){8}"),
    ("wallet", r"\b(0x[a-fA-F0-9]{40}|[13][a-km-zA-HJ-NP-Z1-9]{25,34}|bc1[ac-hj-np-z02-9]{25,87})\b"))
OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


def preflight_shape(columns: DataFrame, name: str = "norm") -> DataFrame:
    """Shape of each file from its column names."""
    n = F.col(name)

    def has(names):
        return F.bool_or(n.isin(*names))

    f = columns.groupBy("file").agg(has(DATE_NAMES).alias("dt"), has(RETURN_NAMES).alias("rt"), has(EQUITY_NAMES).alias("eq"),
                                    has(PRICE_NAMES).alias("px"), has(POSITION_NAMES).alias("po"), has(ENTRY_NAMES).alias("en"))
    c = F.col
    shape = first_when((c("dt") & c("rt") & (c("en") | c("po")), "trade_log"), (c("dt") & c("eq"), "equity"), (c("dt") & c("rt"), "returns"),
                       (c("dt") & c("px") & c("po"), "signal_price_preview"), (None, "unknown"))
    return f.select("file", c("dt").alias("has_date"), c("rt").alias("has_return"), c("eq").alias("has_equity"), shape.alias("shape"))


def first_kind(text: Column, patterns) -> Column:
    out = None
    for kind, rx in patterns:
        out = F.when(text.rlike(rx), kind) if out is None else out.when(text.rlike(rx), kind)
    return out


def pii_column_names(columns: DataFrame, name: str = "norm") -> DataFrame:
    return columns.withColumn("kind", first_kind(F.lower(name), PII_NAMES)).where("kind IS NOT NULL")


def pii_values(texts: DataFrame, group: str, text: str) -> DataFrame:
    """Personal data in whole texts: per group the rows with each kind and the leading kind."""
    t = F.col(text)
    rows = texts.select(F.col(group).alias("column"), *[t.rlike(rx).alias(kind) for kind, rx in PII_VALUES])
    agg = rows.groupBy("column").agg(*[F.sum(F.coalesce(F.col(k), F.lit(False)).cast("long")).alias(k) for k, _ in PII_VALUES])
    return agg.withColumn("kind", F.coalesce(*[F.when(F.col(k) > 0, k) for k, _ in PII_VALUES]))


def date_quality(cells: DataFrame, key: str = "file", txt: str = "txt", ts: str = "ts") -> DataFrame:
    """Valid, invalid and repeated times, range and time-zone status of a date column.

    Repeats are counted over (file, time) pairs that were combined before the shuffle.
    """
    zone = F.coalesce(F.trim(F.col(txt)).rlike(OFFSET), F.lit(False))
    per = cells.groupBy(key, ts).agg(F.count(F.lit(1)).alias("_n"), F.bool_or(zone).alias("_z"))
    known = F.col(ts).isNotNull()
    out = per.groupBy(key).agg(
        F.sum("_n").alias("rows"), F.coalesce(F.sum(F.when(known, F.col("_n"))), F.lit(0)).alias("valid"),
        F.coalesce(F.sum(F.when(known, F.col("_n") - 1)), F.lit(0)).alias("duplicates"), F.min(ts).alias("start"), F.max(ts).alias("end"), F.bool_or("_z").alias("_zone"))
    out = out.withColumn("invalid", F.col("rows") - F.col("valid"))
    out = out.withColumn("timezone", F.when(F.col("_zone"), "explicit").when(F.col("valid") == 0, "unknown").otherwise("naive_local"))
    return out.withColumn("time_status", F.when(F.col("valid") == 0, "bad_time").when(
        F.col("valid") < F.greatest(F.lit(2), F.floor(d(0.8) * F.col("rows"))), "many_bad_times").otherwise("ok")).drop("_zone")


def return_unit_hint(values: DataFrame, key: str = "file", value: str = "value") -> DataFrame:
    """Percent, decimal or ambiguous by the size of the values. Runs a job: the ranks read the values several times, and the rule
    that makes a number of a text would be worked out anew for each use."""
    q = scan.exact_quantiles(stage(values.select(key, F.abs(value).alias("_a"))), [key], "_a", {"p95_abs": 0.95})
    return q.withColumn("unit", F.when(F.col("p95_abs") > 2, "percent").when(F.col("p95_abs") <= 1, "decimal").otherwise("ambiguous"))


def preflight_report(shapes: DataFrame, dates: DataFrame, units: DataFrame, pii: DataFrame, numeric_share: DataFrame) -> DataFrame:
    """One row per file: blocked, warning or ready, with the issues in order. All inputs have one row per file."""
    c = F.col
    f = (shapes.join(dates, "file", "left").join(units.select("file", "unit"), "file", "left")
         .join(pii.groupBy("file").agg(F.count(F.lit(1)).alias("_pii")), "file", "left").join(numeric_share, "file", "left"))

    def issue(cond, code, severity):
        return F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))

    f = f.withColumn("issues", F.array_compact(F.array(
        issue(c("_pii") > 0, "pii_columns", "warning"), issue(~c("has_date"), "missing_time", "blocker"),
        issue(c("has_date") & (c("timezone") == "naive_local"), "timezone_assumption", "warning"),
        issue(c("has_date") & (c("time_status") == "bad_time"), "bad_time", "blocker"),
        issue(c("has_date") & (c("time_status") == "many_bad_times"), "many_bad_times", "blocker"),
        issue(c("has_date") & (c("duplicates") > 0), "duplicate_times", "warning"),
        issue((c("shape") == "unknown") & ~(c("has_date") & (c("has_return") | c("has_equity"))), "unknown_shape", "blocker"),
        issue(c("has_return") & (c("numeric_share") < 0.6), "bad_returns", "blocker"),
        issue(c("has_return") & (c("unit") == "ambiguous"), "ambiguous_return_units", "warning"))))
    severe = F.exists("issues", lambda i: i["severity"] == "blocker")
    return f.withColumn("status", F.when(severe, "blocked").when(F.size("issues") > 0, "warning").otherwise("ready")).select("file", "shape", "status", "issues")


def preflight_score(report: DataFrame, facts: DataFrame, rejects: DataFrame) -> DataFrame:
    """Readiness for scoring: what the loader rejects is blocked, blockers of the report are dropped.

    facts: (file, n, warnings); rejects: (file, message).
    """
    c = F.col
    f = report.join(facts, "file", "left").join(rejects.groupBy("file").agg(F.min("message").alias("_reject")), "file", "left")
    kept = F.filter("issues", lambda i: i["severity"] != "blocker")
    fixes = F.array_compact(F.transform(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: F.when(w.rlike("percent"), "units_standardized").when(
        w.rlike("dropped"), "invalid_rows_removed").when(w.rlike("auto-detected"), "structure_detected")))
    status = F.when(c("_reject").isNotNull(), "blocked").when(F.size(kept) > 0, "warning").otherwise("ready")
    return f.select("file", status.alias("status"), F.when(c("_reject").isNotNull(), F.array(F.lit("engine_reject"))).otherwise(
        F.transform(kept, lambda i: i["code"])).alias("codes"), fixes.alias("fixes"))
