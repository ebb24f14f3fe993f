"""Uploaded tables as cells to typed return series, with facts per column, warnings and rejects.

Everything works on long cells: facts of a column are aggregates combined before the shuffle, and a row's date and
value meet by (file, row), so one huge file is spread over many tasks. A file ends either in the series or in the
rejects, never in neither.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from pathscreen.functions import names as N
from pathscreen.operators import mapping as MP, metrics as M, scan, trades as T
from pathscreen.operators.metrics import ID
from pathscreen.staging import stage

COLUMN = ("file", "col_no")
MIN_ROWS = 3


@dataclass
class Loaded:
    """series(strategy_id, ts, ret); meta, one row per loaded file; warnings and rejects (strategy_id, code)."""

    series: DataFrame
    meta: DataFrame
    warnings: DataFrame
    rejects: DataFrame


@dataclass
class TradeLogs:
    """trades(strategy_id, trade_no, entry_ts, exit_ts, ret); meta, one row per loaded log; warnings and rejects (strategy_id, code)."""

    trades: DataFrame
    meta: DataFrame
    warnings: DataFrame
    rejects: DataFrame


@dataclass
class Uploads:
    """What came out of a batch of files of both kinds; ``rejects`` names every file that is in neither."""

    returns: Loaded
    logs: TradeLogs
    rejects: DataFrame


def typed_cells(cells: DataFrame) -> DataFrame:
    """cells(file, row_no from 0, col_no, name, txt) with ``norm``, ``value``, ``is_pct`` and ``ts`` per cell, by the rules of its column.

    Runs a job that stages the cells, as the rules and the cells read them. Names are normalized once a column."""
    cells, keys, at = stage(cells), list(COLUMN), F.array_position("_names", F.col("name")).cast("int") - 1
    names = cells.groupBy(*keys).agg(F.collect_set("name").alias("_names"))  # one, where the names come from a header
    names = names.withColumn("_norms", F.transform("_names", N.normalize_column_name)).withColumn("_by_name", F.transform("_norms", MP.percent_name))
    # one row per column, joined by sort and merge: by the size of their compressed files the planner would send rules and cells through the driver
    rules = stage(MP.number_rules(cells, keys).hint("merge").join(MP.date_rules(cells, keys), keys).hint("merge").join(names, keys))
    rows = cells.where("file IS NOT NULL AND col_no IS NOT NULL").hint("merge").join(rules, keys, "left").withColumn("norm", F.get("_norms", at)).withColumn("is_pct", F.col("is_pct") | F.get("_by_name", at))
    rows = rows.withColumn("value", MP.to_number(F.col("txt"), F.col("is_pct"), F.col("comma")))
    return MP.with_dates(rows).drop("comma", "_day_first", "_names", "_norms", "_by_name")


def column_profile(typed: DataFrame) -> DataFrame:
    """Facts per column: rows of its file, columns of its file, share of rows with a date and with a number, median magnitude."""
    size = typed.groupBy("file").agg((F.max("row_no") + 1).alias("rows"), F.count_distinct("col_no").alias("cols"))
    facts = typed.groupBy(*COLUMN).agg(F.min("norm").alias("norm"), F.count("ts").alias("dates"), F.count("value").alias("numbers"), F.bool_or("is_pct").alias("is_pct"))
    median = scan.exact_quantiles(typed.withColumn("_abs", F.abs("value")), COLUMN, "_abs", {"median_abs": 0.5}, staged=True)
    return facts.join(size, "file").hint("merge").join(median, list(COLUMN), "left").select(
        *COLUMN, "norm", "rows", "cols", (F.col("dates") / F.col("rows")).alias("date_share"), (F.col("numbers") / F.col("rows")).alias("numeric_share"), "median_abs", "is_pct")


def sheet_sizes(cells: DataFrame) -> DataFrame:
    """Rows and columns that hold data, per sheet: the sizes ``sources.files.sheet_select`` asks for."""
    return cells.groupBy("file", "sheet").agg((F.max("row_no") + 1).alias("rows"), F.count_distinct("col_no").alias("cols"))


def _codes(frame: DataFrame, code: str) -> DataFrame:
    return frame.select(F.col("file").alias(ID), F.lit(code).alias("code"))


def load_returns(cells: DataFrame) -> Loaded:
    """Return series of all files at once; runs jobs that stage the typed cells and the chosen columns.

    cells: file, row_no (0 is the first data row), col_no, name, txt, blank cells left out. Rejects: few_columns,
    trade_log (has entry and exit columns; see ``load_trade_logs``), no_date, no_numeric, ambiguous_value, short_series,
    total_loss, non_positive_equity, few_returns, non_finite, implausible_growth. Warnings: percent, rows_dropped,
    zero_span, forward_looking and the unit codes of ``mapping.unit_sanity``. Of rows with one time the last stays.
    """
    return _returns(*_typed(cells))


def _typed(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    typed = stage(typed_cells(cells))
    return typed, stage(column_profile(typed))


def _returns(typed: DataFrame, profile: DataFrame) -> Loaded:
    narrow = profile.where("cols < 2").select("file").distinct()
    logs = MP.detect_trade_log(profile.where("cols >= 2").select("file", "col_no", "norm")).select("file")
    plain = profile.where("cols >= 2").join(logs, "file", "left_anti")
    dates = stage(MP.pick_date_column(plain))
    values = stage(MP.pick_value_column(plain, dates))
    rejects = _codes(narrow, "few_columns").unionByName(_codes(logs, "trade_log"))
    rejects = rejects.unionByName(_codes(plain.select("file").distinct().join(dates, "file", "left_anti"), "no_date"))
    rejects = rejects.unionByName(values.where("code IS NOT NULL").select(F.col("file").alias(ID), "code"))

    choice = stage(dates.join(values.where("code IS NULL").drop("code"), "file"))
    is_date, is_value = F.col("col_no") == F.col("date_col"), F.col("col_no") == F.col("value_col")
    raw = stage(typed.join(choice, "file").where(is_date | is_value).groupBy("file", "row_no", "value_name").agg(
        F.max(F.when(is_date, F.col("ts"))).alias("ts"), F.max(F.when(is_value, F.col("value"))).alias("value")).withColumnRenamed("file", ID))
    clean, short = MP.clean_series(raw, MIN_ROWS)
    clean = stage(clean)
    kinds = stage(MP.detect_input_type(clean, name=F.col("value_name")).select(ID, "input_type"))
    levels = clean.join(kinds.where("input_type = 'equity'"), ID, "left_semi")
    plain_ret = clean.join(kinds.where("input_type = 'returns'"), ID, "left_semi").withColumn("ret", F.col("value"))
    bad = (levels.groupBy(ID).agg(F.min("value").alias("v")).where("v <= 0").select(ID, F.lit("non_positive_equity").alias("code"))
           .unionByName(plain_ret.groupBy(ID).agg(F.min("value").alias("v")).where("v <= -1").select(ID, F.lit("total_loss").alias("code"))))
    both = M.pct_change(levels, [ID], "ts", "value").select(ID, "ts", "ret").unionByName(plain_ret.select(ID, "ts", "ret"))
    both = stage(both.where(~F.isnan("ret") & (F.abs("ret") < float("inf"))).join(bad, ID, "left_anti"))
    few = (clean.select(ID).distinct().join(bad, ID, "left_anti").join(both.groupBy(ID).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_ROWS), ID, "left_anti")
           .select(ID, F.lit("few_returns").alias("code")))
    wild = MP.equity_sanity(both).where("code IS NOT NULL").select(ID, "code").join(few, ID, "left_anti")
    rejects = stage(rejects.unionByName(short.select(ID, "code")).unionByName(bad).unionByName(few).unionByName(wild))
    series = both.join(rejects, ID, "left_anti")

    names = choice.select(F.col("file").alias(ID), "date_name", "value_name")
    rows = profile.join(choice, "file").where(is_value).select(F.col("file").alias(ID), "rows", "is_pct")
    valid = raw.where("ts IS NOT NULL AND value IS NOT NULL").groupBy(ID).agg(F.count(F.lit(1)).alias("valid"))
    span = series.groupBy(ID).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    meta = span.join(names, ID).join(kinds, ID).join(rows, ID).join(valid, ID).join(MP.bar_frequency(series).select(ID, "bar_freq"), ID, "left")
    meta = stage(meta.select(ID, "input_type", F.col("value_name").alias("value_column"), F.col("date_name").alias("date_column"), "n", (F.col("rows") - F.col("valid")).alias("n_dropped"),
                             "start", "end", M.span_years_expr("start", "end").alias("span_years"), M.ppy_expr(F.col("n"), "start", "end").alias("ppy"), "bar_freq", "is_pct"))
    units = MP.unit_sanity(series.join(meta.where("input_type = 'returns'"), ID, "left_semi")).select(ID, F.explode("codes").alias("code"))
    ahead = MP.forward_looking_scan(profile.select("file", "col_no", "norm")).where("suspect").select(F.col("file").alias(ID), F.lit("forward_looking").alias("code"))
    notes = F.array_compact(F.array(F.when(F.col("is_pct"), F.lit("percent")), F.when(F.col("n_dropped") > 0, F.lit("rows_dropped")), F.when(F.col("span_years") <= 0, F.lit("zero_span"))))
    warnings = meta.select(ID, F.explode(notes).alias("code")).unionByName(units).unionByName(ahead.join(meta, ID, "left_semi"))
    return Loaded(series, meta.drop("is_pct"), warnings, rejects)


def load_trade_logs(cells: DataFrame) -> TradeLogs:
    """Closed trades of all files that are trade logs: an entry and an exit column, or one time column beside a column of event words.

    ``cells`` as for ``load_returns``; other files are left alone. Of event rows the exits are trades, and the first entry row of the same trade gives the entry time
    (if 70% of the exits find one); without any exit row all rows are trades. The unit of the result comes from the column's name, percent signs, or else the
    median of its cells. Times and numbers that do not parse drop their row. Rejects: absolute_only, unit_refused (a median above 20 is money or percent), few_trades (fewer than 3),
    non_finite, implausible_growth. Warnings: percent, decimal, unit_guessed, unit_ambiguous, clipped (returns at or below -100% are -99.9%), event_log, rows_dropped, zero_span, forward_looking.
    """
    return _trade_logs(*_typed(cells))


def load_uploads(cells: DataFrame) -> Uploads:
    """Files of both kinds at once; the cells are typed once. A file is in the returns, in the logs or in the rejects."""
    typed, profile = _typed(cells)
    returns, logs = _returns(typed, profile), _trade_logs(typed, profile)
    return Uploads(returns, logs, returns.rejects.where("code <> 'trade_log'").unionByName(logs.rejects))


def _log_roles(typed: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per trade log: its columns and unit. The event column is the first whose words tell exits from entries, else the first by name."""
    # staged step by step, and tables of a row per file or column joined by sort and merge: one plan of all of it, and what it broadcasts, weigh on the driver
    names = stage(MP.detect_trade_log(columns))
    own = names.select("file", F.col("pnl_col").alias("col_no")).hint("merge").join(columns.select("file", "col_no", "median_abs", "is_pct"), ["file", "col_no"])
    own = stage(own.select("file", "median_abs", F.col("is_pct").alias("signed")))
    roles = MP.detect_trade_log(columns, medians=own.select("file", "median_abs")).hint("merge").join(own.select("file", "signed"), "file", "left")
    events = columns.where(N.any_hint(F.col("norm"), N.EVENT_HINTS)).select("file", "col_no").hint("merge").join(names.where("event_log").select("file"), "file")
    text = F.lower(F.trim("txt"))
    words = typed.select("file", "col_no", "txt").join(events, ["file", "col_no"], "left_semi").groupBy("file", "col_no").agg(
        F.bool_or(text.rlike(T.EXIT_WORDS)).alias("exits"), F.bool_or(text.rlike(T.ENTRY_WORDS)).alias("entries"), F.bool_or(~text.rlike(T.ENTRY_WORDS)).alias("others"))
    best = words.groupBy("file").agg(F.min(F.struct((~(F.col("exits") | F.col("entries") & F.col("others"))).alias("mute"), "col_no"))["col_no"].alias("event_best"))
    hinted = lambda hints, name: MP.match_hint(columns, hints).select("file", F.col("col_no").alias(name))
    for more in (best, hinted(N.TRADE_HINTS, "trade_col"), hinted(N.SYMBOL_HINTS, "symbol_col")):
        roles = roles.hint("merge").join(more, "file", "left")
    percent = F.coalesce("signed", F.lit(False)) | F.col("unit").startswith("percent")
    return roles.withColumn("event_col", F.coalesce("event_best", "event_col")).withColumn("percent", percent).withColumn("divide", percent & ~F.coalesce("signed", F.lit(False))).drop("event_best")


def _trade_logs(typed: DataFrame, profile: DataFrame) -> TradeLogs:
    c = F.col
    roles = stage(_log_roles(typed, profile.where("cols >= 2")))
    usable = roles.where("unit NOT IN ('absolute_only', 'refused')")
    refused = roles.where("unit IN ('absolute_only', 'refused')").select(c("file").alias(ID), F.when(c("unit") == "refused", "unit_refused").otherwise(c("unit")).alias("code"))

    roles_of = ("entry_col", "exit_col", "pnl_col", "event_col", "trade_col", "symbol_col")
    # a left join, as its left side, the cells, is never broadcast; cells of other files have no role
    cells = typed.select("file", "row_no", "col_no", "txt", "value", "ts").join(usable.select("file", "event_log", "divide", *roles_of), "file", "left")
    cells = cells.where(F.greatest(*(F.coalesce((c("col_no") == c(r)).cast("int"), F.lit(0)) for r in roles_of)) == 1)
    cell = lambda role, what: F.max(F.when(c("col_no") == c(role), c(what)))
    rows = stage(cells.groupBy(c("file").alias(ID), "row_no", "event_log", c("divide").alias("is_pct")).agg(
        cell("entry_col", "ts").alias("entry_ts"), cell("exit_col", "ts").alias("exit_ts"), cell("pnl_col", "value").alias("ret"), cell("event_col", "txt").alias("event"),
        cell("trade_col", "txt").alias("trade_id"), cell("symbol_col", "txt").alias("symbol")))

    events = rows.where("event_log").select(ID, "row_no", "is_pct", c("exit_ts").alias("ts"), "event", "ret", "symbol", F.coalesce("trade_id", F.concat(F.lit("\0"), c("row_no").cast("string"))).alias("trade_id"))
    marked = T.event_masks(events)
    marked = marked.join(marked.groupBy(ID).agg(F.bool_or("is_exit").alias("told")), ID)
    marked = stage(marked.withColumn("is_exit", c("is_exit") | ~c("told")).withColumn("is_entry", c("is_entry") & c("told")))
    paired = T.pair_first_entry(marked, kept=("row_no", "is_pct", "symbol"))
    cols = [ID, (c("row_no") + 1).cast("long").alias("trade_no"), "entry_ts", "exit_ts", "ret", "is_pct", "symbol"]
    raw = stage(rows.where("NOT event_log").select(*cols).unionByName(paired.select(*cols)))
    trades, facts, few = T.load_trades(raw)
    trades = stage(trades.drop("symbol"))
    few = few.select(ID, "code").unionByName(_codes(usable.select("file").join(raw.where("exit_ts IS NOT NULL AND ret IS NOT NULL AND NOT isnan(ret)").select(c(ID).alias("file")).distinct(), "file", "left_anti"), "few_trades"))
    wild = MP.equity_sanity(trades).where("code IS NOT NULL").select(ID, "code")
    rejects = stage(refused.unionByName(few).unionByName(wild))
    trades = trades.join(rejects, ID, "left_anti")

    span = trades.groupBy(ID).agg(F.count(F.lit(1)).alias("n"), F.min("exit_ts").alias("start"), F.max("exit_ts").alias("end"))
    used = marked.groupBy(ID).agg(F.sum(c("is_exit").cast("long")).alias("used"), F.sum((~c("is_exit")).cast("long")).alias("n_ignored"))
    symbol = rows.groupBy(ID).agg(F.min_by("symbol", F.when(c("symbol").isNotNull(), c("row_no"))).alias("symbol"))
    size = profile.groupBy(c("file").alias(ID)).agg(F.max("rows").alias("rows"))
    named = roles.select(c("file").alias(ID), "event_log", "unit", "percent", c("pnl").alias("value_column"), c("exit").alias("date_column"))
    meta = span
    for part, how in ((named, "inner"), (size, "inner"), (facts.select(ID, "clipped"), "inner"), (symbol, "left"), (used, "left"), (stage(T.holding_stats(trades)).drop("n"), "left")):
        meta = meta.hint("merge").join(part, ID, how)  # a row per log on either side
    meta = stage(meta.select(ID, F.lit("trade_log").alias("input_type"), F.lit("closed_trade").alias("caliber"), "value_column", "date_column", "symbol", "n",
                             (F.coalesce("used", "rows") - c("n")).alias("n_dropped"), F.coalesce("n_ignored", F.lit(0)).alias("n_ignored"), "start", "end", M.span_years_expr("start", "end").alias("span_years"),
                             M.ppy_expr(c("n"), "start", "end").alias("ppy"), F.lit("per-trade").alias("bar_freq"), "unit", "percent", "event_log", "clipped",
                             F.coalesce("valid", F.lit(0)).alias("n_timed"), "holding_median", "holding_mean"))
    ahead = MP.forward_looking_scan(profile.select("file", "col_no", "norm")).where("suspect").select(c("file").alias(ID), F.lit("forward_looking").alias("code"))
    notes = F.array_compact(F.array(*(F.when(cond, F.lit(code)) for cond, code in (
        (c("percent"), "percent"), (~c("percent"), "decimal"), (c("unit").isin("percent_guessed", "decimal_guessed", "decimal_ambiguous"), "unit_guessed"), (c("unit") == "decimal_ambiguous", "unit_ambiguous"),
        (c("clipped") > 0, "clipped"), (c("event_log") & (c("n_ignored") > 0), "event_log"), (c("n_dropped") > 0, "rows_dropped"), (c("span_years") <= 0, "zero_span")))))
    warnings = meta.select(ID, F.explode(notes).alias("code")).unionByName(ahead.join(meta, ID, "left_semi"))
    return TradeLogs(trades.select(ID, "trade_no", "entry_ts", "exit_ts", "ret"), meta, warnings, rejects)
