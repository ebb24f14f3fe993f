"""From messy tables to typed series: names, roles, numbers, dates.

Tables of many files are kept long: columns(file, col_no, name) and cells(file, col_no, row_no, txt).
Per-column facts are aggregates, so one huge file is combined before any shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pathscreen.functions.exprs import d, first_when, micros, pearson
from pathscreen.functions import names as N
from pathscreen.operators import metrics as M, scan
from pathscreen.operators.metrics import ID
from pathscreen.staging import stage


# --- names ------------------------------------------------------------------------------------
def normalize_columns(columns: DataFrame) -> DataFrame:
    return columns.withColumn("norm", N.normalize_column_name(F.col("name")))


def dedupe_column_names(columns: DataFrame) -> DataFrame:
    """Repeated names of a file get _2, _3 in column order (columns per file are few)."""
    base = F.when(F.col("norm") == "", "column").otherwise(F.col("norm"))
    rows = columns.withColumn("_b", base)
    k = F.row_number().over(Window.partitionBy("file", "_b").orderBy("col_no"))
    return rows.withColumn("unique_name", F.when(k == 1, F.col("_b")).otherwise(F.concat("_b", F.lit("_"), k.cast("string")))).drop("_b")


def match_hint(columns: DataFrame, hints, name: str = "norm") -> DataFrame:
    """Per file the column of the first hint that occurs, hints in priority order."""
    rows = columns.select("file", "col_no", F.col(name).alias("_n"), N.first_hint(F.col(name), hints).alias("_r")).where("_r > 0")
    best = F.min(F.struct(F.col("_r").alias("r"), "col_no", F.element_at(F.array(*map(F.lit, hints)), F.col("_r").cast("int")).alias("hint"), F.col("_n").alias("n")))
    return rows.groupBy("file").agg(best.alias("b")).select("file", F.col("b.hint").alias("hint"), F.col("b.col_no").alias("col_no"), F.col("b.n").alias("column"))


def pick_date_column(profile: DataFrame) -> DataFrame:
    """First hinted column, else column 0 when over 80% of it parses; no row means the file is rejected."""
    rows = profile.withColumn("_h", N.any_hint(F.col("norm"), N.DATE_HINTS))
    usable = F.when(F.col("_h"), F.struct(F.lit(0).alias("p"), "col_no", "norm")).when(
        (F.col("col_no") == 0) & (F.col("date_share") > 0.8), F.struct(F.lit(1).alias("p"), "col_no", "norm"))
    return rows.groupBy("file").agg(F.min(usable).alias("b")).where("b IS NOT NULL").select(
        "file", F.col("b.col_no").alias("date_col"), F.col("b.norm").alias("date_name"))


def pick_value_column(profile: DataFrame, dates: DataFrame) -> DataFrame:
    """Sole numeric column, else the first hinted numeric one. ``code`` names the failure."""
    rows = profile.join(dates.select("file", "date_col"), "file").where("col_no <> date_col AND numeric_share > 0.8")
    hinted = N.any_hint(F.col("norm"), N.RETURN_HINTS + N.EQUITY_HINTS)
    item = F.struct("col_no", "norm")
    agg = rows.groupBy("file").agg(F.count(F.lit(1)).alias("k"), F.min(item).alias("_only"), F.min(F.when(hinted, item)).alias("_hint"))
    out = dates.select("file").join(agg, "file", "left")
    pick = F.when(F.col("k") == 1, F.col("_only")).otherwise(F.col("_hint"))
    code = F.when(F.col("k").isNull(), "no_numeric").when(pick.isNull(), "ambiguous_value")
    return out.select("file", pick["col_no"].alias("value_col"), pick["norm"].alias("value_name"), code.alias("code"))


# --- numbers -------------------------------------------------------------------------------------
def _bare(txt: Column) -> Column:
    return F.replace(F.replace(F.trim(txt), F.lit("%"), F.lit("")), F.lit(" "), F.lit(""))


def to_double(text: Column) -> Column:
    """The double a text holds. Times and dates with two separators hold none and are not tried, as each failure is an exception in Java."""
    dated = F.contains(text, F.lit(":")) | text.rlike(r"^\d+[-/.]\d+[-/.]")
    return F.when(~dated, text.try_cast("double"))


def number_rules(cells: DataFrame, keys=("file",), txt: str = "txt") -> DataFrame:
    """Per column: do most values carry a percent sign, are most decimal commas."""
    t = F.trim(F.col(txt))
    return cells.groupBy(*keys).agg(
        (F.avg(t.endswith("%").cast("double")) > 0.5).alias("is_pct"),
        (F.avg(_bare(F.col(txt)).rlike(r"^-?\d+,\d+$").cast("double")) > 0.5).alias("comma"))


def to_number(txt: Column, is_pct: Column, comma: Column) -> Column:
    bare = _bare(txt)
    num = to_double(F.when(comma, F.replace(bare, F.lit(","), F.lit("."))).otherwise(F.replace(bare, F.lit(","), F.lit(""))))
    return F.when(is_pct, num / d(100)).otherwise(num)


def percent_name(name: Column) -> Column:
    return (F.contains(name, F.lit("pct")) | F.contains(name, F.lit("percent"))) & ~F.contains(name, F.lit("ratio"))


def coerce_numeric(cells: DataFrame, keys=("file",), txt: str = "txt", name: Column | None = None) -> DataFrame:
    """Numeric value per cell; percent by sign or by column name ("ratio" names are never percent)."""
    rules = number_rules(cells, keys, txt)
    rows = cells.join(rules, list(keys))
    rows = rows.withColumn("is_pct", F.col("is_pct") | (F.lit(False) if name is None else percent_name(name)))
    return rows.withColumn("value", to_number(F.col(txt), F.col("is_pct"), F.col("comma"))).drop("comma")


# --- dates ---------------------------------------------------------------------------------------
def date_unit(median: Column) -> Column:
    """Unit of numeric dates by their typical magnitude."""
    return first_when(
        ((median >= 20_000) & (median < 80_000), "serial"), ((median >= 19_000_000) & (median < 30_000_000), "yyyymmdd"),
        ((median >= 1e8) & (median < 1e11), "s"), ((median >= 1e11) & (median < 1e14), "ms"),
        ((median >= 1e14) & (median < 1e17), "us"), ((median >= 1e17) & (median < 1e20), "ns"), (None, "text"))


_DAY_MONTH = r"^(\d{1,2})[/.](\d{1,2})[/.](\d{4})"
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_NAME = f"({'|'.join(_MONTHS)})[a-z]*"


def iso_text(text: Column, day_first: Column) -> Column:
    """The text with its date part in ISO order: 2024/1/2, 2024.01.02, 01/02/2024, 1.2.2024, Jan 2, 2024 and 2 January 2024."""
    month = lambda name: F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(name)).cast("string")
    name_first, day_name = f"(?i)^{_NAME}\\.? +(\\d{{1,2}}),? +(\\d{{4}})", f"(?i)^(\\d{{1,2}}) +{_NAME}\\.?,? +(\\d{{4}})"

    def named(pattern: str, at_month: int, at_day: int) -> Column:
        part = lambda i: F.regexp_extract(text, pattern, i)
        return F.concat(F.concat_ws("-", part(3), month(part(at_month)), part(at_day)), F.regexp_replace(text, pattern, ""))

    return first_when(
        (text.rlike(name_first), named(name_first, 1, 2)), (text.rlike(day_name), named(day_name, 2, 1)),
        (text.rlike(_DAY_MONTH) & day_first, F.regexp_replace(text, _DAY_MONTH, "$3-$2-$1")), (text.rlike(_DAY_MONTH), F.regexp_replace(text, _DAY_MONTH, "$3-$1-$2")),
        (None, F.regexp_replace(text, r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})", "$1-$2-$3")))


def parse_dates(cells: DataFrame, keys=("file",), txt: str = "txt", resolution: int = scan.RESOLUTION) -> DataFrame:
    """Timestamp per cell: ISO text and the forms of ``iso_text``, epoch s/ms/us/ns, spreadsheet serials or yyyymmdd numbers.

    Where day and month are both numbers before the year, a column is day first if some first number is above 12 and no
    second one is; otherwise month first."""
    return with_dates(cells.join(date_rules(cells, keys, txt, resolution), list(keys)), txt).drop("_day_first")


def date_rules(cells: DataFrame, keys=("file",), txt: str = "txt", resolution: int = scan.RESOLUTION) -> DataFrame:
    """Per column: ``unit`` of its dates and whether they are day first (``_day_first``). Runs a job: the ranks read the numbers
    several times, and a text inlined in them would be read anew for each use."""
    t = F.trim(F.col(txt))
    part = lambda i: F.when(t.rlike(_DAY_MONTH), F.regexp_extract(t, _DAY_MONTH, i).try_cast("int"))
    rows = stage(cells.select(*keys, F.abs(to_double(t)).alias("_abs"), part(1).alias("_d1"), part(2).alias("_d2")))
    med = scan.exact_quantiles(rows, list(keys), "_abs", {"_med": 0.5}, resolution, staged=True)
    above = lambda c: F.coalesce(F.max(c) > 12, F.lit(False))
    share = rows.groupBy(*keys).agg(F.avg(F.col("_abs").isNotNull().cast("double")).alias("_share"), (above("_d1") & ~above("_d2")).alias("_day_first"))
    return share.join(med, list(keys), "left").select(
        *keys, "_day_first", F.when(F.col("_share") > 0.8, F.coalesce(date_unit(F.col("_med")), F.lit("text"))).otherwise("text").alias("unit"))


def with_dates(cells: DataFrame, txt: str = "txt") -> DataFrame:
    """``ts`` per cell from the text and the columns of ``date_rules``."""
    rows = cells.withColumn("_num", to_double(F.trim(F.col(txt))))
    whole = F.trim(F.col(txt)).try_cast("long")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")

    def after(start, us):
        far = F.abs(us) < d(2.5e17)  # some 7,900 years; a number beyond is no date and gives null
        return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.when(far, us) / d(1_000_000)).cast("decimal(18,6)"))

    text = F.trim(F.col(txt))
    ts = first_when(
        (F.col("unit") == "serial", after(F.lit("1899-12-30 00:00:00").cast("timestamp_ntz"), F.round(F.col("_num") * d(86_400_000_000.0)))),
        (F.col("unit") == "yyyymmdd", F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)).try_cast("timestamp_ntz")),
        (F.col("unit") == "s", after(epoch, F.col("_num") * d(1_000_000))), (F.col("unit") == "ms", after(epoch, F.col("_num") * d(1_000))),
        (F.col("unit") == "us", after(epoch, whole.cast("double"))), (F.col("unit") == "ns", after(epoch, F.floor(F.when(F.abs("_num") < d(2.5e20), F.col("_num")) / d(1000)).cast("double"))),
        (None, F.regexp_replace(iso_text(text, F.col("_day_first")), r"\s*(Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz")))
    return rows.withColumn("ts", ts).drop("_num")


# --- series ---------------------------------------------------------------------------------------
def clean_series(raw: DataFrame, min_rows: int = 3) -> tuple[DataFrame, DataFrame]:
    """(clean, rejects): null rows go, the last row per time stays, short series are rejected."""
    ok = raw.where("ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('infinity')")
    kept = scan.keep_last(ok, [ID, "ts"], ["row_no"])
    sizes = kept.groupBy(ID).agg(F.count(F.lit(1)).alias("_n"))
    short = raw.select(ID).distinct().join(sizes.where(F.col("_n") >= min_rows), ID, "left_anti").select(
        ID, F.lit("short_series").alias("code"), F.lit("too few valid rows").alias("message"))
    return kept.join(sizes.where(F.col("_n") >= min_rows), ID, "left_semi"), short


def detect_input_type(series: DataFrame, name: Column | None = None, chunk: str = scan.CHUNK) -> DataFrame:
    """returns or equity, by column name, else sign, size and level autocorrelation."""
    rows = scan.running(series, [ID], ["ts"], chunk=chunk, lags={"_prev": "value"})
    agg = rows.groupBy(ID).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("value") < 0).alias("has_negative"),
                               pearson("value", "_prev").alias("_ac"), *( [F.max(name).alias("_name")] if name is not None else []))
    med = scan.exact_quantiles(series, [ID], "value", {"median": 0.5})
    f = agg.join(med, ID)
    ac = F.when((F.col("n") > 3) & F.col("_ac").isNotNull() & ~F.isnan("_ac"), F.col("_ac")).otherwise(d(0))
    by_value = first_when((F.col("has_negative"), "returns"), ((F.col("median") > 0.5) | (ac > 0.95), "equity"), (None, "returns"))
    if name is None:
        kind = by_value
    else:
        kind = F.when(N.any_hint(F.col("_name"), N.RETURN_HINTS), "returns").when(N.any_hint(F.col("_name"), N.EQUITY_HINTS), "equity").otherwise(by_value)
    return f.select(ID, "n", "has_negative", "median", ac.alias("level_autocorr"), kind.alias("input_type"))


def unit_sanity(returns: DataFrame) -> DataFrame:
    """Signs of percent values read as decimals, and returns at or below -100%."""
    q = scan.exact_quantiles(returns.withColumn("_a", F.abs("ret")), [ID], "_a", {"median_abs": 0.5, "p90_abs": 0.9})
    agg = returns.groupBy(ID).agg(
        F.bool_or(F.col("ret") <= -1).alias("reject"), F.avg((F.abs("ret") > 1).cast("double")).alias("big_share"),
        F.sum((F.col("ret") > 3).cast("long")).alias("extreme"))
    out = agg.join(q, ID)
    codes = F.array_compact(F.array(
        F.when((F.col("median_abs") > 0.20) | (F.col("p90_abs") > 0.80), F.lit("UNITS_LARGE")),
        F.when(F.col("big_share") > 0.5, F.lit("MOSTLY_ABOVE_ONE")).when(F.col("extreme") > 0, F.lit("EXTREME_BARS"))))
    return out.withColumn("codes", codes)


def equity_sanity(returns: DataFrame) -> DataFrame:
    """Rejects: non-finite returns or growth above 1e9."""
    bad = F.isnan("ret") | (F.abs("ret") == d(float("inf")))
    agg = returns.groupBy(ID).agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("_bad"), F.product(d(1) + F.col("ret")).alias("growth"))
    code = F.when(F.col("_bad"), "non_finite").when(F.isnan("growth") | (F.col("growth") > 1e9), "implausible_growth")
    return agg.select(ID, "growth", code.alias("code"))


def bar_frequency(returns: DataFrame, chunk: str = scan.CHUNK) -> DataFrame:
    """Label of the median spacing between rows."""
    rows = scan.running(returns.select(ID, "ts"), [ID], ["ts"], chunk=chunk, lags={"_prev": "ts"}).where("_prev IS NOT NULL")
    sec = (micros("ts") - micros("_prev")).cast("double") / d(1_000_000)
    med = scan.exact_quantiles(rows.withColumn("sec", sec), [ID], "sec", {"median_sec": 0.5})
    s = F.col("median_sec")

    def label(x, unit):
        return F.concat(F.lit("~"), F.bround(x, 0).cast("long").cast("string"), F.lit(unit))

    return med.withColumn("bar_freq", first_when(
        (s <= 0, "unknown"), (s < 5400, label(s / d(60), "min")), (s < 72_000, label(s / d(3600), "h")), (s < 172_800, "daily"),
        (s < 777_600, "weekly"), (s < 3_888_000, "monthly"), (None, label(s / d(86_400), "d"))))


def forward_looking_scan(columns: DataFrame, name: str = "norm", file: str = "file") -> DataFrame:
    """Markers of leaked data in the file name and all suspicious columns (columns per file are few)."""
    prefixed = F.lit(False)
    for p in N.FORWARD_PREFIXES:
        prefixed = prefixed | F.col(name).startswith(p)
    stem = F.regexp_replace(F.lower(file), r"\.(csv|tsv|txt|xlsx|xls|xlsm)$", "")
    rows = columns.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.when(prefixed, F.struct("col_no", name)))), lambda x: x[name]).alias("columns"))
    return rows.withColumn("name_marker", stem.rlike("|".join(N.FORWARD_MARKERS))).withColumn("suspect", F.col("name_marker") | (F.size("columns") > 0))


def detect_trade_log(columns: DataFrame, name: str = "norm", medians: DataFrame | None = None) -> DataFrame:
    """Roles of a trade log per file: entry, exit, event and PnL column (names and, as *_col, numbers) and how its unit is decided."""
    n = F.col(name)
    per_trade = N.first_hint(n, N.NOT_PNL) == 0
    # the hints' places are columns, as each is read more than once
    places = {"en": N.first_hint(n, N.ENTRY_HINTS), "ex": N.first_hint(n, N.EXIT_HINTS), "ev": N.first_hint(n, N.EVENT_HINTS),
              "pp": F.when(per_trade, N.first_hint(n, N.PCT_HINTS)), "pd": F.when(per_trade & ~n.rlike("usd"), N.first_hint(n, N.DEC_HINTS))}
    rows = columns.select("file", "col_no", n.alias("n"), *(place.alias(f"_{role}") for role, place in places.items()))
    roles = rows.groupBy("file").agg(*(F.min(F.when(F.col(f"_{role}") > 0, F.struct(F.col(f"_{role}").alias("r"), "col_no", "n"))).alias(role) for role in places))
    c = F.col
    event_log = c("en").isNull() & c("ex").isNotNull() & c("ev").isNotNull()
    both = c("en").isNotNull() & c("ex").isNotNull() & (c("en.col_no") != c("ex.col_no"))
    f = roles.where(event_log | both).withColumn("event_log", event_log)
    f = f.join(medians, "file", "left") if medians is not None else f.withColumn("median_abs", F.lit(None).cast("double"))
    unit = first_when((c("pp").isNotNull(), "percent_by_name"), (c("pd").isNull(), "absolute_only"),
                      (c("pd.n").rlike("pct|percent"), "percent_by_name"), (F.contains(c("pd.n"), F.lit("ratio")), "decimal_by_name"),
                      (c("median_abs") > 20, "refused"), (c("median_abs") > 1, "percent_guessed"), (c("median_abs") > 0.5, "decimal_ambiguous"), (None, "decimal_guessed"))
    return f.select("file", c("en.n").alias("entry"), c("ex.n").alias("exit"), c("ev.n").alias("event"), F.coalesce("pp.n", "pd.n").alias("pnl"), "event_log", unit.alias("unit"),
                    c("en.col_no").alias("entry_col"), c("ex.col_no").alias("exit_col"), c("ev.col_no").alias("event_col"), F.coalesce("pp.col_no", "pd.col_no").alias("pnl_col"))
