"""Which asset did a strategy trade: names first, then correlation."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pathscreen.functions.exprs import d, first_when
from pathscreen.operators.benchmark import ASSET
from pathscreen.operators.metrics import ID
from pathscreen.staging import stage

MIN_OVERLAP = 60
BLOCK, BLOCK_DAYS = 256, 4096  # series and days of a dense matrix: 8 MB
# Quote suffixes (longest match first) and timeframe suffixes.
PAIR_SUFFIX = "|".join(("USDTPERP", "PERPUSDT", "USDT", "USDC", "BUSD", "PERP", "USD"))
TIMEFRAME = "|".join(("MINS", "MIN", "M", "H", "D", "W"))


def _strip_pair(tok: Column) -> Column:
    return F.regexp_replace(tok, f"^(.+?)({PAIR_SUFFIX})$", "$1")


def _strip_frame(tok: Column) -> Column:
    return F.regexp_replace(tok, rf"^([A-Z0-9]+?)\d+({TIMEFRAME})$", "$1")


def candidates(tok: Column) -> Column:
    """Symbols one upper-case token may stand for, most literal first."""
    base = _strip_frame(tok)
    return F.array_distinct(F.array(tok, _strip_pair(tok), base, _strip_pair(base)))


def name_tokens(name: Column) -> Column:
    stem = F.regexp_replace(F.element_at(F.split(name, r"[\\/]"), -1), r"(?i)\.(csv|txt|tsv|json)$", "")
    return F.filter(F.split(F.upper(stem), "[^A-Z0-9]+"), lambda t: t != "")


def token_candidates(df: DataFrame, name: str, key: str = ID) -> DataFrame:
    """(key, token position, candidate rank, candidate) rows of a name column."""
    toks = df.select(key, F.posexplode(name_tokens(F.col(name))).alias("tok_pos", "tok"))
    return toks.select(key, "tok_pos", "tok", F.posexplode(candidates(F.col("tok"))).alias("cand_rank", "candidate"))


def key_from_name(df: DataFrame, name: str, aliases: DataFrame, key: str = ID) -> DataFrame:
    """Asset named by exactly one alias hit; names that hit several assets stay open."""
    hits = token_candidates(df, name, key).join(aliases.withColumnRenamed("alias", "candidate"), "candidate")
    best = hits.groupBy(key, "tok_pos").agg(F.min_by(ASSET, "cand_rank").alias(ASSET))
    return best.groupBy(key).agg(F.count_distinct(ASSET).alias("_k"), F.min(ASSET).alias(ASSET)).where("_k = 1").drop("_k")


def semi_available(keys: DataFrame, store: DataFrame) -> DataFrame:
    """Named assets that have prices."""
    return keys.join(store.select(ASSET).distinct(), ASSET, "left_semi")


def _block_sums(strategies: pd.DataFrame, assets: pd.DataFrame, kinds: dict) -> pd.DataFrame:
    """Sums over the common days of every strategy with every asset of two blocks: products of dense (series x days) matrices."""
    out = {name: pd.Series(dtype=kind) for name, kind in kinds.items()}
    if len(strategies) == 0 or len(assets) == 0:
        return pd.DataFrame(out)
    first = min(strategies["day"].min(), assets["day"].min())
    width = int(max(strategies["day"].max(), assets["day"].max()) - first + 1)

    def dense(rows: pd.DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, names = pd.factorize(rows[key])
        values, there = np.zeros((len(names), width)), np.zeros((len(names), width))
        place = (at, rows["day"].to_numpy() - first)
        values[place], there[place] = rows[value], 1.0
        return names, values, there

    ids, x, mx = dense(strategies, ID, "ret")
    keys, y, my = dense(assets, ASSET, "aret")
    sums = {"n": mx @ my.T, "x": x @ my.T, "y": mx @ y.T, "xx": (x * x) @ my.T, "yy": mx @ (y * y).T, "xy": x @ y.T}
    met = np.nonzero(sums["n"])
    return pd.DataFrame({ID: ids[met[0]], ASSET: keys[met[1]], "n": sums["n"][met].astype(np.int64), **{c: sums[c][met] for c in ("x", "y", "xx", "yy", "xy")}})


def fingerprints(daily: DataFrame, asset_daily: DataFrame, min_overlap: int = MIN_OVERLAP, block: int = BLOCK, block_days: int = BLOCK_DAYS) -> DataFrame:
    """Correlation of every strategy with every asset over common days; both sides have one row per key and day.

    Blocked matrix products: ``block`` strategies meet ``block`` assets over ``block_days`` days in one task, which multiplies their
    dense matrices and overlap masks; sums over blocks of days are combined. A row moves once per block of the other side, not once per asset.
    A series whose variance over the common days is below 1e-13 of its mean square counts as constant and has no correlation.
    """
    kind = dict(daily.dtypes)[ID]
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < d(float("inf"))) & F.col("day").isNotNull()
    s = stage(daily.where(number("ret")).select(ID, F.unix_date("day").alias("day"), F.col("ret").cast("double").alias("ret")))
    a = stage(asset_daily.where(number("aret")).select(ASSET, F.unix_date("day").alias("day"), F.col("aret").cast("double").alias("aret")))
    parts = lambda rows, key: max(1, -(-rows.agg(F.approx_count_distinct(key)).first()[0] // block))
    s_blocks, a_blocks = parts(s, ID), parts(a, ASSET)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    days = F.floor(F.col("day") / F.lit(block_days)).cast("int").alias("db")
    s = s.select("*", own(ID, s_blocks).alias("sb"), days).withColumn("ab", every(a_blocks))
    a = a.select("*", own(ASSET, a_blocks).alias("ab"), days).withColumn("sb", every(s_blocks))
    kinds = {ID: "object" if kind == "string" else "int64", ASSET: "object", "n": "int64", **{c: "float64" for c in ("x", "y", "xx", "yy", "xy")}}
    tile = ["sb", "ab", "db"]
    sums = s.groupBy(*tile).cogroup(a.groupBy(*tile)).applyInPandas(lambda left, right: _block_sums(left, right, kinds), f"{ID} {kind}, {ASSET} string, n long, x double, y double, xx double, yy double, xy double")
    t = sums.groupBy(ID, ASSET).agg(F.sum("n").alias("overlap"), *(F.sum(c).alias(c) for c in ("x", "y", "xx", "yy", "xy")))
    spread = lambda one, two: F.col("overlap") * F.col(two) - F.col(one) * F.col(one)
    varies = lambda one, two: spread(one, two) > d(1e-13) * F.col("overlap") * F.col(two)
    corr = (F.col("overlap") * F.col("xy") - F.col("x") * F.col("y")) / (F.sqrt(spread("x", "xx")) * F.sqrt(spread("y", "yy")))
    return t.where((F.col("overlap") >= min_overlap) & varies("x", "xx") & varies("y", "yy")).select(ID, ASSET, "overlap", F.least(d(1), F.greatest(d(-1), corr)).alias("corr"))


def rank_corr(fp: DataFrame) -> DataFrame:
    """Rank per strategy by |corr| (assets per strategy are a fixed list) and the lead over the next one."""
    w = Window.partitionBy(ID).orderBy(F.abs("corr").desc(), ASSET)
    out = fp.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("_next", F.lead(F.abs("corr")).over(w))
    return out.withColumn("margin", F.abs("corr") - F.coalesce("_next", d(0))).drop("_next")


def anti_alternatives(ranked: DataFrame, best: DataFrame, limit: int = 4) -> DataFrame:
    """Other assets in rank order, without the chosen one."""
    rest = ranked.join(best.select(ID, ASSET), [ID, ASSET], "left_anti")
    w = Window.partitionBy(ID).orderBy("rank")
    return rest.withColumn("alt_rank", F.row_number().over(w).cast("long")).where(F.col("alt_rank") <= limit)


def detect_asset(ids: DataFrame, ranked: DataFrame, file_keys: DataFrame, symbol_keys: DataFrame) -> DataFrame:
    """Best asset, how it was found and the confidence. Symbol column, then file name, then correlation."""
    c = F.col
    top = ranked.where("rank = 1").select(ID, F.col(ASSET).alias("t_key"), F.col("corr").alias("t_corr"), F.col("overlap").alias("t_overlap"), "margin")
    fk = file_keys.select(ID, F.col(ASSET).alias("file_key"))
    sk = symbol_keys.select(ID, F.col(ASSET).alias("symbol_key"))
    f = ids.select(ID).join(top, ID, "left").join(fk, ID, "left").join(sk, ID, "left")
    named = ranked.select(ID, F.col(ASSET).alias("_n"), F.col("corr").alias("n_corr"), F.col("overlap").alias("n_overlap"))
    f = f.withColumn("_n", F.coalesce("symbol_key", "file_key")).join(named, [ID, "_n"], "left")
    agree = F.coalesce(F.abs("n_corr") >= 0.30, F.lit(False))
    by_symbol, by_file = c("symbol_key").isNotNull(), c("file_key").isNotNull()
    strong = F.abs("t_corr")
    f = f.withColumn("via", first_when(
        (by_symbol & agree, "symbol+corr"), (by_symbol & (c("file_key") == c("symbol_key")), "symbol+filename"), (by_symbol, "symbol"),
        (by_file & agree, "filename+corr"), (by_file, "filename"), (strong >= 0.25, "correlation"), (None, F.lit(None).cast("string"))))
    f = f.withColumn("confidence", first_when(
        (by_symbol, "high"), (by_file & agree, "high"), (by_file & c("n_corr").isNotNull(), "medium"),
        (by_file & F.coalesce(c("t_overlap") >= 30, F.lit(False)), "low"), (by_file, "medium"),
        ((strong >= 0.60) & (c("margin") >= 0.10), "high"), (strong >= 0.40, "medium"), (strong >= 0.25, "low"), (None, "none")))
    shows = c("via").isin("symbol+corr", "filename+corr") | ((c("via") == "filename") & c("n_corr").isNotNull())
    return f.select(
        ID, F.coalesce("_n", F.when(c("via") == "correlation", c("t_key"))).alias(ASSET), "via", "confidence", "file_key",
        F.when(shows, c("n_corr")).when(c("via") == "correlation", c("t_corr")).alias("corr"),
        F.when(shows, c("n_overlap")).when(c("via") == "correlation", c("t_overlap")).alias("overlap"))


def accepted(detections: DataFrame, minimum: str = "medium") -> DataFrame:
    """Detections at or above a confidence, as a benchmark map."""
    keep = {"high": ["high"], "medium": ["high", "medium"], "low": ["high", "medium", "low"]}[minimum]
    return detections.where(F.col("confidence").isin(keep)).select(ID, ASSET)


# Name fragments per profile.
CRYPTO_NAMES = "|".join(("BTC", "ETH"))
ALT_NAMES = "|".join(("SOL", "DOGE", "ADA", "AVAX", "XRP", "BNB", "LINK", "DOT", "LTC", "TRX", "BCH", "XLM", "ATOM", "UNI", "NEAR", "APT", "ARB", "OP", "INJ", "SUI", "ETC"))
INDEX_NAMES = "|".join(("CSI300", "A_SHARE", "SPY", "QQQ", "NDX", "SPX", "INDEX", "EQUITY"))


def profile_from_name(df: DataFrame, name: str, assets: DataFrame) -> DataFrame:
    """Profile of the named asset, else by name fragment, else ``other``."""
    prof = assets.select(ASSET, F.col("profile").alias("_p"))
    up = F.upper(name)
    guess = (F.when(up.rlike(CRYPTO_NAMES), "crypto").when(up.rlike(ALT_NAMES), "altcoin").when(up.rlike(INDEX_NAMES), "stock_index").otherwise("other"))
    return df.join(prof, ASSET, "left").withColumn("profile", F.coalesce("_p", guess)).drop("_p")
