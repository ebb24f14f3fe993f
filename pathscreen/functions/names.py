"""Column-name rules as Column builders."""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# Localized header words, in replacement order.
LOCAL_WORDS = (
    ("日期和时间", "datetime"), ("日期/时间", "datetime"), ("日期时间", "datetime"), ("交易编号", "trade_number"), ("交易号", "trade_number"),
    ("类型", "type"), ("信号", "signal"), ("方向", "direction"), ("价格", "price"), ("大小(数量)", "contracts"), ("大小(价值)", "position_value"),
    ("合约数", "contracts"), ("数量", "quantity"), ("净盈亏", "net_pnl"), ("净损益", "net_pnl"), ("净利润", "net_pnl"), ("有利波动", "run_up"),
    ("不利波动", "drawdown"), ("最大有利变动", "run_up"), ("最大不利变动", "drawdown"), ("累计", "cumulative"), ("百分比", "pct"), ("时间", "time"),
)
# Alias -> canonical name.
NAME_ALIASES = (
    ("date_time", "datetime"), ("date_utc", "date"), ("time_utc", "time"), ("close_date", "exit_date"), ("close_time", "exit_time"),
    ("closing_time", "exit_time"), ("closed_time", "exit_time"), ("open_date", "entry_date"), ("open_time", "entry_time"),
    ("opening_time", "entry_time"), ("opened_time", "entry_time"), ("net_p_l", "net_pnl"), ("net_p_l_pct", "net_pnl_pct"),
    ("net_profit_pct", "net_pnl_pct"), ("profit_percent", "profit_pct"), ("pnl_percent", "pnl_pct"), ("pl_pct", "pnl_pct"),
    ("p_l_pct", "pnl_pct"), ("cum_profit", "cumulative_pnl"), ("cumulative_profit", "cumulative_pnl"),
    ("cumulative_pnl_pct", "cumulative_return"), ("portfolio_value", "equity"), ("portfolio_equity", "equity"), ("net_liquidation", "equity"),
)
# Role hints in priority order.
DATE_HINTS = ("datetime", "date", "timestamp", "time", "dt", "bar")
PRICE_HINTS = ("adj_close", "close", "price", "last", "settle", "nav", "value")
RETURN_HINTS = ("return", "returns", "return_pct", "ret", "ret_pct", "pnl_pct", "pnl", "profit_pct", "profit_ratio", "daily_ret",
                "daily_return", "strategy_ret", "strategy_return", "chg", "change")
EQUITY_HINTS = ("equity", "nav", "balance", "cum", "value", "wealth", "capital", "curve")
ENTRY_HINTS = ("entry_time", "entry_date", "entry_dt", "entry", "open_time", "opened", "open_date", "open_timestamp", "buy_date", "filled_time")
EXIT_HINTS = ("exit_time", "exit_date", "exit_dt", "exit", "close_time", "closed", "close_date", "close_timestamp", "sell_date",
              "date_time", "datetime", "time")
PCT_HINTS = ("net_pnl_pct", "pnl_pct", "pnl_percent", "return_pct", "ret_pct", "profit_pct", "pct_return")
DEC_HINTS = ("profit_ratio", "return_ratio", "pnl_ratio", "net_pnl", "pnl", "return", "returns", "ret", "profit", "pl")
EVENT_HINTS = ("type", "signal", "direction", "side")
TRADE_HINTS = ("trade_number", "trade_id", "trade", "id")
SYMBOL_HINTS = ("symbol", "ticker", "asset", "pair", "instrument")
NOT_PNL = ("cum", "cumulative", "total", "mfe", "mae", "fee", "comm", "commission", "running")
FORWARD_MARKERS = ("leaky", "lookahead", "look_ahead", "future")
FORWARD_PREFIXES = ("future_", "forward_", "target_", "next_")


def normalize_column_name(name: Column) -> Column:
    """Lower-case ASCII snake name with localized words and known aliases resolved."""
    v = F.replace(F.lower(F.trim(name)), F.lit("﻿"), F.lit(""))
    for src, dst in (("（", "("), ("）", ")"), ("％", "%"), *LOCAL_WORDS, ("p&l", "pnl"), ("p/l", "pnl"), ("%", " pct ")):
        v = F.replace(v, F.lit(src), F.lit(dst))
    v = F.regexp_replace(F.regexp_replace(v, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    table = F.create_map(*chain.from_iterable((F.lit(a), F.lit(b)) for a, b in NAME_ALIASES))
    return F.coalesce(F.try_element_at(table, v), v)


def has_hint(name: Column, hint) -> Column:
    """The hint as whole ``_``-separated words of the name ("dt" is not part of "width")."""
    hint = F.lit(hint) if isinstance(hint, str) else hint
    return F.contains(F.concat(F.lit("_"), name, F.lit("_")), F.concat(F.lit("_"), hint, F.lit("_")))


def first_hint(name: Column, hints) -> Column:
    """Place of the first hint that the name has, from 1; 0 for none. A lambda over the one name keeps the plan short."""
    words = F.concat(F.lit("_"), name, F.lit("_"))
    return F.array_position(F.transform(F.array(*[F.lit(f"_{h}_") for h in hints]), lambda h: F.contains(words, h)), True)


def any_hint(name: Column, hints) -> Column:
    out = has_hint(name, hints[0])
    for h in hints[1:]:
        out = out | has_hint(name, h)
    return out
