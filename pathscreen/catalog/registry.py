"""Registry of the named queries and of the SQL that states the same result."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(c, digits: int = 6) -> Column:
    """Rounded double without a negative zero, for comparison with other engines."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def pick(df: DataFrame, keys, doubles=(), plain=(), digits: int = 6) -> DataFrame:
    return df.select(*keys, *[rounded(c, digits).alias(c) for c in doubles], *plain)


# --- SQL text helpers -------------------------------------------------------------
def r(expr: str, digits: int = 6, name: str | None = None) -> str:
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0::DOUBLE) AS {name or expr}"


def horner_sql(x: str, coefs) -> str:
    out = f"({coefs[0]!r})::DOUBLE"
    for c in coefs[1:]:
        out = f"({out}*{x}+({c!r})::DOUBLE)"
    return out


def cdf_sql(x: str) -> str:
    from pathscreen.functions.exprs import _HART_D, _HART_N
    z = f"abs({x})"
    tail = "0.65::DOUBLE"
    for k in (4, 3, 2, 1):
        tail = f"({k}::DOUBLE/({z}+{tail}))"
    e = f"exp(-{z}*{z}/2)"
    c = (f"CASE WHEN {z}>37 THEN 0 WHEN {z}<7.07106781186547 THEN {e}*{horner_sql(z, _HART_N)}/{horner_sql(z, _HART_D)} "
         f"ELSE {e}/({z}+{tail})/2.506628274631::DOUBLE END")
    return f"(CASE WHEN {x}>0 THEN 1-({c}) ELSE ({c}) END)"


def ppf_sql(p: str) -> str:
    from pathscreen.functions.exprs import _ACK_A, _ACK_B, _ACK_C, _ACK_D
    q = f"({p}-0.5::DOUBLE)"
    s = f"({q}*{q})"
    low, high = f"sqrt(-2*ln({p}))", f"sqrt(-2*ln(1-({p})))"
    return (f"(CASE WHEN {p}<=0 OR {p}>=1 THEN 'nan'::DOUBLE WHEN {p}<0.02425::DOUBLE THEN {horner_sql(low, _ACK_C)}/{horner_sql(low, _ACK_D)} "
            f"WHEN {p}>1-0.02425::DOUBLE THEN -{horner_sql(high, _ACK_C)}/{horner_sql(high, _ACK_D)} "
            f"ELSE {horner_sql(s, _ACK_A)}*{q}/{horner_sql(s, _ACK_B)} END)")


def mix_sql(x: str) -> str:
    """Same integer finalizer; ``x`` must be a plain column reference or small expression."""
    def half(v):
        return f"((xor({v}, ({v})>>16)*73244475)%4294967296)"
    y = half(half(x))
    return f"xor({y}, ({y})>>16)"


def uniform_sql(stream: str, *parts: str) -> str:
    h = stream
    for p in parts:
        h = mix_sql(f"(({h}+(({p})%2147483648)*2654435761)%4294967296)")
    return f"(({h})::DOUBLE/4294967296)"


def stream_sql(key: str, seed: int, salt: int) -> str:
    return f"('0x'||substr(md5('{seed}:{salt}:'||({key})::VARCHAR),1,8))::BIGINT"
