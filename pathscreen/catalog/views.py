"""Deterministic track-record views over the benchmark tables, for Spark and as SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pathscreen.catalog.registry import table
from pathscreen.functions.exprs import d
from pathscreen.operators import scan
from pathscreen.staging import stage


def v_ret(spark: SparkSession, folder: str) -> DataFrame:
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .groupBy(F.col("c_nationkey").cast("long").alias("strategy_id"), F.col("o_orderdate").alias("ts"))
        .agg(((F.avg("o_totalprice") - F.lit(240000)) / F.lit(5000000)).alias("ret"))
    )


def v_dayret(spark, folder) -> DataFrame:
    li, p = table(spark, folder, "lineitem"), table(spark, folder, "part")
    return (
        li.join(p, li.l_partkey == p.p_partkey)
        .groupBy(F.col("p_brand").alias("asset_key"), F.col("l_shipdate").alias("ts"))
        .agg(((F.avg("l_discount") - d(0.049)) / F.lit(5)).alias("aret"), F.sum("l_quantity").alias("volume"))
    )


def v_px(spark, folder) -> DataFrame:
    rows = scan.running(v_dayret(spark, folder), ["asset_key"], ["ts"], compound="aret")
    return rows.select("asset_key", "ts", (d(100) * F.col("equity")).alias("close"), "volume")


def v_beta(spark, folder) -> DataFrame:
    b, a = v_ret(spark, folder), v_dayret(spark, folder)
    b = b.withColumn("asset_key", F.concat(F.lit("Brand#"), (F.col("strategy_id") + 1).cast("string")))
    return b.join(a, ["asset_key", "ts"]).select(
        "strategy_id", "ts", (d(0.8) * F.col("aret") + d(0.1) * F.col("ret")).alias("ret"))


def benchmark_map(spark, folder) -> DataFrame:
    ids = table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("strategy_id"))
    return ids.withColumn("asset_key", F.concat(F.lit("Brand#"), (F.col("strategy_id") + 1).cast("string")))


def v_trd(spark, folder) -> DataFrame:
    li, o = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    s, p = table(spark, folder, "supplier"), table(spark, folder, "part")
    rows = (
        li.join(o, li.l_orderkey == o.o_orderkey).join(s, li.l_suppkey == s.s_suppkey).join(p, li.l_partkey == p.p_partkey)
        .where("l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL '90' DAY")
        .withColumn("strategy_id", F.col("s_nationkey").cast("long")).withColumn("ret", (F.col("l_discount") - F.col("l_tax")) * d(0.5))
    )
    order = ["l_shipdate", "o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    # written once: the numbering reads its rows twice, and the joins would run for each
    rows = scan.running(stage(rows.select("strategy_id", *order, "ret", "p_brand")), ["strategy_id"], order, counts=True)
    return rows.select("strategy_id", F.col("idx").cast("long").alias("trade_no"), F.col("o_orderdate").alias("entry_ts"),
                       F.col("l_shipdate").alias("exit_ts"), "ret", F.col("p_brand").alias("symbol"))


LOGS = 100  # added to the number of a strategy whose record is its trade log


def v_logs(spark, folder) -> DataFrame:
    return v_trd(spark, folder).withColumn("strategy_id", F.col("strategy_id") + LOGS)


def v_both(spark, folder) -> DataFrame:
    """Bar returns of some strategies and closed trades of others, one return per time."""
    logs = v_logs(spark, folder).groupBy("strategy_id", F.col("exit_ts").alias("ts")).agg((F.product(d(1) + F.col("ret")) - d(1)).alias("ret"))
    return v_beta(spark, folder).unionByName(logs)


def both_map(spark, folder) -> DataFrame:
    plain = benchmark_map(spark, folder)
    return plain.unionByName(plain.withColumn("strategy_id", F.col("strategy_id") + LOGS))


def v_evt(spark, folder) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("strategy_id"), "ts", "event_id", ((F.col("value") - F.lit(45)) / F.lit(1000)).alias("ret"))


def v_txt(spark, folder) -> DataFrame:
    """Messy numbers per file: percent sign, decimal comma or plain decimals."""
    e = table(spark, folder, "events")
    small = ((F.col("value") - 45) / 1000).cast("decimal(12,5)").cast("string")
    text = (F.when(F.col("user_id") % 3 == 0,
                   F.concat(((F.col("value") - 45) / 10).cast("decimal(12,3)").cast("string"), F.lit("%")))
            .when(F.col("user_id") % 3 == 1, F.replace(small, F.lit("."), F.lit(",")))
            .otherwise(small))
    return e.select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"), F.col("event_id").alias("row_no"), text.alias("txt"))


SQL = {
    "v_ret": """SELECT CAST(c_nationkey AS BIGINT) strategy_id, o_orderdate ts, (avg(o_totalprice)-240000)/5000000 ret
        FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY c_nationkey, o_orderdate""",
    "v_dayret": """SELECT p_brand asset_key, l_shipdate ts, (avg(l_discount)-CAST(0.049 AS DOUBLE))/5 aret, sum(l_quantity) volume
        FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY p_brand, l_shipdate""",
    "v_px": """SELECT asset_key, ts, 100*product(1+aret) OVER (PARTITION BY asset_key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS close, volume FROM v_dayret""",
    "v_beta": """SELECT b.strategy_id, b.ts, CAST(0.8 AS DOUBLE)*a.aret + CAST(0.1 AS DOUBLE)*b.ret ret
        FROM v_ret b JOIN v_dayret a ON a.ts=b.ts AND a.asset_key=concat('Brand#', CAST(b.strategy_id+1 AS VARCHAR))""",
    "v_map": """SELECT n_nationkey::BIGINT strategy_id, concat('Brand#', (n_nationkey+1)::VARCHAR) asset_key FROM nation""",
    "v_trd": """SELECT CAST(s_nationkey AS BIGINT) strategy_id,
        row_number() OVER (PARTITION BY s_nationkey ORDER BY l_shipdate,o_orderdate,l_orderkey,l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice) trade_no,
        o_orderdate entry_ts, l_shipdate exit_ts, (l_discount-l_tax)*CAST(0.5 AS DOUBLE) ret, p_brand symbol
        FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN supplier ON l_suppkey=s_suppkey JOIN part ON l_partkey=p_partkey
        WHERE l_shipdate>=o_orderdate AND l_shipdate<=o_orderdate + INTERVAL '90' DAY""",
    "v_logs": f"SELECT strategy_id+{LOGS} strategy_id, trade_no, entry_ts, exit_ts, ret, symbol FROM v_trd",
    "v_both": "SELECT strategy_id, ts, ret FROM v_beta UNION ALL SELECT strategy_id, exit_ts, product(1+ret)-1 FROM v_logs GROUP BY 1, 2",
    "both_map": f"SELECT * FROM v_map UNION ALL SELECT strategy_id+{LOGS}, asset_key FROM v_map",
    "v_evt": """SELECT user_id strategy_id, ts, event_id, (value-45)/1000 ret FROM events""",
    "v_txt": """SELECT concat('f', CAST(user_id AS VARCHAR)) file, event_id row_no,
        CASE WHEN user_id%3=0 THEN concat(CAST(CAST((value-45)/10 AS DECIMAL(12,3)) AS VARCHAR), '%')
             WHEN user_id%3=1 THEN replace(CAST(CAST((value-45)/1000 AS DECIMAL(12,5)) AS VARCHAR), '.', ',')
             ELSE CAST(CAST((value-45)/1000 AS DECIMAL(12,5)) AS VARCHAR) END txt FROM events""",
}
_NEEDS = {"v_px": ["v_dayret"], "v_beta": ["v_ret", "v_dayret"], "v_logs": ["v_trd"], "v_both": ["v_beta", "v_logs"], "both_map": ["v_map"]}


def path_sql(src: str, order: str = "ts", keys: str = "strategy_id") -> str:
    """CTE body: idx, n, prev, equity, peak, dd of a return table."""
    w = f"(PARTITION BY {keys} ORDER BY {order})"
    return f"""SELECT *, equity/peak-1 dd FROM (SELECT *, greatest(1, max(equity) OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING)) peak
        FROM (SELECT *, row_number() OVER {w} idx, count(*) OVER (PARTITION BY {keys}) n, lag(ret) OVER {w} prev,
        product(1+ret) OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING) equity FROM {src}))"""


YEAR_US = "31557600000000.0::DOUBLE"


def base_sql(src: str, keys: str = "strategy_id", ts: str = "ts", extra: str = "", ppy: str | None = None) -> str:
    """CTE body: the one-pass metrics of a return table."""
    ppy = ppy or "CASE WHEN span_years>0 THEN n/span_years ELSE 252.0::DOUBLE END"
    return f"""SELECT *,
      CASE WHEN n=0 OR ppy<=0 THEN 0 WHEN growth<=0 THEN -1 ELSE pow(growth, ppy/n)-1 END cagr,
      CASE WHEN n<2 OR sd IS NULL OR sd<1e-12 THEN 0 ELSE mean/sd*sqrt(ppy) END sharpe,
      CASE WHEN n<2 THEN 0 WHEN downside_sq=0 THEN CASE WHEN mean>0 THEN 'inf'::DOUBLE ELSE 0 END ELSE mean/sqrt(downside_sq)*sqrt(ppy) END sortino,
      CASE WHEN losses=0 THEN CASE WHEN gains>0 THEN 'inf'::DOUBLE ELSE 0 END ELSE gains/losses END profit_factor,
      CASE WHEN n<2 OR sd IS NULL OR sd<1e-12 THEN 0 ELSE mean/sd END sr,
      CASE WHEN n<2 OR sd IS NULL OR sd<1e-12 THEN 'inf'::DOUBLE ELSE sqrt((1+0.5::DOUBLE*(mean/sd)*(mean/sd))/n) END se,
      CASE WHEN m2=0 THEN 0 ELSE m3/pow(m2,1.5::DOUBLE) END skew, CASE WHEN m2=0 THEN 3 ELSE m4/(m2*m2) END kurt,
      CASE WHEN log_sum>0 THEN log_sum*log_sum/log_sq ELSE 1 END eff_n,
      CASE WHEN log_sum>0 THEN log_max/log_sum ELSE 1 END top1_share
    FROM (SELECT *, {ppy} ppy FROM (
      SELECT {keys}, count(*) n, min({ts}) "start", max({ts}) "end", avg(ret) mean, stddev_samp(ret) sd,
        avg(pow(least(ret,0),2)) downside_sq, product(1+ret) growth, avg((ret>0)::INT::DOUBLE) win_rate,
        sum(CASE WHEN ret>0 THEN ret ELSE 0 END) gains, sum(CASE WHEN ret<0 THEN -ret ELSE 0 END) losses,
        avg(pow(ret-mu,2)) m2, avg(pow(ret-mu,3)) m3, avg(pow(ret-mu,4)) m4,
        sum(lg) log_sum, sum(lg*lg) log_sq, max(lg) log_max,
        (epoch_us(max({ts}))-epoch_us(min({ts})))::DOUBLE/{YEAR_US} span_years {extra}
      FROM (SELECT *, avg(ret) OVER (PARTITION BY {keys}) mu, greatest(ln(1+greatest(ret,-0.999999::DOUBLE)),0) lg FROM {src}) GROUP BY {keys}))"""


def psr_sql(src: str, clip: bool = True) -> str:
    skew = "least(skew,0)" if clip else "skew"
    from pathscreen.catalog.registry import cdf_sql
    return f"""SELECT *, {cdf_sql('z0')} psr FROM (SELECT *, sr*sqrt(n-1)/denom z0 FROM (SELECT *,
        CASE WHEN n<3 OR sd<1e-12 THEN NULL WHEN sq>1e-12 THEN sqrt(sq) ELSE 1e-6 END denom
        FROM (SELECT *, 1-{skew}*sr+(kurt-1)/4*sr*sr sq FROM {src})))"""


def ctes(*names: str, **bodies: str) -> str:
    """WITH clause over named views (with what they need) followed by further bodies."""
    order: list[str] = []

    def add(n):
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({SQL[n]})" for n in order] + [f"{k} AS ({v})" for k, v in bodies.items()]
    return "WITH " + ",\n".join(parts) + "\n"
