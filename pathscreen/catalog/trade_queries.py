"""Named queries over trade logs."""
from __future__ import annotations

from pyspark.sql import functions as F

from pathscreen.catalog.registry import pick, query, r
from pathscreen.catalog.views import ctes, v_ret, v_trd
from pathscreen.operators import scan, trades as T
from pathscreen.operators.metrics import ID
from pathscreen.functions.exprs import d
from pathscreen.staging import stage

WORDS = ("Entry long", "Exit long", "进场", "平仓", "open", "TP hit")


def v_ev(spark, folder):
    """Two event rows per trade, worded differently per strategy; one group never writes an exit word."""
    t = stage(v_trd(spark, folder))  # masks and pairs read the events several times
    m = F.col(ID) % 3
    entry = F.when(m == 0, WORDS[0]).when(m == 1, WORDS[2]).otherwise(WORDS[4])
    exit_ = F.when(m == 0, WORDS[1]).when(m == 1, WORDS[3]).otherwise(WORDS[5])
    e = F.explode(F.array(F.struct(F.col("entry_ts").alias("ts"), entry.alias("event"), F.lit(None).cast("double").alias("ret")),
                          F.struct(F.col("exit_ts").alias("ts"), exit_.alias("event"), F.col("ret").alias("ret"))))
    return t.select(ID, F.concat(F.lit("t"), F.col("trade_no").cast("string")).alias("trade_id"), e.alias("e")).select(ID, "trade_id", "e.*")


EV = f"""SELECT strategy_id, 't'||trade_no::VARCHAR trade_id, entry_ts ts, CASE strategy_id%3 WHEN 0 THEN '{WORDS[0]}' WHEN 1 THEN '{WORDS[2]}' ELSE '{WORDS[4]}' END AS event, NULL::DOUBLE ret FROM v_trd
  UNION ALL SELECT strategy_id, 't'||trade_no::VARCHAR, exit_ts, CASE strategy_id%3 WHEN 0 THEN '{WORDS[1]}' WHEN 1 THEN '{WORDS[3]}' ELSE '{WORDS[5]}' END, ret FROM v_trd"""
MASK = f"""SELECT strategy_id, trade_id, ts, event, ret, CASE WHEN bool_or(xl) OVER p THEN xl WHEN bool_or(el) OVER p THEN NOT el ELSE false END is_exit, el is_entry
  FROM (SELECT *, regexp_matches(lower(event), '\\b(exit|close|closed|cover)\\b|出场|平仓|离场') xl, regexp_matches(lower(event), '\\b(entry|open|opened)\\b|进场|开仓|入场') el FROM ev) WINDOW p AS (PARTITION BY strategy_id)"""
BASE = ctes("v_trd", ev=EV, mk=MASK)


@query("event_masks", BASE + "SELECT strategy_id, trade_id, ts, event, is_entry, is_exit FROM mk")
def event_masks(spark, folder):
    return T.event_masks(v_ev(spark, folder)).select(ID, "trade_id", "ts", "event", "is_entry", "is_exit")


@query("event_pair_first_entry", BASE + f"""SELECT x.strategy_id, x.trade_id, x.ts AS exit_ts, e.entry_ts, {r('x.ret', 6, 'ret')} FROM mk x
   LEFT JOIN (SELECT strategy_id, trade_id, min(ts) entry_ts FROM mk WHERE is_entry GROUP BY 1,2) e ON e.strategy_id=x.strategy_id AND e.trade_id=x.trade_id WHERE x.is_exit""")
def event_pair_first_entry(spark, folder):
    return pick(T.pair_first_entry(T.event_masks(v_ev(spark, folder))), [ID, "trade_id", "exit_ts", "entry_ts"], ["ret"])


@query("round_trips", BASE + f"""SELECT strategy_id, trade_id, entry_ts, exit_ts, {r('ret')} FROM (SELECT strategy_id, trade_id, min(ts) FILTER (WHERE is_entry) entry_ts,
   max(ts) FILTER (WHERE is_exit) exit_ts, max_by(ret, ts) FILTER (WHERE is_exit) ret FROM mk GROUP BY 1,2) WHERE entry_ts IS NOT NULL AND ret IS NOT NULL""")
def round_trips(spark, folder):
    return pick(T.round_trips(T.event_masks(v_ev(spark, folder))), [ID, "trade_id", "entry_ts", "exit_ts"], ["ret"])


LT = "SELECT *, strategy_id%2=0 is_pct, CASE WHEN strategy_id%2=0 THEN ret*1500 ELSE ret*30 END raw FROM v_trd"


@query("load_trades", ctes("v_trd", t=LT) + f"""SELECT strategy_id, trade_no, exit_ts, first_symbol, {r('CASE WHEN v<=-1 THEN -0.999::DOUBLE ELSE v END', 6, 'ret')} FROM (SELECT *, CASE WHEN is_pct THEN raw/100 ELSE raw END v,
   count(*) OVER (PARTITION BY strategy_id) c, first_value(symbol) OVER (PARTITION BY strategy_id ORDER BY trade_no) first_symbol FROM t) WHERE c>=3""")
def load_trades(spark, folder):
    raw = v_trd(spark, folder).withColumn("is_pct", F.col(ID) % 2 == 0)
    raw = raw.withColumn("ret", F.when(F.col("is_pct"), F.col("ret") * d(1500)).otherwise(F.col("ret") * d(30)))
    kept, facts, _ = T.load_trades(stage(raw))
    return pick(kept.join(facts.select(ID, F.col("symbol").alias("first_symbol")), ID), [ID, "trade_no", "exit_ts", "first_symbol"], ["ret"])


DAYS = "(epoch_us(exit_ts)-epoch_us(entry_ts))::DOUBLE/86400000000.0::DOUBLE"


@query("holding_stats", ctes("v_trd") + f"SELECT strategy_id, count(*) n, count(*) AS valid, {r(f'median({DAYS})', 6, 'holding_median')}, {r(f'avg({DAYS})', 6, 'holding_mean')} FROM v_trd GROUP BY 1 HAVING count(*)>=3")
def holding_stats(spark, folder):
    return pick(T.holding_stats(stage(v_trd(spark, folder))), [ID, "n", "valid"], ["holding_median", "holding_mean"])


def v_seq(spark, folder):
    """Hand-over trades from bar to bar (never overlapping), numbered after the overlapping ones."""
    rows = scan.running(v_ret(spark, folder), [ID], ["ts"], counts=True, lags={"entry_ts": "ts"}).where("entry_ts IS NOT NULL")
    return rows.select((F.col(ID) + 100).alias(ID), F.col("idx").cast("long").alias("trade_no"), "entry_ts", F.col("ts").alias("exit_ts"), "ret")


SEQ = "SELECT strategy_id+100 strategy_id, row_number() OVER w trade_no, lag(ts) OVER w entry_ts, ts exit_ts, ret FROM v_ret WINDOW w AS (PARTITION BY strategy_id ORDER BY ts)"
MIX = "SELECT strategy_id, trade_no, entry_ts, exit_ts, ret FROM v_trd UNION ALL SELECT strategy_id, trade_no, entry_ts, exit_ts, ret FROM sq WHERE entry_ts IS NOT NULL"


def v_mix(spark, folder):
    cols = [ID, "trade_no", "entry_ts", "exit_ts", "ret"]
    return v_trd(spark, folder).select(*cols).unionByName(v_seq(spark, folder).select(*cols))


OV = """SELECT strategy_id, count(*) trades, sum((entry_ts < mx)::BIGINT)::BIGINT overlap_count FROM (SELECT *, max(exit_ts) OVER (PARTITION BY strategy_id ORDER BY entry_ts, exit_ts, trade_no
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) mx FROM mx0) GROUP BY 1"""


@query("overlap_reject", ctes("v_trd", "v_ret", sq=SEQ, mx0=MIX, ov=OV) + "SELECT strategy_id, trades, coalesce(overlap_count,0) overlap_count, coalesce(overlap_count,0)>0 rejected FROM ov")
def overlap_reject(spark, folder):
    return T.overlap_check(stage(v_mix(spark, folder)))


DAILY = """SELECT strategy_id, day, coalesce(g,1)-1 ret FROM (SELECT strategy_id, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM (SELECT strategy_id, min(entry_ts::DATE) a, max(exit_ts::DATE) b FROM us GROUP BY 1))
   LEFT JOIN (SELECT strategy_id, day, product(f) g FROM (SELECT strategy_id, pow(1+greatest(ret,-0.999::DOUBLE), 1.0::DOUBLE/(date_diff('day', entry_ts::DATE, exit_ts::DATE)+1)) f, unnest(generate_series(entry_ts::DATE, exit_ts::DATE, INTERVAL 1 DAY))::DATE AS day FROM us) GROUP BY 1,2) USING (strategy_id, day)"""
DAILY_SQL = ctes("v_trd", "v_ret", sq=SEQ, mx0=MIX, ov=OV, us="SELECT mx0.* FROM mx0 JOIN ov USING (strategy_id) WHERE coalesce(overlap_count,0)=0 AND trades>=3", dl=DAILY)


@query("trades_to_daily", DAILY_SQL + f"SELECT strategy_id, day, {r('ret')} FROM dl")
def trades_to_daily(spark, folder):
    return pick(T.trades_to_daily(v_mix(spark, folder)), [ID, "day"], ["ret"])


TOP = """SELECT strategy_id, count(*) n_trades, sum(CASE WHEN ret>0 THEN ret ELSE 0 END) tot, sum(CASE WHEN ret>0 AND rk<=1 THEN ret ELSE 0 END) t1, sum(CASE WHEN ret>0 AND rk<=3 THEN ret ELSE 0 END) t3,
   sum(CASE WHEN ret>0 AND rk<=5 THEN ret ELSE 0 END) t5, product(CASE WHEN ret>0 AND rk<=3 THEN 1 ELSE 1+ret END)-1 wo, avg((ret>0)::INT::DOUBLE) win_rate FROM
   (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY ret DESC, trade_no) rk FROM v_trd) GROUP BY 1"""


@query("top_contributors", ctes("v_trd", t=TOP) + f"""SELECT strategy_id, n_trades, {r('t1/tot', 6, 'top1_share')}, {r('t3/tot', 6, 'top3_share')}, {r('t5/tot', 6, 'top5_share')}, {r('wo', 6, 'compound_without_top3')}, {r('win_rate')},
   CASE WHEN t3/tot<0.45 THEN 'high' WHEN t3/tot<0.7 THEN 'medium' ELSE 'low' END diversification, CASE WHEN t3/tot<0.45 THEN 'low' WHEN t3/tot<0.7 THEN 'medium' ELSE 'high' END dependency FROM t""")
def top_contributors(spark, folder):
    return pick(T.top_contributors(stage(v_trd(spark, folder))), [ID, "n_trades"], ["top1_share", "top3_share", "top5_share", "compound_without_top3", "win_rate"],
                ["diversification", "dependency"])
