"""Named queries over trade logs as files: trades in six forms, a hundred a file, decoded, typed and loaded; every fact comes from the cells."""
from __future__ import annotations

from pyspark.sql import functions as F

from pathscreen.catalog.loader_queries import cells
from pathscreen.catalog.registry import pick, query, r
from pathscreen.catalog.views import ctes, v_trd
from pathscreen.functions.exprs import d
from pathscreen.operators import loader as L
from pathscreen.operators.metrics import ID
from pathscreen.sources import files as FI
from pathscreen.staging import stage

# The strategy number modulo 6 is the form: percent by name, ratio, event rows, a plain name, money, money by name.
HEADS = ("entry time,exit time,symbol,pnl_pct", "entry_date,exit_date,profit_ratio", "trade_number,type,date_time,net_pnl_pct", "opened,closed,pnl,fee", "entry time,exit time,profit", "entry time,exit time,pnl usd")


def log_files(spark, folder):
    t = v_trd(spark, folder)
    k, f = (F.col(ID) % 6).cast("int"), F.floor((F.col("trade_no") - 1) / 100)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    number = lambda x, kind: x.cast(kind).cast("string")
    hole = F.col("trade_no") % 17 == 0
    percent = F.when(hole, F.lit("n/a")).otherwise(number(F.col("ret") * 100, "decimal(12,4)"))
    row = lambda *parts: F.concat_ws(",", *parts)
    number_of = F.col("trade_no").cast("string")
    lines = (F.when(k == 0, F.array(row(day("entry_ts"), day("exit_ts"), F.col("symbol"), percent)))
             .when(k == 1, F.array(row(day("entry_ts"), day("exit_ts"), number(F.col("ret") * 30, "decimal(12,5)"))))
             .when(k == 2, F.array(row(number_of, F.lit("Entry long"), day("entry_ts"), F.lit("")), row(number_of, F.lit("Exit long"), day("exit_ts"), percent)))
             .when(k == 3, F.array(row(day("entry_ts"), day("exit_ts"), number(F.col("ret"), "decimal(12,5)"), F.lit("0.1"))))
             .otherwise(F.array(row(day("entry_ts"), day("exit_ts"), number(F.col("ret") * 30000, "decimal(12,2)")))))
    rows = t.select(ID, k.alias("k"), f.alias("f"), F.struct("trade_no", lines.alias("lines")).alias("l"))
    agg = rows.groupBy(ID, "k", "f").agg(F.array_sort(F.collect_list("l")).alias("ls"))  # a hundred trades per file
    head = F.element_at(F.array(*map(F.lit, HEADS)), F.col("k") + 1)
    body = F.concat(head, F.lit("\n"), F.array_join(F.flatten(F.transform("ls", lambda x: x["lines"])), "\n"))
    return agg.select(F.concat(F.lit("log"), F.col(ID).cast("string"), F.lit("_"), F.col("f").cast("string")).alias("path"), F.encode(body, "UTF-8").alias("content"))


def loaded(spark, folder):
    return L.load_trade_logs(cells(stage(FI.decode_files(log_files(spark, folder)))))


# SQL: the numbers as the files hold them; of event rows the second one of each trade is the trade.
_ROWS = """SELECT 'log'||strategy_id||'_'||((trade_no-1)//100) AS file, strategy_id%6 AS k, (trade_no-1)%100 AS i, trade_no, entry_ts, exit_ts, symbol,
   CASE WHEN strategy_id%6 IN (0, 2) THEN CASE WHEN trade_no%17=0 THEN NULL ELSE CAST(ret*100 AS DECIMAL(12,4))::DOUBLE/100 END WHEN strategy_id%6=1 THEN CAST(ret*30 AS DECIMAL(12,5))::DOUBLE WHEN strategy_id%6=3 THEN CAST(ret AS DECIMAL(12,5))::DOUBLE
   ELSE CAST(ret*30000 AS DECIMAL(12,2))::DOUBLE END v FROM v_trd"""
_UNITS = """SELECT file, k, count(*) AS rows, count(v) AS valid, median(abs(v)) m, count(*) FILTER (v<=-1) AS clipped, product(1+CASE WHEN v<=-1 THEN -0.999::DOUBLE ELSE v END) AS growth FROM tl GROUP BY file, k"""
_CODES = """SELECT *, CASE WHEN k=5 THEN 'absolute_only' WHEN k=4 AND m>20 THEN 'unit_refused' WHEN valid<3 THEN 'few_trades' WHEN growth>1000000000 THEN 'implausible_growth' END code,
   k IN (0, 2) OR k=4 AND m>1 AS percent FROM un"""
LOGS = ctes("v_trd", tl=_ROWS, un=_UNITS, co=_CODES)
_TRADES = """SELECT tl.file, k, i, entry_ts, exit_ts, symbol, CASE WHEN x<=-1 THEN -0.999::DOUBLE ELSE x END ret, CASE WHEN k=2 THEN 2*i+2 ELSE i+1 END AS trade_no
   FROM (SELECT tl.*, CASE WHEN co.k=4 AND percent THEN v/100 ELSE v END x FROM tl JOIN co USING (file, k) WHERE code IS NULL) tl WHERE x IS NOT NULL"""


@query("load_trade_logs", LOGS + f"SELECT file AS strategy_id, trade_no, entry_ts, exit_ts, {r('ret', 8)} FROM ({_TRADES})")
def load_trade_logs(spark, folder):
    return pick(loaded(spark, folder).trades, [ID, "trade_no", "entry_ts", "exit_ts"], ["ret"], digits=8)


_DAYS = "(epoch_us(exit_ts)-epoch_us(entry_ts))::DOUBLE/86400000000.0::DOUBLE"


@query("load_trade_meta", LOGS + f""", tr AS ({_TRADES}) SELECT tr.file AS strategy_id, ['pnl_pct','profit_ratio','net_pnl_pct','pnl','profit'][1+any_value(tr.k)] AS value_column, ['exit_time','exit_date','datetime','closed','exit_time'][1+any_value(tr.k)] AS date_column,
   coalesce(any_value(f.symbol), '') AS symbol, count(*) AS n, any_value(co.rows)-count(*) AS n_dropped, CASE WHEN any_value(tr.k)=2 THEN any_value(co.rows) ELSE 0 END AS n_ignored, min(exit_ts) AS start, max(exit_ts) AS "end", any_value(percent) AS percent,
   {r(f'median({_DAYS})', 6, 'holding_median')}, {r(f'avg({_DAYS})', 6, 'holding_mean')} FROM tr JOIN co USING (file) LEFT JOIN (SELECT file, symbol FROM tl WHERE k=0 AND i=0) f USING (file) GROUP BY tr.file""")
def load_trade_meta(spark, folder):
    return pick(loaded(spark, folder).meta.fillna("", ["symbol"]), [ID, "value_column", "date_column", "symbol", "n", "n_dropped", "n_ignored", "start", "end", "percent"], ["holding_median", "holding_mean"])


@query("load_trade_rejects", LOGS + "SELECT file AS strategy_id, code FROM co WHERE code IS NOT NULL")
def load_trade_rejects(spark, folder):
    return loaded(spark, folder).rejects


@query("load_trade_warnings", LOGS + """, no AS (SELECT *, k IN (3, 4) AS guessed, k=3 AND m>0.5 AND m<=1 OR k=4 AND m>0.5 AND m<=1 AS vague FROM co WHERE code IS NULL),
   us AS (SELECT file, count(*) n, (epoch_us(max(exit_ts))-epoch_us(min(exit_ts)))<=0 AS still FROM tl WHERE v IS NOT NULL GROUP BY file)
   SELECT file AS strategy_id, unnest(list_filter([CASE WHEN percent THEN 'percent' ELSE 'decimal' END, CASE WHEN guessed THEN 'unit_guessed' END, CASE WHEN vague THEN 'unit_ambiguous' END, CASE WHEN clipped>0 AND k<>4 THEN 'clipped' END,
     CASE WHEN k=2 THEN 'event_log' END, CASE WHEN rows>valid THEN 'rows_dropped' END, CASE WHEN still THEN 'zero_span' END], lambda x: x IS NOT NULL)) AS code FROM no JOIN us USING (file)""")
def load_trade_warnings(spark, folder):
    return loaded(spark, folder).warnings
