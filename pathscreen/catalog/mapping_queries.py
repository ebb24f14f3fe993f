"""Named queries over schema mapping and upload checks."""
from __future__ import annotations

from pyspark.sql import functions as F

from pathscreen.catalog.registry import pick, query, r, rounded, table
from pathscreen.catalog.views import ctes, path_sql, v_evt, v_ret, v_trd, v_txt
from pathscreen.functions import names as N
from pathscreen.functions.exprs import d
from pathscreen.operators import mapping as MP, metrics as M, quality as Q, scan, trades as TR
from pathscreen.operators.metrics import ID
from pathscreen.staging import stage

# Headers as exports write them; the file number selects one set.
HEADERS = (
    ("Date/Time", "Net P&L %", "Close", "Signal"),
    ("日期和时间", "净盈亏 USDT", "净盈亏 %", "类型"),
    ("Timestamp", "Equity", "Equity", "user email"),
    ("width", "value", "next_ret", "Notes"),
    ("Entry time", "Exit time", "profit_ratio", "Symbol"),
)
_SETS = "[" + ",".join("[" + ",".join("'" + h + "'" for h in hs) + "]" for hs in HEADERS) + "]"
HEAD = f"""SELECT 'f'||u||CASE WHEN u%7=0 THEN '_leaky.csv' ELSE '.csv' END AS file, u, i::INT col_no, h[i+1] AS name FROM (SELECT u, {_SETS}[1+u%5] h FROM (SELECT DISTINCT user_id u FROM events)), range(0,4) t(i)"""


def headers(spark, folder):
    u = F.col("u")
    sets = F.array(*[F.array(*[F.lit(h) for h in hs]) for hs in HEADERS])
    ids = table(spark, folder, "events").select(F.col("user_id").alias("u")).distinct()
    name = F.concat(F.lit("f"), u.cast("string"), F.when(u % 7 == 0, "_leaky.csv").otherwise(".csv"))
    return ids.select(name.alias("file"), "u", F.posexplode(F.element_at(sets, (u % 5 + 1).cast("int"))).alias("col_no", "name"))


def norm_sql(x: str) -> str:
    v = f"replace(lower(trim({x})), chr(65279), '')"
    for a, b in (("（", "("), ("）", ")"), ("％", "%"), *N.LOCAL_WORDS, ("p&l", "pnl"), ("p/l", "pnl"), ("%", " pct ")):
        v = f"replace({v}, '{a}', '{b}')"
    return f"regexp_replace(regexp_replace({v}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


_AL = ", ".join(f"('{a}','{b}')" for a, b in N.NAME_ALIASES)
COLS = ctes(hd=HEAD, al=f"SELECT * FROM (VALUES {_AL}) t(a,b)", n0=f"SELECT *, {norm_sql('name')} v FROM hd", cn="SELECT file, u, col_no, name, coalesce(b, v) norm FROM n0 LEFT JOIN al ON a=v")


def cols(spark, folder):
    return MP.normalize_columns(headers(spark, folder))


@query("normalize_column_name", COLS + "SELECT file, col_no, name, norm FROM cn")
def normalize_column_name(spark, folder):
    return cols(spark, folder).select("file", "col_no", "name", "norm")


@query("dedupe_column_names", COLS + "SELECT file, col_no, CASE WHEN k=1 THEN b ELSE b||'_'||k END unique_name FROM (SELECT *, row_number() OVER (PARTITION BY file, b ORDER BY col_no) k FROM (SELECT *, CASE WHEN norm='' THEN 'column' ELSE norm END b FROM cn))")
def dedupe_column_names(spark, folder):
    return MP.dedupe_column_names(cols(spark, folder)).select("file", "col_no", "unique_name")


def _list(xs):
    return "[" + ",".join(f"'{x}'" for x in xs) + "]"


@query("match_hint", COLS + f"""SELECT file, h AS hint, col_no, norm AS "column" FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY i, col_no) rn FROM (SELECT file, col_no, norm, unnest({_list(N.RETURN_HINTS)}) h, unnest(range(0,{len(N.RETURN_HINTS)})) i FROM cn)
   WHERE contains('_'||norm||'_', '_'||h||'_')) WHERE rn=1""")
def match_hint(spark, folder):
    return MP.match_hint(cols(spark, folder), N.RETURN_HINTS).select("file", "hint", "col_no", "column")


def _hit(x, hints):
    return "(" + " OR ".join(f"contains('_'||{x}||'_', '_{h}_')" for h in hints) + ")"


PROFILE = "SELECT cn.file, col_no, norm, CASE WHEN col_no=0 THEN (u%4)/4.0::DOUBLE+0.2::DOUBLE ELSE 0.1 END date_share, CASE WHEN col_no=0 THEN 0.0 WHEN (u+col_no)%3=0 THEN 0.5 ELSE 0.95 END numeric_share FROM cn"


def profile(spark, folder):
    u, c = F.col("u"), F.col("col_no")
    p = cols(spark, folder)
    return p.select("file", "col_no", "norm", F.when(c == 0, (u % 4) / d(4) + d(0.2)).otherwise(d(0.1)).alias("date_share"),
                    F.when(c == 0, d(0)).when((u + c) % 3 == 0, d(0.5)).otherwise(d(0.95)).alias("numeric_share"))


PD = f"SELECT file, min_by(col_no, pr*100+col_no) date_col, min_by(norm, pr*100+col_no) date_name FROM (SELECT *, CASE WHEN {_hit('norm', N.DATE_HINTS)} THEN 0 WHEN col_no=0 AND date_share>0.8::DOUBLE THEN 1 END pr FROM pf) WHERE pr IS NOT NULL GROUP BY 1"
PCOLS = COLS.rstrip() + f", pf AS ({PROFILE}), pd AS ({PD}) "


@query("pick_date_column", PCOLS + "SELECT file, date_col, date_name FROM pd")
def pick_date_column(spark, folder):
    return MP.pick_date_column(profile(spark, folder))


@query("pick_value_column", PCOLS + f""", nv AS (SELECT file, col_no, norm, {_hit('norm', N.RETURN_HINTS + N.EQUITY_HINTS)} hn FROM pf JOIN pd USING (file) WHERE col_no<>date_col AND numeric_share>0.8::DOUBLE),
   ag AS (SELECT file, count(*) k, min(col_no) oc, min_by(norm,col_no) onm, min(col_no) FILTER (WHERE hn) hc, min_by(norm,col_no) FILTER (WHERE hn) hnm FROM nv GROUP BY 1)
   SELECT pd.file, CASE WHEN k=1 THEN oc ELSE hc END value_col, CASE WHEN k=1 THEN onm ELSE hnm END value_name, CASE WHEN k IS NULL THEN 'no_numeric' WHEN k<>1 AND hc IS NULL THEN 'ambiguous_value' END code FROM pd LEFT JOIN ag USING (file)""")
def pick_value_column(spark, folder):
    p = profile(spark, folder)
    return MP.pick_value_column(p, MP.pick_date_column(p))


NUM = """SELECT v.file, row_no, pct is_pct, CASE WHEN pct THEN x/100 ELSE x END AS value FROM (SELECT v.*, pct, try_cast(CASE WHEN comma THEN replace(bare, ',', '.') ELSE replace(bare, ',', '') END AS DOUBLE) x
  FROM (SELECT *, replace(replace(trim(txt),'%',''),' ','') bare FROM v_txt) v JOIN (SELECT file, avg(suffix(trim(txt),'%')::INT)>0.5 pct, avg(regexp_matches(replace(replace(trim(txt),'%',''),' ',''), '^-?\\d+,\\d+$')::INT)>0.5 comma FROM v_txt GROUP BY 1) USING (file)) v"""


@query("coerce_numeric", ctes("v_txt", nu=NUM) + f"SELECT file, row_no, is_pct, {r('value', 8)} FROM nu")
def coerce_numeric(spark, folder):
    return pick(MP.coerce_numeric(v_txt(spark, folder)), ["file", "row_no", "is_pct"], ["value"], digits=8)


def v_dates(spark, folder):
    """Times of the events as text, one format per file."""
    e = table(spark, folder, "events")
    m, sec = F.col("user_id") % 11, F.date_trunc("second", "ts").cast("timestamp_ntz")
    us = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', date_trunc('second', ts))")
    txt = (F.when(m == 0, F.date_format(sec, "yyyy-MM-dd HH:mm:ss")).when(m == 1, us.cast("string")).when(m == 2, (us * 1000).cast("string"))
           .when(m == 3, F.datediff(F.to_date("ts"), F.lit("1899-12-30").cast("date")).cast("string")).when(m == 4, F.date_format("ts", "yyyyMMdd"))
           .when(m == 6, F.date_format(sec, "yyyy/MM/dd HH:mm:ss")).when(m == 7, F.date_format(sec, "yyyy.MM.dd HH:mm")).when(m == 8, F.date_format(sec, "MMM d, yyyy"))
           .when(m == 9, F.date_format(sec, "dd MMMM yyyy")).when(m == 10, F.date_format(sec, "dd/MM/yyyy HH:mm:ss"))
           .otherwise(F.concat(F.date_format(sec, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))))
    txt = F.when(F.col("event_id") % 50 == 7, F.lit("n/a")).otherwise(txt)
    return e.select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"), F.col("event_id").alias("row_no"), txt.alias("txt"))


DTX = """SELECT 'f'||user_id AS file, event_id row_no, CASE WHEN event_id%50=7 THEN 'n/a' ELSE CASE user_id%11 WHEN 0 THEN strftime(ts,'%Y-%m-%d %H:%M:%S') WHEN 1 THEN floor(epoch(ts))::BIGINT::VARCHAR WHEN 2 THEN (floor(epoch(ts))::BIGINT*1000)::VARCHAR
   WHEN 3 THEN date_diff('day', DATE '1899-12-30', ts::DATE)::VARCHAR WHEN 4 THEN strftime(ts,'%Y%m%d')
   WHEN 6 THEN strftime(ts,'%Y/%m/%d %H:%M:%S') WHEN 7 THEN strftime(ts,'%Y.%m.%d %H:%M') WHEN 8 THEN strftime(ts,'%b %-d, %Y') WHEN 9 THEN strftime(ts,'%d %B %Y') WHEN 10 THEN strftime(ts,'%d/%m/%Y %H:%M:%S') ELSE strftime(ts,'%Y-%m-%dT%H:%M:%S')||'+02:00' END END txt,
   CASE WHEN event_id%50=7 THEN NULL WHEN user_id%11 IN (3,4,8,9) THEN date_trunc('day', ts) WHEN user_id%11=7 THEN date_trunc('minute', ts)
   WHEN user_id%11=10 AND NOT bool_or(user_id%11=10 AND event_id%50<>7 AND day(ts)>12) OVER (PARTITION BY user_id) THEN CASE WHEN day(ts)<=12 THEN make_timestamp(year(ts), day(ts), month(ts), hour(ts), minute(ts), floor(second(ts))) END
   ELSE date_trunc('second', ts) END ts FROM events"""


@query("parse_dates", ctes(dx=DTX) + "SELECT file, row_no, ts::TIMESTAMP AS ts FROM dx")
def parse_dates(spark, folder):
    return MP.parse_dates(v_dates(spark, folder)).select("file", "row_no", "ts")


@query("date_quality", ctes(dx=DTX) + """SELECT file, count(*) AS rows, count(ts) AS valid, count(*)-count(ts) AS invalid, count(ts)-count(DISTINCT ts) AS duplicates, min(ts)::TIMESTAMP AS start, max(ts)::TIMESTAMP AS "end",
   CASE WHEN bool_or(regexp_matches(txt, '(Z|[+-]\\d{2}:?\\d{2})$')) THEN 'explicit' WHEN count(ts)=0 THEN 'unknown' ELSE 'naive_local' END timezone,
   CASE WHEN count(ts)=0 THEN 'bad_time' WHEN count(ts)<greatest(2,floor(0.8::DOUBLE*count(*))) THEN 'many_bad_times' ELSE 'ok' END time_status FROM dx GROUP BY 1""")
def date_quality(spark, folder):
    return Q.date_quality(MP.parse_dates(v_dates(spark, folder))).select("file", "rows", "valid", "invalid", "duplicates", "start", "end", "timezone", "time_status")


@query("timezone_status", ctes(dx=DTX) + "SELECT file, CASE WHEN bool_or(regexp_matches(txt, '(Z|[+-]\\d{2}:?\\d{2})$')) THEN 'explicit' WHEN count(ts)=0 THEN 'unknown' ELSE 'naive_local' END timezone FROM dx GROUP BY 1")
def timezone_status(spark, folder):
    return Q.date_quality(MP.parse_dates(v_dates(spark, folder))).select("file", "timezone")


def series(spark, folder):
    e = v_evt(spark, folder)
    v = F.when(F.col(ID) % 3 == 0, F.col("ret")).when(F.col(ID) % 3 == 1, F.abs("ret") / 100).otherwise(d(1) + F.abs("ret"))
    return e.select(ID, "ts", F.col("event_id").alias("row_no"), v.alias("value"))


SER = "SELECT strategy_id, ts, event_id row_no, CASE strategy_id%3 WHEN 0 THEN ret WHEN 1 THEN abs(ret)/100 ELSE 1+abs(ret) END AS value FROM v_evt"


@query("detect_input_type", ctes("v_evt", se=SER) + f"""SELECT strategy_id, n, has_negative, {r('md', 8, 'median')}, {r('ac', 6, 'level_autocorr')}, CASE WHEN has_negative THEN 'returns' WHEN md>0.5 OR ac>0.95 THEN 'equity' ELSE 'returns' END input_type FROM
   (SELECT strategy_id, count(*) n, bool_or(value<0) has_negative, median(value) md, CASE WHEN count(*)>3 THEN coalesce(corr(value,pv),0) ELSE 0 END ac FROM (SELECT *, lag(value) OVER (PARTITION BY strategy_id ORDER BY ts) pv FROM se) GROUP BY 1)""")
def detect_input_type(spark, folder):
    out = MP.detect_input_type(stage(series(spark, folder)))
    return out.select(ID, "n", "has_negative", rounded("median", 8).alias("median"), rounded("level_autocorr").alias("level_autocorr"), "input_type")


_CL = "SELECT strategy_id, date_trunc('day', ts) ts, event_id row_no, CASE WHEN event_id%11=3 THEN NULL ELSE ret END AS value FROM v_evt"


@query("clean_series", ctes("v_evt", c0=_CL) + f"SELECT strategy_id, ts, row_no, {r('value', 8)} FROM (SELECT *, count(*) OVER (PARTITION BY strategy_id) n FROM (SELECT *, row_number() OVER (PARTITION BY strategy_id, ts ORDER BY row_no DESC) rn FROM c0 WHERE value IS NOT NULL) WHERE rn=1) WHERE n>=3")
def clean_series(spark, folder):
    e = v_evt(spark, folder)
    raw = e.select(ID, F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("row_no"), F.when(F.col("event_id") % 11 == 3, None).otherwise(F.col("ret")).alias("value"))
    return pick(MP.clean_series(raw)[0], [ID, "ts", "row_no"], ["value"], digits=8)


_US = "SELECT strategy_id, ts, CASE strategy_id%3 WHEN 0 THEN ret WHEN 1 THEN ret*40 ELSE ret*4 END ret FROM v_ret"


@query("unit_sanity_flags", ctes("v_ret", us=_US) + f"""SELECT strategy_id, reject, {r('big_share')}, extreme, {r('md', 6, 'median_abs')}, {r('p9', 6, 'p90_abs')}, array_to_string(list_filter([CASE WHEN md>0.2 OR p9>0.8 THEN 'UNITS_LARGE' END, CASE WHEN big_share>0.5 THEN 'MOSTLY_ABOVE_ONE' WHEN extreme>0 THEN 'EXTREME_BARS' END], lambda x: x IS NOT NULL), '|') codes
   FROM (SELECT strategy_id, bool_or(ret<=-1) reject, avg((abs(ret)>1)::INT::DOUBLE) big_share, sum((ret>3)::BIGINT)::BIGINT extreme, median(abs(ret)) md, quantile_cont(abs(ret),0.9) p9 FROM us GROUP BY 1)""")
def unit_sanity_flags(spark, folder):
    k = F.when(F.col(ID) % 3 == 0, d(1)).when(F.col(ID) % 3 == 1, d(40)).otherwise(d(4))
    out = MP.unit_sanity(stage(v_ret(spark, folder).withColumn("ret", F.col("ret") * k)))
    return out.select(ID, "reject", rounded("big_share").alias("big_share"), "extreme", rounded("median_abs").alias("median_abs"), rounded("p90_abs").alias("p90_abs"), F.array_join("codes", "|").alias("codes"))


@query("equity_sanity", ctes("v_ret") + "SELECT strategy_id, CASE WHEN product(1+ret*CASE WHEN strategy_id%2=0 THEN 1 ELSE 0 END + CASE WHEN strategy_id%2=1 THEN 0.08::DOUBLE ELSE 0 END)>1e9 THEN 'implausible_growth' END code FROM v_ret GROUP BY 1")
def equity_sanity(spark, folder):
    odd = F.col(ID) % 2 == 1
    return MP.equity_sanity(v_ret(spark, folder).withColumn("ret", F.when(odd, d(0.08)).otherwise(F.col("ret")))).select(ID, "code")


_BF = "SELECT strategy_id, median(sec) ms FROM (SELECT strategy_id, (epoch_us(ts)-epoch_us(lag(ts) OVER (PARTITION BY strategy_id ORDER BY ts)))::DOUBLE/1000000 sec FROM (SELECT strategy_id, ts FROM v_ret UNION ALL SELECT strategy_id+1000, ts FROM v_evt)) WHERE sec IS NOT NULL GROUP BY 1"


@query("bar_frequency", ctes("v_ret", "v_evt", b=_BF) + f"""SELECT strategy_id, {r('ms', 4, 'median_sec')}, CASE WHEN ms<=0 THEN 'unknown' WHEN ms<5400 THEN '~'||round_even(ms/60,0)::BIGINT||'min' WHEN ms<72000 THEN '~'||round_even(ms/3600,0)::BIGINT||'h' WHEN ms<172800 THEN 'daily' WHEN ms<777600 THEN 'weekly' WHEN ms<3888000 THEN 'monthly' ELSE '~'||round_even(ms/86400,0)::BIGINT||'d' END bar_freq FROM b""")
def bar_frequency(spark, folder):
    both = v_ret(spark, folder).select(ID, "ts").unionByName(v_evt(spark, folder).select((F.col(ID) + 1000).alias(ID), "ts"))
    return pick(MP.bar_frequency(both), [ID], ["median_sec"], ["bar_freq"], 4)


_FP = " OR ".join(f"starts_with(norm,'{p}')" for p in N.FORWARD_PREFIXES)


@query("forward_looking_scan", COLS + f"""SELECT file, marker AS name_marker, cols AS columns, marker OR cols<>'' AS suspect FROM (SELECT file, regexp_matches(regexp_replace(lower(file), '\\.(csv|tsv|txt|xlsx|xls|xlsm)$', ''), '{"|".join(N.FORWARD_MARKERS)}') marker,
   coalesce(string_agg(norm, ',' ORDER BY col_no) FILTER (WHERE {_FP}), '') cols FROM cn GROUP BY file)""")
def forward_looking_scan(spark, folder):
    return MP.forward_looking_scan(cols(spark, folder)).select("file", "name_marker", F.array_join("columns", ",").alias("columns"), "suspect")


def _role(hints, ok="true"):
    return f"min_by(norm, rr) FILTER (WHERE rr IS NOT NULL)".replace("rr", "(CASE " + " ".join(f"WHEN contains('_'||norm||'_','_{h}_') AND {ok} THEN {i * 100}+col_no" for i, h in enumerate(hints)) + " END)")


_NP = f"NOT {_hit('norm', N.NOT_PNL)}"
MEDS = "SELECT file, (u%4)*9.0::DOUBLE+0.3 AS median_abs FROM cn GROUP BY file, u"


@query("detect_trade_log", COLS.rstrip() + f""", md AS ({MEDS}), ro AS (SELECT file, {_role(N.ENTRY_HINTS)} en, {_role(N.EXIT_HINTS)} ex, {_role(N.EVENT_HINTS)} ev, {_role(N.PCT_HINTS, _NP)} pp, {_role(N.DEC_HINTS, _NP + " AND NOT contains(norm,'usd')")} pd FROM cn GROUP BY 1)
   SELECT file, en AS entry, ex AS "exit", ev AS event, coalesce(pp,pd) AS pnl, en IS NULL event_log, CASE WHEN pp IS NOT NULL THEN 'percent_by_name' WHEN pd IS NULL THEN 'absolute_only' WHEN regexp_matches(pd,'pct|percent') THEN 'percent_by_name' WHEN contains(pd,'ratio') THEN 'decimal_by_name'
     WHEN median_abs>20 THEN 'refused' WHEN median_abs>1 THEN 'percent_guessed' WHEN median_abs>0.5 THEN 'decimal_ambiguous' ELSE 'decimal_guessed' END unit FROM ro JOIN md USING (file) WHERE ex IS NOT NULL AND ((en IS NULL AND ev IS NOT NULL) OR (en IS NOT NULL AND en<>ex))""")
def detect_trade_log(spark, folder):
    c = cols(spark, folder)
    med = c.select("file", ((F.col("u") % 4) * d(9) + d(0.3)).alias("median_abs")).distinct()
    return MP.detect_trade_log(c, medians=med).select("file", "entry", "exit", "event", "pnl", "event_log", "unit")


# --- checks ----------------------------------------------------------------------------------------
def _in(names):
    return "bool_or(norm IN (" + ",".join(f"'{n}'" for n in names) + "))"


SHAPE = f"""SELECT file, dt has_date, rt has_return, eq has_equity, CASE WHEN dt AND rt AND (en OR po) THEN 'trade_log' WHEN dt AND eq THEN 'equity' WHEN dt AND rt THEN 'returns' WHEN dt AND px AND po THEN 'signal_price_preview' ELSE 'unknown' END AS shape
   FROM (SELECT file, {_in(Q.DATE_NAMES)} dt, {_in(Q.RETURN_NAMES)} rt, {_in(Q.EQUITY_NAMES)} eq, {_in(Q.PRICE_NAMES)} px, {_in(Q.POSITION_NAMES)} po, {_in(Q.ENTRY_NAMES)} en FROM cn GROUP BY 1)"""


@query("preflight_shape", COLS.rstrip() + f", sh AS ({SHAPE}) SELECT file, shape, has_date, has_return, has_equity FROM sh")
def preflight_shape(spark, folder):
    return Q.preflight_shape(cols(spark, folder)).select("file", "shape", "has_date", "has_return", "has_equity")


_PIIN = "CASE " + " ".join(f"WHEN regexp_matches(norm, '{rx}') THEN '{k}'" for k, rx in Q.PII_NAMES) + " END"


@query("pii_column_names", COLS + f"SELECT file, col_no, norm, {_PIIN} kind FROM cn WHERE {_PIIN} IS NOT NULL")
def pii_column_names(spark, folder):
    return Q.pii_column_names(cols(spark, folder)).select("file", "col_no", "norm", "kind")


@query("pii_values", "WITH t AS (SELECT source AS \"column\", text FROM documents UNION ALL SELECT role, text FROM conversations) SELECT \"column\", email, credential, phone, wallet, CASE WHEN email>0 THEN 'email' WHEN credential>0 THEN 'credential' WHEN phone>0 THEN 'phone' WHEN wallet>0 THEN 'wallet' END kind FROM (SELECT \"column\", "
       + ", ".join(f"sum(regexp_matches(text, '{rx.replace('*+', '*')}')::BIGINT)::BIGINT {k}" for k, rx in Q.PII_VALUES) + " FROM t GROUP BY 1)")
def pii_values(spark, folder):
    t = table(spark, folder, "documents").select(F.col("source").alias("g"), "text").unionByName(table(spark, folder, "conversations").select(F.col("role").alias("g"), "text"))
    return Q.pii_values(t, "g", "text").select("column", *[k for k, _ in Q.PII_VALUES], "kind")


UNIT = "SELECT file, quantile_cont(abs(value*k), 0.95) p FROM (SELECT file, value, CASE ascii(right(file,1))%3 WHEN 0 THEN 1 WHEN 1 THEN 60 ELSE 30 END k FROM nu) GROUP BY 1"
UNITX = "SELECT file, p, CASE WHEN p>2 THEN 'percent' WHEN p<=1 THEN 'decimal' ELSE 'ambiguous' END unit FROM un0"


def units(spark, folder):
    m = F.ascii(F.substring("file", -1, 1)) % 3
    k = F.when(m == 0, d(1)).when(m == 1, d(60)).otherwise(d(30))
    return Q.return_unit_hint(MP.coerce_numeric(v_txt(spark, folder)).withColumn("value", F.col("value") * k))


@query("return_unit_hint", ctes("v_txt", nu=NUM, un0=UNIT, un=UNITX) + f"SELECT file, {r('p', 6, 'p95_abs')}, unit FROM un")
def return_unit_hint(spark, folder):
    return pick(units(spark, folder), ["file"], ["p95_abs"], ["unit"])


RP = COLS.rstrip() + ", " + ctes("v_txt", dx=DTX, nu=NUM, un0=UNIT, un=UNITX)[5:].rstrip() + f""", sh AS ({SHAPE}), dq AS (SELECT file||'.csv' AS file, count(ts) va, count(*) ro, count(ts)-count(DISTINCT ts) du, bool_or(regexp_matches(txt, '(Z|[+-]\\d{{2}}:?\\d{{2}})$')) zo FROM dx GROUP BY 1),
   pi AS (SELECT file, count(*) pc FROM cn WHERE {_PIIN} IS NOT NULL GROUP BY 1), ns AS (SELECT file, CASE WHEN u%9=4 THEN 0.5 ELSE 0.95 END numeric_share FROM cn GROUP BY file, u),
   re AS (SELECT sh.file, shape, list_filter([CASE WHEN pc>0 THEN 'pii_columns' END, CASE WHEN NOT has_date THEN '!missing_time' END, CASE WHEN has_date AND NOT zo AND va>0 THEN 'timezone_assumption' END, CASE WHEN has_date AND va=0 THEN '!bad_time' END,
     CASE WHEN has_date AND va>0 AND va<greatest(2,floor(0.8::DOUBLE*ro)) THEN '!many_bad_times' END, CASE WHEN has_date AND du>0 THEN 'duplicate_times' END, CASE WHEN shape='unknown' AND NOT (has_date AND (has_return OR has_equity)) THEN '!unknown_shape' END,
     CASE WHEN has_return AND numeric_share<0.6 THEN '!bad_returns' END, CASE WHEN has_return AND unit='ambiguous' THEN 'ambiguous_return_units' END], lambda x: x IS NOT NULL) iss
     FROM sh LEFT JOIN dq USING (file) LEFT JOIN (SELECT file||'.csv' AS file, unit FROM un) un USING (file) LEFT JOIN pi USING (file) LEFT JOIN ns USING (file)) """


def report(spark, folder):
    c = stage(cols(spark, folder))
    dq = Q.date_quality(MP.parse_dates(v_dates(spark, folder))).withColumn("file", F.concat("file", F.lit(".csv")))
    un = units(spark, folder).withColumn("file", F.concat("file", F.lit(".csv")))
    ns = c.select("file", F.when(F.col("u") % 9 == 4, d(0.5)).otherwise(d(0.95)).alias("numeric_share")).distinct()
    return Q.preflight_report(Q.preflight_shape(c), dq, un, Q.pii_column_names(c), ns)


@query("preflight_report", RP + "SELECT file, shape, CASE WHEN len(list_filter(iss, lambda x: starts_with(x,'!')))>0 THEN 'blocked' WHEN len(iss)>0 THEN 'warning' ELSE 'ready' END status, replace(array_to_string(iss,'|'),'!','') issues FROM re")
def preflight_report(spark, folder):
    return report(spark, folder).select("file", "shape", "status", F.coalesce(F.array_join("issues.code", "|"), F.lit("")).alias("issues"))


_FIX = """, fa AS (SELECT DISTINCT file, CASE WHEN u%3=0 THEN 'units_standardized' WHEN u%3=1 THEN 'invalid_rows_removed|structure_detected' ELSE '' END fixes, u%13=5 rej FROM cn)"""


@query("preflight_score", RP.rstrip() + _FIX + " SELECT file, CASE WHEN rej THEN 'blocked' WHEN len(list_filter(iss, lambda x: NOT starts_with(x,'!')))>0 THEN 'warning' ELSE 'ready' END status, CASE WHEN rej THEN 'engine_reject' ELSE coalesce(array_to_string(list_filter(iss, lambda x: NOT starts_with(x,'!')),'|'),'') END codes, fixes FROM re JOIN fa USING (file)")
def preflight_score(spark, folder):
    u = headers(spark, folder).select("file", "u").distinct()
    w = F.when(F.col("u") % 3 == 0, F.array(F.lit("column 'x' had '%' signs - parsed as percent"))).when(
        F.col("u") % 3 == 1, F.array(F.lit("dropped 2 row(s)"), F.lit("input_type auto-detected as 'returns'"))).otherwise(F.array().cast("array<string>"))
    facts = u.select("file", F.lit(10).alias("n"), w.alias("warnings"))
    rejects = u.where("u % 13 = 5").select("file", F.lit("fewer than 3 valid rows").alias("message"))
    return Q.preflight_score(report(spark, folder), facts, rejects).select("file", "status", F.array_join("codes", "|").alias("codes"), F.array_join("fixes", "|").alias("fixes"))
