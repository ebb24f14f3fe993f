"""Named queries over sources, sinks and streams."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pathscreen.catalog.mapping_queries import COLS, HEADERS, _SETS, _hit, cols, headers, norm_sql
from pathscreen.catalog.registry import pick, ppf_sql, query, r, rounded, stream_sql, table, uniform_sql
from pathscreen.catalog.views import base_sql, ctes, path_sql, v_evt, v_px, v_ret
from pathscreen.functions import names as N
from pathscreen.functions.exprs import d
from pathscreen.operators import metrics as M, scan
from pathscreen.operators.metrics import ID
from pathscreen.session import checkpoint_dir
from pathscreen.sources import big_files, files as FI, prices as P, samples, sinks
from pathscreen.staging import stage
from pathscreen.streaming import drawdown, prices as SP, windows


def fresh_folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- files -----------------------------------------------------------------------------------
def text_files(spark, folder):
    """Small files of a hundred events each, in several separators and encodings."""
    e = table(spark, folder, "events")
    f = F.floor(F.col("event_id") / 100)
    sep = F.element_at(F.array(F.lit(","), F.lit(";"), F.lit("\t"), F.lit("|")), (f % 4 + 1).cast("int"))
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), sep, ((F.col("value") - 45) / 1000).cast("decimal(12,5)").cast("string"))
    rows = e.select(f.alias("f"), sep.alias("sep"), F.struct(F.col("event_id").alias("k"), line.alias("line")).alias("l"))
    agg = rows.groupBy("f", "sep").agg(F.array_sort(F.collect_list("l")).alias("ls"))  # a hundred lines per file
    text = F.concat(F.lit("date"), F.col("sep"), F.lit("ret\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    body = F.when(F.col("f") % 3 == 0, F.encode(text, "UTF-8")).when(F.col("f") % 3 == 1, F.encode(F.concat(F.lit("﻿"), text), "UTF-8")).otherwise(F.encode(text, "UTF-16"))
    return agg.select(F.concat(F.lit("file"), F.col("f").cast("string")).alias("path"), body.alias("content"))


@query("scan_delimited", """SELECT 'file'||(event_id//100) path, (row_number() OVER (PARTITION BY event_id//100, c ORDER BY event_id))::BIGINT row_no, c col_no, CASE c WHEN 0 THEN strftime(ts,'%Y-%m-%d %H:%M:%S') ELSE CAST(CAST((value-45)/1000 AS DECIMAL(12,5)) AS VARCHAR) END txt FROM events, (VALUES (0),(1)) t(c)
   UNION ALL SELECT DISTINCT 'file'||(event_id//100), 0, c, CASE c WHEN 0 THEN 'date' ELSE 'ret' END FROM events, (VALUES (0),(1)) t(c)""")
def scan_delimited(spark, folder):
    return FI.scan_delimited(text_files(spark, folder))


@query("scan_ranges", """SELECT doc_id, c::INT col_no, CASE c WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN coalesce(source,'') ELSE coalesce(text,'') END txt FROM documents, (VALUES (0),(1),(2)) t(c)""")
def scan_ranges(spark, folder):
    """All documents as quoted text files, whose cells hold line ends, read again in ranges."""
    root = fresh_folder(spark, "documents")
    (table(spark, folder, "documents").select("doc_id", "source", "text").write.option("header", True).option("quoteAll", True).option("escape", '"')
     .option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(root))
    cells = stage(big_files.scan_ranges(spark, root, "*.csv"))
    ids = cells.where("col_no = 0 AND row_no > 0").select("path", "row_no", F.col("txt").cast("long").alias("doc_id"))
    return cells.join(ids, ["path", "row_no"]).select("doc_id", "col_no", "txt")


@query("scan_format_route", """SELECT path, ext AS extension, CASE WHEN ext IN ('.xlsx','.xls','.xlsm') OR doc_id%7=0 THEN 'workbook' ELSE 'text' END kind FROM (SELECT doc_id, 'd'||doc_id||['.csv','.XLSX','.txt','','.tsv?x=1'][1+doc_id%5] path, ['.csv','.xlsx','.txt','','.tsv'][1+doc_id%5] ext FROM documents)""")
def scan_format_route(spark, folder):
    t = table(spark, folder, "documents")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".csv", ".XLSX", ".txt", "", ".tsv?x=1")]), (F.col("doc_id") % 5 + 1).cast("int"))
    body = F.encode("text", "UTF-8")
    files = t.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), ext).alias("path"), F.when(F.col("doc_id") % 7 == 0, F.concat(F.unhex(F.lit("504B0304")), body)).otherwise(body).alias("content"))
    return FI.format_route(files).select("path", "extension", "kind")


def sheet_cells(spark, folder):
    """Sheets with a title block above the header for some files, then the events of the file."""
    h = headers(spark, folder).withColumn("base", F.when(F.col("u") % 3 == 0, F.lit(2)).otherwise(F.lit(0)))
    head = h.select("file", F.col("base").cast("long").alias("row_no"), "col_no", F.col("name").alias("txt"))
    title = h.where("base = 2").select("file", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("row_no"), "col_no",
                                       F.when(F.col("col_no") == 0, "Report").otherwise("").alias("txt"))
    e = table(spark, folder, "events").select(F.col("user_id").alias("u"), "event_id", "value")
    num = scan.running(e.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")), ["u"], ["ts", "event_id"], counts=True)
    data = num.join(h.select("u", "file", "base", "col_no"), "u").select(
        "file", (F.col("base") + F.col("idx")).cast("long").alias("row_no"), "col_no", F.when(F.col("col_no") == 3, "").otherwise((F.col("event_id") * 10 + F.col("col_no")).cast("string")).alias("txt"))
    return head.unionByName(title).unionByName(data).withColumn("sheet", F.lit("S1"))


@query("header_promotion", COLS + """SELECT file, 'S1' sheet, row_number() OVER (PARTITION BY file, col_no ORDER BY event_id)-1 row_no, col_no, name, (event_id*10+col_no)::VARCHAR txt FROM cn JOIN events ON user_id=u WHERE col_no<>3""")
def header_promotion(spark, folder):
    return FI.promote_header(stage(sheet_cells(spark, folder))).select("file", "sheet", "row_no", "col_no", "name", "txt")


_SH = "SELECT cn.file, s.sheet, s.sheet_no, cn.norm, u FROM cn, (VALUES ('Summary',0),('List of trades',1),('Data',2)) s(sheet, sheet_no) WHERE (s.sheet_no<>0 OR col_no>1) AND (s.sheet_no<>2 OR u%2=0)"


@query("sheet_select", COLS.rstrip() + f""", sh AS ({_SH}), sz AS (SELECT file, sheet, sheet_no, (u%60)*(1+sheet_no) AS rows, count(*) cols FROM sh GROUP BY file, sheet, sheet_no, u), fe AS (SELECT file, sheet, bool_or({_hit('norm', N.DATE_HINTS)}) dt, bool_or({_hit('norm', N.RETURN_HINTS + N.EQUITY_HINTS + N.PRICE_HINTS)}) va,
   bool_or({_hit('norm', ('entry',))}) en, bool_or({_hit('norm', ('exit',))}) ex, bool_or({_hit('norm', ('trade',))}) tr, bool_or({_hit('norm', ('net_pnl',))}) np, bool_or({_hit('norm', ('type', 'signal'))}) ev FROM sh GROUP BY 1,2)
   SELECT file, sheet, score FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, sheet_no) rn FROM (SELECT fe.file, fe.sheet, sheet_no, (dt::INT*5+va::INT*5+(en AND ex)::INT*4+(tr OR false)::INT*4+(np AND ev)::INT*5+CASE WHEN rows>=40 THEN 2 WHEN rows>=3 THEN 1 ELSE 0 END)::BIGINT score FROM fe JOIN sz USING (file, sheet) WHERE rows>=2 AND cols>=2)) WHERE rn=1""")
def sheet_select(spark, folder):
    s = F.explode(F.array(*[F.struct(F.lit(n).alias("sheet"), F.lit(i).alias("sheet_no")) for i, n in enumerate(("Summary", "List of trades", "Data"))]))
    c = cols(spark, folder).withColumn("s", s).select("file", "u", "col_no", "norm", "s.*").where("(sheet_no <> 0 OR col_no > 1) AND (sheet_no <> 2 OR u % 2 = 0)")
    sizes = c.groupBy("file", "sheet", "sheet_no", "u").agg(F.count(F.lit(1)).alias("cols")).select("file", "sheet", ((F.col("u") % 60) * (F.col("sheet_no") + 1)).alias("rows"), "cols")
    return FI.sheet_select(c, sizes)


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("discover_inputs", "SELECT 'testdata' AS source, name FROM (VALUES " + ", ".join(f"('{t}')" for t in _TABLES) + ") t(name)")
def discover_inputs(spark, folder):
    return FI.discover_inputs(spark, {"testdata": folder}, "*.parquet").select("source", "name")


# --- prices ---------------------------------------------------------------------------------------
_RAWP = "SELECT asset_key, ts, close, 1 row_no FROM v_px UNION ALL SELECT asset_key, ts, CASE WHEN day(ts)%5=0 THEN -1 ELSE close*1.01::DOUBLE END, 2 FROM v_px WHERE day(ts)%3=0"


@query("scan_prices", ctes("v_px", rp=_RAWP) + f"SELECT asset_key, ts, {r('close', 6)} FROM (SELECT *, row_number() OVER (PARTITION BY asset_key, ts ORDER BY row_no DESC) rn FROM rp WHERE close>0) WHERE rn=1")
def scan_prices(spark, folder):
    px = stage(v_px(spark, folder))
    second = px.where(F.dayofmonth("ts") % 3 == 0).select("asset_key", "ts", F.when(F.dayofmonth("ts") % 5 == 0, d(-1)).otherwise(F.col("close") * d(1.01)).alias("close"), F.lit(2).alias("row_no"))
    return pick(P.load_prices(px.select("asset_key", "ts", "close", F.lit(1).alias("row_no")).unionByName(second)), ["asset_key", "ts"], ["close"])


@query("scan_asset_close", ctes("v_px", t="SELECT asset_key, ts, close, close/lag(close) OVER (PARTITION BY asset_key ORDER BY ts)-1 aret FROM v_px") + f"SELECT asset_key, ts, {r('close')}, {r('aret', 8)} FROM t WHERE asset_key='Brand#12' AND aret IS NOT NULL")
def scan_asset_close(spark, folder):
    store = fresh_folder(spark, "store")
    P.write_store(v_px(spark, folder), store)
    out = P.daily_returns(P.load_close(spark, store, "Brand#12"))
    return out.select("asset_key", "ts", rounded("close").alias("close"), rounded("aret", 8).alias("aret"))


_FRESH = "SELECT asset_key, ts, CASE WHEN day(ts)=13 THEN 0 ELSE close*1.02::DOUBLE END AS close FROM v_px WHERE ts>='2000-01-01'"
_MERGE = "SELECT asset_key, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY asset_key, ts ORDER BY b DESC) rn FROM (SELECT asset_key, ts, close, 0 b FROM v_px WHERE ts<'2000-06-01' UNION ALL SELECT *, 1 FROM fr)) WHERE rn=1 AND close>0"
REF = ctes("v_px", fr=_FRESH, mg=_MERGE)


def _fresh(px):
    return px.where("ts >= '2000-01-01'").withColumn("close", F.when(F.dayofmonth("ts") == 13, d(0)).otherwise(F.col("close") * d(1.02)))


@query("price_store_refresh", REF + f"SELECT asset_key, ts, {r('close')} FROM mg")
def price_store_refresh(spark, folder):
    px, store = stage(v_px(spark, folder)), fresh_folder(spark, "store")
    P.write_store(px.where("ts < '2000-06-01'"), store)
    P.refresh_store(spark, store, _fresh(px))
    return pick(P.read_store(spark, store), ["asset_key", "ts"], ["close"])


@query("union_refresh", REF + f"SELECT asset_key, ts, {r('close')}, b AS batch FROM (SELECT asset_key, ts, close, 0 b FROM v_px WHERE ts<'2000-06-01' UNION ALL SELECT *, 1 FROM fr)")
def union_refresh(spark, folder):
    px = stage(v_px(spark, folder))
    old, new = px.where("ts < '2000-06-01'").withColumn("batch", F.lit(0)), _fresh(px).drop("volume").withColumn("batch", F.lit(1))
    return pick(old.unionByName(new, allowMissingColumns=True), ["asset_key", "ts", "batch"], ["close"])


@query("store_manifest", ctes("v_px") + """SELECT a.asset_key, count(ts) AS rows, min(ts)::DATE AS start, max(ts)::DATE AS "end", count(ts)>0 ok FROM (SELECT DISTINCT p_brand asset_key FROM part UNION SELECT 'Brand#none') a LEFT JOIN v_px USING (asset_key) GROUP BY 1""")
def store_manifest(spark, folder):
    none = table(spark, folder, "region").select(F.lit("Brand#none").alias("asset_key"))
    expected = table(spark, folder, "part").select(F.col("p_brand").alias("asset_key")).unionByName(none)
    return sinks.store_manifest(v_px(spark, folder), expected)


# --- sinks -----------------------------------------------------------------------------------------
@query("sink_daily_minimal", ctes("v_ret") + """SELECT strategy_id, count(*) AS rows, min(day) AS start, max(day) AS "end", sha256('date,return'||chr(10)||string_agg(strftime(day,'%Y-%m-%d')||','||num, chr(10) ORDER BY day)||chr(10)) sha256 FROM
   (SELECT strategy_id, ts::DATE AS day, regexp_replace(regexp_replace(format('{:.10f}', ret), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') num FROM v_ret) GROUP BY 1 HAVING count(*)>=30""")
def sink_daily_minimal(spark, folder):
    return sinks.daily_minimal(v_ret(spark, folder)).select(ID, "rows", "start", "end", "sha256")


@query("sink_audit_csv", ctes("v_ret", b=base_sql("v_ret")) + f"SELECT strategy_id, n, {r('cagr')} FROM b")
def sink_audit_csv(spark, folder):
    path = fresh_folder(spark, "audit")
    sinks.write_audit(M.base_metrics(v_ret(spark, folder)).select(ID, "n", "cagr"), path)
    return pick(spark.read.schema("strategy_id long, n long, cagr double").option("header", True).csv(path), [ID, "n"], ["cagr"])


_DAYS = 250
_Z = f"SELECT s_suppkey, day, {ppf_sql('u')} z FROM (SELECT s_suppkey, day, {uniform_sql('sk', 'day')}+{0.5 / 4294967296!r} u FROM (SELECT s_suppkey, {stream_sql('s_suppkey', 7, 12)} sk, unnest(range(1,{_DAYS + 1})) AS day FROM supplier))"


@query("gen_samples", f"WITH z AS ({_Z}) SELECT s_suppkey, day-1 AS day, {r(f'{samples.MEAN}::DOUBLE+pow({samples.PHI}::DOUBLE,day-1)*({samples.FIRST - samples.MEAN!r}::DOUBLE + {samples.NOISE}::DOUBLE*sum(CASE WHEN day>1 THEN z/pow({samples.PHI}::DOUBLE,day-1) ELSE 0 END) OVER (PARTITION BY s_suppkey ORDER BY day))', 8, 'ret')} FROM z")
def gen_samples(spark, folder):
    out = samples.flagged(table(spark, folder, "supplier"), "s_suppkey", _DAYS)
    return out.select("s_suppkey", F.col("day").cast("long").alias("day"), rounded("ret", 8).alias("ret"))


# --- headers beside their data ------------------------------------------------------------------------
def titled_sheets(spark, folder):
    """Sheets of a hundred events below a title and a header; in every other one the data stand two columns to the right, every third one has no known name."""
    e = table(spark, folder, "events")
    f, i = F.floor(F.col("event_id") / 100), (F.col("event_id") % 100 + 2).cast("int")
    base = F.when(f % 2 == 0, 2).otherwise(0)
    cell = lambda row, col, txt: F.struct(row.alias("row_no"), col.cast("int").alias("col_no"), txt.alias("txt"))
    texts = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), ((F.col("value") - 45) / 1000).cast("decimal(12,5)").cast("string")
    body = e.select(f.alias("f"), F.explode(F.array(*(cell(i, base + k, t) for k, t in enumerate(texts)))).alias("c"))
    head = F.when(F.col("f") % 3 == 2, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("Date"), F.lit("Return")))
    top = e.select(f.alias("f")).distinct().select("f", F.explode(F.array(cell(F.lit(0), F.lit(0), F.lit("my export")), *(cell(F.lit(1), F.lit(k), head[k]) for k in (0, 1)))).alias("c"))
    rows = body.unionByName(top)
    return rows.select(F.concat(F.lit("sheet"), F.col("f").cast("string")).alias("file"), F.lit("S1").alias("sheet"), "c.*")


_TITLED = """SELECT event_id//100 AS f, event_id%100 AS i, CASE WHEN (event_id//100)%2=0 THEN 2 ELSE 0 END AS base, strftime(ts, '%Y-%m-%d %H:%M:%S') AS d, CAST(CAST((value-45)/1000 AS DECIMAL(12,5)) AS VARCHAR) AS v FROM events"""


@query("header_shift", f"""WITH t AS ({_TITLED}), c AS (SELECT f, i, (base + k)::BIGINT AS col_no, k, CASE k WHEN 0 THEN d ELSE v END AS txt FROM t, (SELECT unnest([0, 1]) AS k))
   SELECT 'sheet'||f AS file, i + (f%3=2)::INT AS row_no, col_no, CASE WHEN f%3<>2 THEN CASE k WHEN 0 THEN 'Date' ELSE 'Return' END WHEN col_no=0 THEN 'my export' ELSE '' END AS name, txt FROM c
   UNION ALL SELECT DISTINCT 'sheet'||f, 0, k, CASE k WHEN 0 THEN 'my export' ELSE '' END, CASE k WHEN 0 THEN 'x' ELSE 'y' END FROM t, (SELECT unnest([0, 1]) AS k) WHERE f%3=2""")
def header_shift(spark, folder):
    return FI.promote_header(titled_sheets(spark, folder)).select("file", F.col("row_no").cast("long").alias("row_no"), F.col("col_no").cast("long").alias("col_no"), "name", "txt")


@query("header_warnings", f"WITH t AS ({_TITLED}) SELECT DISTINCT 'sheet'||f AS file, 'no_header' AS code FROM t WHERE f%3=2")
def header_warnings(spark, folder):
    return FI.header_warnings(titled_sheets(spark, folder)).select("file", "code")


# --- streams -----------------------------------------------------------------------------------------
@query("stream_price_upsert", ctes("v_px", up="SELECT asset_key, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY asset_key, ts ORDER BY b DESC) rn FROM (SELECT asset_key, ts, close, 0 b FROM v_px WHERE ts<'2000-06-01' UNION ALL SELECT p.asset_key, p.ts, p.close*1.02::DOUBLE, 1 FROM v_px p JOIN (SELECT asset_key, max(ts) lt FROM v_px WHERE ts<'2000-06-01' GROUP BY 1) l USING (asset_key) WHERE p.ts>='2000-05-20' AND p.ts>=lt-INTERVAL 2 DAY)) WHERE rn=1") +
       f"SELECT asset_key, ts, {r('close')} FROM up")
def stream_price_upsert(spark, folder):
    """Two arrivals; the second repeats days of the first and some of them are too late."""
    inbox, store = fresh_folder(spark, "inbox"), fresh_folder(spark, "store")
    px = stage(v_px(spark, folder).withColumn("seq", F.lit(0)))
    px.where("ts < '2000-06-01'").write.mode("append").parquet(inbox)
    source = lambda: spark.readStream.schema(px.schema).parquet(inbox)
    mark = fresh_folder(spark, "mark")
    late = fresh_folder(spark, "late")
    SP.stream_price_upsert(source(), store, late, mark).awaitTermination()
    px.where("ts >= '2000-05-20'").withColumn("close", F.col("close") * d(1.02)).withColumn("seq", F.lit(1)).write.mode("append").parquet(inbox)
    SP.stream_price_upsert(source(), store, late, mark).awaitTermination()
    return pick(P.read_store(spark, store), ["asset_key", "ts"], ["close"])


@query("stream_live_drawdown", ctes("v_ret", p=path_sql("v_ret")) + f"SELECT strategy_id, max(n) n, {r('max_by(equity, idx)', 6, 'growth')}, {r('least(0,min(dd))', 6, 'mdd')}, {r('max_by(dd, idx)', 6, 'drawdown')}, {r('avg(ret)', 8, 'mean')}, 0::BIGINT AS late FROM p GROUP BY 1")
def stream_live_drawdown(spark, folder):
    live, _ = live_tables(spark, folder)
    latest = scan.keep_last(live, [ID], ["n", "batch_id"])
    return latest.select(ID, "n", rounded("growth").alias("growth"), rounded("mdd").alias("mdd"), rounded("drawdown").alias("drawdown"), rounded("mean", 8).alias("mean"), "late")


@query("stream_late_rows", ctes("v_ret") + f"SELECT strategy_id, ts, {r('ret', 6)} FROM v_ret WHERE ts < '1996-06-01'")
def stream_late_rows(spark, folder):
    """The side table of the live drawdown: a third arrival repeats the first days."""
    _, late = live_tables(spark, folder, "us < 833587200000000")  # 1996-06-01
    return late.select(ID, F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), rounded("ret", 6).alias("ret"))


def live_tables(spark, folder, again=None):
    """Current rows and late rows after two arrivals, and a third one that repeats the rows of ``again``."""
    inbox, live, late, mark = (fresh_folder(spark, n) for n in ("inbox", "live", "late", "mark"))
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    rows = stage(v_ret(spark, folder)).select(ID, us.alias("us"), "ret")
    cut = "us < 883612800000000"  # 1998-01-01
    for part in [cut, f"NOT ({cut})"] + ([again] if again else []):
        rows.where(part).write.mode("append").parquet(inbox)
        drawdown.stream_live_drawdown(spark.readStream.schema(rows.schema).parquet(inbox), live, late, mark).awaitTermination()
    return spark.read.parquet(live), spark.read.parquet(late)


# SQL: a day is closed when it ends no later than the newest time less a day; the second arrival repeats three days that the first one closed.
_CUT = "'2024-01-16 00:00:00'"
_AGAIN = "ts >= '2024-01-03' AND ts < '2024-01-06'"


def daily_streams(spark, folder):
    """(input rows, closed days, watermark) after two arrivals; the second one repeats old rows."""
    inbox, out, mark = (fresh_folder(spark, n) for n in ("inbox", "days", "mark"))
    rows = stage(v_evt(spark, folder).select(ID, "ts", "ret"))
    for seq, part in enumerate([f"ts < {_CUT}", f"ts >= {_CUT} OR {_AGAIN}"]):
        rows.where(part).withColumn("seq", F.lit(seq)).write.mode("append").parquet(inbox)
        source = spark.readStream.schema(f"{ID} long, ts timestamp_ntz, ret double, seq int").parquet(inbox)
        windows.stream_daily_compound(source, out, mark).awaitTermination()
    return spark.read.parquet(inbox), spark.read.parquet(out), windows.watermark(spark, mark)


@query("stream_daily_compound", ctes("v_evt") + f"SELECT strategy_id, ts::DATE AS day, {r('product(1+ret)-1', 6, 'ret')}, count(*) AS rows FROM v_evt WHERE ts::DATE + 1 <= (SELECT max(ts) FROM v_evt) - INTERVAL 1 DAY GROUP BY 1,2")
def stream_daily_compound(spark, folder):
    return pick(daily_streams(spark, folder)[1], [ID, "day"], ["ret"], ["rows"])


@query("stream_daily_dropped", ctes("v_evt") + f"SELECT strategy_id, ts, {r('ret', 6)} FROM v_evt WHERE {_AGAIN}")
def stream_daily_dropped(spark, folder):
    rows, days, mark = daily_streams(spark, folder)
    day = F.to_date("ts")
    out = windows.dropped_rows(rows.withColumn("day", day).withColumn("until", F.date_add(day, 1).cast("timestamp_ntz")), days, [ID, "day"], "until", mark)
    return pick(out, [ID, "ts"], ["ret"])


@query("stream_final_bars", ctes("v_px", al="SELECT asset_key, ts, close FROM v_px WHERE ts<'2000-06-01' UNION ALL SELECT asset_key, ts, close*1.02::DOUBLE FROM v_px WHERE ts>='2000-06-01'",
                                 wm="SELECT max(ts) - INTERVAL 2 DAY w FROM v_px", w1="SELECT max(ts) - INTERVAL 2 DAY w FROM v_px WHERE ts<'2000-06-01'",
                                 up="SELECT asset_key, ts, CASE WHEN ts > (SELECT w FROM w1) AND ts<'2000-06-01' THEN close*1.02::DOUBLE ELSE close END AS close FROM al") + f"SELECT asset_key, ts, {r('close')} FROM up WHERE ts <= (SELECT w FROM wm)")
def stream_final_bars(spark, folder):
    """Two arrivals; the second repeats days of the first: those still open are replaced, those already closed are dropped."""
    inbox, store, closed, mark = (fresh_folder(spark, n) for n in ("inbox", "store", "closed", "mark"))
    px = stage(v_px(spark, folder))
    for seq, part in enumerate([px.where("ts < '2000-06-01'"), px.where("ts >= '2000-05-20'").withColumn("close", F.col("close") * d(1.02))]):
        part.withColumn("seq", F.lit(seq)).write.mode("append").parquet(inbox)
        source = spark.readStream.schema(spark.read.parquet(inbox).schema).parquet(inbox)
        windows.stream_final_bars(source, store, closed, mark).awaitTermination()
    return pick(P.read_store(spark, store), ["asset_key", "ts"], ["close"])
