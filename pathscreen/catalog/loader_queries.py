"""Named queries over the loader: files of events, decoded, profiled and loaded; every fact comes from the cells."""
from __future__ import annotations

from pyspark.sql import functions as F

from pathscreen.catalog.registry import pick, query, r, rounded, table
from pathscreen.operators import batch, loader as L
from pathscreen.operators.metrics import ID
from pathscreen.sources import files as FI
from pathscreen.staging import stage

# A hundred events per file; the file number modulo 12 (kind 6 is an empty file), else modulo 6, gives its form.
FORMS = """SELECT f, k, event_id, ts, CASE k WHEN 1 THEN CAST(CAST(value+1 AS DECIMAL(12,3)) AS VARCHAR) WHEN 4 THEN event_type WHEN 5 THEN CAST(CAST((value-45)/10 AS DECIMAL(12,3)) AS VARCHAR)
   ELSE CASE WHEN event_id%17=0 THEN 'n/a' ELSE CAST(CAST((value-45)/1000 AS DECIMAL(12,5)) AS VARCHAR) END END c1
   FROM (SELECT *, event_id//100 f, CASE WHEN (event_id//100)%12=6 THEN 6 ELSE (event_id//100)%6 END k FROM events)"""
HEADS = ("date,daily return", "Time,Equity", "width,x", "date,a,b", "date,note", "date,ret_pct_ratio", "")


def upload_files(spark, folder):
    e = table(spark, folder, "events")
    f = F.floor(F.col("event_id") / 100)
    k = F.when(f % 12 == 6, F.lit(6)).otherwise(f % 6).cast("int")
    number = lambda x, kind: x.cast(kind).cast("string")
    c1 = (F.when(k == 1, number(F.col("value") + 1, "decimal(12,3)")).when(k == 4, F.col("event_type")).when(k == 5, number((F.col("value") - 45) / 10, "decimal(12,3)"))
          .when(F.col("event_id") % 17 == 0, F.lit("n/a")).otherwise(number((F.col("value") - 45) / 1000, "decimal(12,5)")))
    c0 = F.when(k == 2, F.concat(F.lit("w"), F.col("event_id").cast("string"))).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    line = F.concat(c0, F.lit(","), c1, F.when(k == 3, F.concat(F.lit(","), F.col("event_id").cast("string"))).otherwise(""))
    rows = e.select(f.alias("f"), k.alias("k"), F.struct("event_id", line.alias("line")).alias("l"))
    agg = rows.groupBy("f", "k").agg(F.array_sort(F.collect_list("l")).alias("ls"))  # a hundred lines per file
    head = F.element_at(F.array(*[F.lit(h) for h in HEADS]), F.col("k") + 1)
    body = F.concat(head, F.lit("\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    return agg.select(F.concat(F.lit("file"), F.col("f").cast("string")).alias("path"), F.encode(F.when(F.col("k") == 6, "").otherwise(body), "UTF-8").alias("content"))


def decoded(spark, folder):
    return stage(FI.decode_files(upload_files(spark, folder)))


def cells(dec):
    sheets = FI.good_cells(dec).withColumnRenamed("path", "file").withColumn("sheet", F.lit("S1"))
    return FI.promote_header(sheets).drop("sheet")


# SQL: the rows as the loader should type them; kind 3 has a second number, the kinds' shares follow from the cells.
_CELLS = "fo AS (" + FORMS + """), ce AS (SELECT 'file'||f AS file, f, k, event_id, date_trunc('second', ts)::TIMESTAMP ts, try_cast(c1 AS DOUBLE) v FROM fo WHERE k<>6)"""
_SIZE = """sz AS (SELECT file, k, count(*) AS rows, count(v)/count(*)::DOUBLE share FROM ce GROUP BY 1,2),
   co AS (SELECT *, CASE WHEN k=2 THEN 'no_date' WHEN k=3 AND share>0.8::DOUBLE THEN 'ambiguous_value' WHEN k<>3 AND share<=0.8::DOUBLE THEN 'no_numeric' END code FROM sz),
   ok AS (SELECT ce.file, ce.k, ts, v, event_id FROM ce JOIN co USING (file) WHERE code IS NULL AND v IS NOT NULL),
   la AS (SELECT file, k, ts, max_by(v, event_id) v FROM ok GROUP BY 1,2,3),
   sh AS (SELECT file FROM la GROUP BY 1 HAVING count(*)<3),
   rt AS (SELECT file, k, ts, CASE WHEN k=1 THEN v/lag(v) OVER (PARTITION BY file ORDER BY ts)-1 ELSE v END ret FROM la WHERE file NOT IN (SELECT file FROM sh)),
   lo AS (SELECT file FROM rt WHERE k<>1 GROUP BY 1 HAVING min(ret)<=-1),
   fw AS (SELECT file FROM rt WHERE file NOT IN (SELECT file FROM lo) GROUP BY 1 HAVING count(ret)<3),
   se AS (SELECT * FROM rt WHERE ret IS NOT NULL AND file NOT IN (SELECT file FROM lo) AND file NOT IN (SELECT file FROM fw)) """
LOAD = "WITH " + _CELLS + ", " + _SIZE


@query("column_profile", "WITH " + _CELLS + f""" SELECT file, 1 AS col_no, count(*) AS rows, {r('count(v)/count(*)::DOUBLE', 6, 'numeric_share')}, {r('median(abs(v))', 6, 'median_abs')} FROM ce GROUP BY 1""")
def column_profile(spark, folder):
    out = L.column_profile(stage(L.typed_cells(cells(decoded(spark, folder)))))
    return pick(out.where("col_no = 1"), ["file", "col_no", "rows"], ["numeric_share", "median_abs"])


# SQL: a number is a date by the magnitude of its column, else where its text is a year of four to six digits.
_PROFILE = "WITH " + _CELLS + f""", e AS (SELECT file, k, event_id, event_id::VARCHAR t, median(event_id) OVER (PARTITION BY file) m FROM ce WHERE k=3),
   p AS (SELECT file, 0 AS col_no, CASE k WHEN 1 THEN 'time' WHEN 2 THEN 'width' ELSE 'date' END AS norm, count(*) AS rows, k, CASE k WHEN 2 THEN 0 ELSE 1 END::DOUBLE AS dates, 0::DOUBLE AS numbers, NULL::DOUBLE AS med FROM ce GROUP BY file, k
   UNION ALL SELECT file, 1, CASE k WHEN 0 THEN 'daily_return' WHEN 1 THEN 'equity' WHEN 2 THEN 'x' WHEN 3 THEN 'a' WHEN 4 THEN 'note' ELSE 'ret_pct_ratio' END, count(*), k, 0, count(v)/count(*)::DOUBLE, median(abs(v)) FROM ce GROUP BY file, k
   UNION ALL SELECT file, 2, 'b', count(*), k, avg(CASE WHEN m>=20000 AND m<80000 OR m>=100000000 THEN 1 WHEN m>=19000000 AND m<30000000 THEN (try_strptime(t, '%Y%m%d') IS NOT NULL)::INT ELSE (event_id BETWEEN 1000 AND 294246)::INT END), 1, median(event_id) FROM e GROUP BY file, k)
   SELECT file, col_no, norm, rows, CASE k WHEN 3 THEN 3 ELSE 2 END::BIGINT AS cols, {r('dates', 6, 'date_share')}, {r('numbers', 6, 'numeric_share')}, {r('med', 6, 'median_abs')}, false AS is_pct FROM p"""


@query("column_profile_all", _PROFILE)
def column_profile_all(spark, folder):
    """Every column of every file that has cells, with all facts; ``column_profile`` gives the second column alone."""
    out = L.column_profile(stage(L.typed_cells(cells(decoded(spark, folder)))))
    return out.select("file", "col_no", "norm", "rows", "cols", rounded("date_share").alias("date_share"), rounded("numeric_share").alias("numeric_share"), rounded("median_abs").alias("median_abs"), "is_pct")


@query("load_returns", LOAD + f"SELECT file AS strategy_id, ts, {r('ret', 8)} FROM se")
def load_returns(spark, folder):
    return pick(L.load_returns(cells(decoded(spark, folder))).series, [ID, "ts"], ["ret"], digits=8)


@query("load_meta", LOAD + """SELECT se.file AS strategy_id, CASE WHEN se.k=1 THEN 'equity' ELSE 'returns' END input_type, CASE se.k WHEN 0 THEN 'daily_return' WHEN 1 THEN 'equity' WHEN 3 THEN 'b' ELSE 'ret_pct_ratio' END value_column,
   CASE WHEN se.k=1 THEN 'time' ELSE 'date' END date_column, count(*) AS n, any_value(sz.rows)-any_value(va.n) AS n_dropped, min(ts) AS start, max(ts) AS "end" FROM se JOIN sz USING (file) JOIN (SELECT file, count(*) n FROM ok GROUP BY 1) va USING (file) GROUP BY se.file, se.k""")
def load_meta(spark, folder):
    return L.load_returns(cells(decoded(spark, folder))).meta.select(ID, "input_type", "value_column", "date_column", "n", "n_dropped", "start", "end")


@query("load_rejects", LOAD + """SELECT file AS strategy_id, code FROM co WHERE code IS NOT NULL UNION ALL SELECT file, 'short_series' FROM sh UNION ALL SELECT file, 'total_loss' FROM lo UNION ALL SELECT file, 'few_returns' FROM fw
   UNION ALL SELECT DISTINCT 'file'||f, 'empty_file' FROM fo WHERE k=6""")
def load_rejects(spark, folder):
    dec = decoded(spark, folder)
    return L.load_returns(cells(dec)).rejects.unionByName(FI.file_rejects(dec).select(F.col("path").alias(ID), "code"))


_WARN_CTE = """, ab AS (SELECT file, quantile_cont(abs(ret), 0.5) m, quantile_cont(abs(ret), 0.9) p, avg((abs(ret)>1)::INT) b, sum((ret>3)::INT) e FROM se WHERE k<>1 GROUP BY 1), va AS (SELECT file, count(*) n FROM ok GROUP BY 1)"""
_WARN = """SELECT DISTINCT se.file AS strategy_id, 'rows_dropped' AS code FROM se JOIN sz USING (file) JOIN va USING (file) WHERE va.n<sz.rows UNION ALL SELECT file, 'UNITS_LARGE' FROM ab WHERE m>0.2::DOUBLE OR p>0.8::DOUBLE
   UNION ALL SELECT file, CASE WHEN b>0.5::DOUBLE THEN 'MOSTLY_ABOVE_ONE' ELSE 'EXTREME_BARS' END FROM ab WHERE b>0.5::DOUBLE OR e>0"""


@query("load_warnings", LOAD + _WARN_CTE + " " + _WARN)
def load_warnings(spark, folder):
    return L.load_returns(cells(decoded(spark, folder))).warnings


@query("loader_warning_counts", LOAD + _WARN_CTE + f""", wa AS ({_WARN}) SELECT * FROM (SELECT 'warning' AS kind, code, count(*) AS rows, row_number() OVER (ORDER BY count(*) DESC, code) AS rank FROM wa GROUP BY code) WHERE rank <= 20""")
def loader_warning_counts(spark, folder):
    """The twenty most frequent warnings, the length of that report."""
    codes = L.load_returns(cells(decoded(spark, folder))).warnings.select(F.array("code").alias("codes"))
    return batch.code_counts(codes, {"warning": "codes"}, top=20)


def batch_results_table(spark, folder):
    files = upload_files(spark, folder)
    dec = stage(FI.decode_files(files))
    out = L.load_returns(cells(dec))
    rejects = out.rejects.unionByName(FI.file_rejects(dec).select(F.col("path").alias(ID), "code"))
    return batch.results(files.select(F.col("path").alias(ID)), out.meta.select(ID, "input_type", "n"), rejects)


_REJ = """rj AS (SELECT file, code FROM co WHERE code IS NOT NULL UNION ALL SELECT file, 'short_series' FROM sh UNION ALL SELECT file, 'total_loss' FROM lo UNION ALL SELECT file, 'few_returns' FROM fw
   UNION ALL SELECT DISTINCT 'file'||f, 'empty_file' FROM fo WHERE k=6),
   br AS (SELECT 'file'||f AS strategy_id, any_value(s.input_type) input_type, any_value(s.n) n, count(s.n)>0 ok, coalesce(string_agg(DISTINCT rj.code, '|'), '') AS error FROM (SELECT DISTINCT f FROM fo) i
     LEFT JOIN (SELECT file, CASE WHEN k=1 THEN 'equity' ELSE 'returns' END input_type, count(*) n FROM se GROUP BY file, k) s ON s.file='file'||f LEFT JOIN rj ON rj.file='file'||f GROUP BY f) """


@query("batch_results", LOAD + ", " + _REJ + "SELECT strategy_id, input_type, n, ok, error FROM br")
def batch_results(spark, folder):
    return batch_results_table(spark, folder).select(ID, "input_type", "n", "ok", "error")


@query("batch_totals", LOAD + ", " + _REJ + "SELECT count(*) AS total_inputs, sum(ok::INT)::BIGINT AS ok, (count(*)-sum(ok::INT))::BIGINT AS failed, round(avg(ok::INT::DOUBLE), 6) AS success_rate FROM br")
def batch_totals(spark, folder):
    return batch.totals(batch_results_table(spark, folder))
