"""Named queries over the metric operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from pathscreen.catalog.registry import cdf_sql, pick, ppf_sql, query, r, rounded
from pathscreen.catalog.views import base_sql, ctes, path_sql, psr_sql, v_beta, v_evt, v_px, v_ret, v_trd
from pathscreen.functions.exprs import EULER_GAMMA, TRIALS_CAP, d
from pathscreen.operators import metrics as M, scan

ID = M.ID
BASE = ctes("v_ret", b=base_sql("v_ret"))
PATH = ctes("v_ret", p=path_sql("v_ret"))


def _base_query(name: str, cols, extra=(), digits: int = 6):
    sql = BASE + "SELECT strategy_id, " + ", ".join([r(c, digits) for c in cols] + list(extra)) + " FROM b"

    @query(name, sql)
    def run(spark, folder):
        return pick(M.base_metrics(v_ret(spark, folder)), [ID], cols, extra, digits)
    return run


_base_query("cagr", ["cagr", "growth"])
_base_query("sharpe", ["sharpe"])
_base_query("sortino", ["sortino"])
_base_query("win_rate", ["win_rate"])
_base_query("profit_factor", ["profit_factor"])
_base_query("sharpe_se", ["sr", "se"])
_base_query("moments", ["skew", "kurt"])
_base_query("growth_concentration", ["eff_n", "top1_share"])
_base_query("series_meta", ["span_years", "ppy"], ["n", "start"])


MDD = ctes("v_ret", p=path_sql("v_ret"), m="SELECT strategy_id, least(0, min(dd)) mdd, max(n) n FROM p GROUP BY strategy_id")


@query("max_drawdown", MDD + f"SELECT strategy_id, {r('mdd')} FROM m")
def max_drawdown(spark, folder):
    return pick(M.drawdowns(v_ret(spark, folder)), [ID], ["mdd"])


CALMAR = ctes("v_ret", b=base_sql("v_ret"), p=path_sql("v_ret"),
              m="SELECT strategy_id, least(0, min(dd)) mdd FROM p GROUP BY strategy_id",
              c="SELECT b.*, mdd, CASE WHEN mdd>=0 THEN 0 ELSE cagr/abs(mdd) END calmar FROM b JOIN m USING (strategy_id)")


@query("calmar", CALMAR + f"SELECT strategy_id, {r('cagr')}, {r('mdd')}, {r('calmar')} FROM c")
def calmar(spark, folder):
    ret = v_ret(spark, folder)
    j = M.base_metrics(ret).join(M.drawdowns(ret).select(ID, "mdd"), ID)
    return pick(j.withColumn("calmar", M.calmar_expr(F.col("cagr"), F.col("mdd"))), [ID], ["cagr", "mdd", "calmar"])


_CORE = ["cagr", "sharpe", "sortino", "calmar", "mdd", "cvar"]
_TAIL = """SELECT strategy_id, avg(ret) cvar FROM (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY ret) rk,
    count(*) OVER (PARTITION BY strategy_id) nn FROM v_ret) WHERE rk<=greatest(1, floor(0.05::DOUBLE*nn)) GROUP BY strategy_id"""
CORE = CALMAR.rstrip() + f",\nt AS ({_TAIL}),\nk AS (SELECT c.*, cvar FROM c JOIN t USING (strategy_id))\n"


@query("core_metrics", CORE + "SELECT strategy_id, " + ", ".join(r(c) for c in _CORE) + " FROM k")
def core_metrics(spark, folder):
    return pick(M.core_metrics(v_ret(spark, folder)), [ID], _CORE)


@query("cvar", ctes("v_ret", t=_TAIL) + f"SELECT strategy_id, {r('cvar')} FROM t")
def cvar(spark, folder):
    return pick(M.tail_stats(v_ret(spark, folder)), [ID], ["cvar"])


_DROP = """SELECT strategy_id, max(k)::BIGINT drop_k, product(1+ret) fg, product(CASE WHEN rk>k THEN 1+ret ELSE 1 END) rg, max(nn) nn
  FROM (SELECT *, greatest(3, round_even(0.05::DOUBLE*nn, 0)) k FROM (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY ret DESC) rk,
    count(*) OVER (PARTITION BY strategy_id) nn FROM v_ret)) GROUP BY strategy_id"""
_KEEP = """CASE WHEN nn<=drop_k THEN 0 WHEN fg<=1 THEN CASE WHEN rg>=fg THEN 1 ELSE 0 END ELSE least(greatest((rg-1)/(fg-1),0),1) END"""


@query("drop_top_k", ctes("v_ret", t=_DROP) +
       f"SELECT strategy_id, drop_k, {r(_KEEP, 6, 'keep_after_drop')}, {r('rg', 6, 'growth_after_drop')} FROM t")
def drop_top_k(spark, folder):
    return pick(M.tail_stats(v_ret(spark, folder)), [ID], ["keep_after_drop", "growth_after_drop"], ["drop_k"])


PSR = ctes("v_ret", b=base_sql("v_ret"), q=psr_sql("b"), u=psr_sql("b", False))


@query("psr", PSR + f"SELECT q.strategy_id, {r('q.psr', 6, 'psr')}, {r('u.psr', 6, 'psr_raw')} FROM q JOIN u USING (strategy_id)")
def psr(spark, folder):
    b = M.base_metrics(v_ret(spark, folder))
    out = M.with_psr(b).withColumnRenamed("psr", "psr_kept").drop("denom", "_z")
    out = M.with_psr(out, clip_positive_skew=False).withColumnRenamed("psr", "psr_raw").withColumnRenamed("psr_kept", "psr")
    return pick(out, [ID], ["psr", "psr_raw"])


def best_z_sql(n: str) -> str:
    return (f"(CASE WHEN {n}<=1 THEN 0 ELSE {1 - EULER_GAMMA!r}::DOUBLE*{ppf_sql(f'(1-1/({n})::DOUBLE)')}"
            f"+{EULER_GAMMA!r}::DOUBLE*{ppf_sql(f'(1-1/(({n})::DOUBLE*2.718281828459045::DOUBLE))')} END)")


@query("dsr", PSR.rstrip() + ", e AS (SELECT *, 1+strategy_id*4 nt FROM q), f AS (SELECT *, z0-" + best_z_sql("nt") + " dz FROM e) "
       f"SELECT strategy_id, nt AS n_trials, {r(cdf_sql('dz'), 6, 'dsr')} FROM f")
def dsr(spark, folder):
    b = M.with_psr(M.base_metrics(v_ret(spark, folder))).withColumn("n_trials", F.lit(1) + F.col(ID) * 4)
    return pick(M.with_dsr(b, F.col("n_trials")), [ID], ["dsr"], ["n_trials"])


@query("trial_budget", PSR.rstrip() + ", g AS (SELECT k, " + best_z_sql("k") + " gz FROM range(1, 524289) t(k)) "
       f"""SELECT strategy_id, CASE WHEN denom IS NULL THEN NULL WHEN max(k) FILTER (WHERE {cdf_sql('(z0-gz)')}>=0.95) IS NULL THEN 0
       WHEN max(k) FILTER (WHERE {cdf_sql('(z0-gz)')}>=0.95)=524288 THEN {TRIALS_CAP}
       ELSE max(k) FILTER (WHERE {cdf_sql('(z0-gz)')}>=0.95) END::BIGINT trial_budget FROM q, g GROUP BY strategy_id, denom""")
def trial_budget(spark, folder):
    b = M.with_psr(M.base_metrics(v_ret(spark, folder)))
    return M.with_dsr(b, F.lit(1)).select(ID, "trial_budget")


_BLK = """SELECT strategy_id, avg((s>0)::INT::DOUBLE) bpf, count(*) nb FROM (SELECT strategy_id, blk, sum(ret) s FROM (
  SELECT *, CASE WHEN idx-1 < (n%k)*(n//k+1) THEN (idx-1)//(n//k+1) ELSE (n%k)+((idx-1)-(n%k)*(n//k+1))//(n//k) END blk
  FROM (SELECT *, least(n, 12, greatest(4, n//30)) k FROM p)) GROUP BY strategy_id, blk) GROUP BY strategy_id"""


@query("block_pos_frac", PATH.rstrip() + f", t AS ({_BLK}) SELECT strategy_id, {r('bpf', 6, 'block_pos_frac')}, nb AS n_blocks FROM t")
def block_pos_frac(spark, folder):
    return pick(M.block_positive_share(M.path(v_ret(spark, folder))), [ID], ["block_pos_frac"], ["n_blocks"])


_AC = """SELECT strategy_id, max(n) n, CASE WHEN max(n)<=3 OR stddev_samp(ret)<1e-12 THEN 0 ELSE coalesce(corr(ret, prev),0) END ac FROM p GROUP BY strategy_id"""


@query("autocorr", PATH.rstrip() + f", t AS ({_AC}) SELECT strategy_id, n, {r('ac', 6, 'autocorr')} FROM t")
def autocorr(spark, folder):
    return pick(M.autocorr(M.path(v_ret(spark, folder))), [ID], ["autocorr"], ["n"])


_MON = "SELECT strategy_id, date_trunc('month', ts)::DATE AS month, sum(ret) s, product(1+ret) g, min(ts) t0, max(ts) t1 FROM v_ret GROUP BY 1,2"


@query("max_month", ctes("v_ret", m=_MON) + """SELECT strategy_id, round(CASE WHEN date_diff('month', min(month), max(month))+1 > count(*)
  THEN greatest(max(g-1),0) ELSE max(g-1) END, 6)+0.0::DOUBLE AS max_month FROM m GROUP BY strategy_id""")
def max_month(spark, folder):
    return pick(M.max_month(M.months(v_ret(spark, folder))), [ID], ["max_month"])


_REC = """SELECT strategy_id, unit, max(bucket)-min(bucket)+1 n_blocks, sum(gain) tot, max(gain) top, list(gain) gs FROM (
  SELECT strategy_id, unit, ((year(month)*12+month(month)-1)//CASE unit WHEN 'year' THEN 12 WHEN 'quarter' THEN 3 ELSE 1 END) bucket, greatest(sum(s),0) gain
  FROM m JOIN (SELECT strategy_id, CASE WHEN y>=3 THEN 'year' WHEN y>=1 THEN 'quarter' ELSE 'month' END unit FROM
    (SELECT strategy_id, greatest(floor(epoch_us(max(t1))/86400000000.0::DOUBLE-epoch_us(min(t0))/86400000000.0::DOUBLE)/365.25::DOUBLE, 1e-9) y FROM m GROUP BY 1)) USING (strategy_id)
  GROUP BY 1,2,3) GROUP BY 1,2"""


@query("calendar_recurrence", ctes("v_ret", m=_MON, t=_REC) + f"""SELECT strategy_id, unit, n_blocks,
   {r("CASE WHEN tot<=0 THEN 0 ELSE len(list_filter(gs, lambda x: x/tot>0.05::DOUBLE))/n_blocks END", 6, 'recurrence')},
   {r("CASE WHEN tot<=0 THEN 1 ELSE top/tot END", 6, 'top_block_share')} FROM t""")
def calendar_recurrence(spark, folder):
    return pick(M.recurrence(M.months(v_ret(spark, folder))), [ID], ["recurrence", "top_block_share"], ["unit", "n_blocks"])


@query("daily_compound", ctes("v_evt") + f"SELECT strategy_id, ts::DATE AS day, {r('product(1+ret)-1', 6, 'ret')}, count(*) AS rows FROM v_evt GROUP BY 1,2")
def daily_compound(spark, folder):
    return pick(M.daily_compound(v_evt(spark, folder)), [ID, "day"], ["ret"], ["rows"])


# --- windows ----------------------------------------------------------------------------------
@query("equity_curve", PATH + f"""SELECT strategy_id, idx AS seq, ts, {r('equity')} FROM p UNION ALL
  SELECT strategy_id, 0, min(ts)-(max(ts)-min(ts)), 1.0::DOUBLE FROM p WHERE idx<=2 GROUP BY strategy_id""")
def equity_curve(spark, folder):
    return pick(M.curve(v_ret(spark, folder)), [ID, "seq", "ts"], ["equity"])


@query("running_peak", PATH + f"SELECT strategy_id, ts, {r('equity')}, {r('peak')} FROM p")
def running_peak(spark, folder):
    return pick(M.path(v_ret(spark, folder)), [ID, "ts"], ["equity", "peak"])


@query("drawdown_path", PATH + f"SELECT strategy_id, ts, {r('dd')} FROM p")
def drawdown_path(spark, folder):
    return pick(M.path(v_ret(spark, folder)), [ID, "ts"], ["dd"])


_PCT = "SELECT asset_key, ts, close/lag(close) OVER (PARTITION BY asset_key ORDER BY ts)-1 ret FROM v_px"


@query("pct_change", ctes("v_px", t=_PCT) + f"SELECT asset_key, ts, {r('ret')} FROM t WHERE ret IS NOT NULL")
def pct_change(spark, folder):
    return pick(M.pct_change(v_px(spark, folder), ["asset_key"], "ts", "close"), ["asset_key", "ts"], ["ret"])


_EQ = "SELECT strategy_id, ts, 10000*equity AS lvl FROM p"


@query("equity_to_returns", PATH.rstrip() + f", e AS ({_EQ}), t AS (SELECT strategy_id, ts, lvl/lag(lvl) OVER (PARTITION BY strategy_id ORDER BY ts)-1 ret FROM e WHERE lvl>0) "
       f"SELECT strategy_id, ts, {r('ret', 10)} FROM t WHERE ret IS NOT NULL")
def equity_to_returns(spark, folder):
    levels = M.path(v_ret(spark, folder)).select(ID, "ts", (F.col("equity") * d(10000)).alias("level")).where("level > 0")
    return pick(M.pct_change(levels, [ID], "ts", "level"), [ID, "ts"], ["ret"], digits=10)


_HO = """SELECT *, CASE WHEN sqrt(se_tr*se_tr+se_ho*se_ho)>0 THEN (sr_tr-sr_ho)/sqrt(se_tr*se_tr+se_ho*se_ho) ELSE 0 END z FROM (
  SELECT *, sqrt((1+0.5::DOUBLE*sr_tr*sr_tr)/n_tr) se_tr, sqrt((1+0.5::DOUBLE*sr_ho*sr_ho)/n_ho) se_ho FROM (
  SELECT strategy_id, count(*) FILTER (WHERE idx<=floor(0.7::DOUBLE*n)) n_tr, count(*) FILTER (WHERE idx>floor(0.7::DOUBLE*n)) n_ho,
  avg(ret) FILTER (WHERE idx<=floor(0.7::DOUBLE*n))/stddev_samp(ret) FILTER (WHERE idx<=floor(0.7::DOUBLE*n)) sr_tr,
  avg(ret) FILTER (WHERE idx>floor(0.7::DOUBLE*n))/stddev_samp(ret) FILTER (WHERE idx>floor(0.7::DOUBLE*n)) sr_ho FROM p GROUP BY 1))"""


@query("train_holdout_split", PATH.rstrip() + f", t AS ({_HO}) SELECT strategy_id, n_tr, n_ho, " + ", ".join(r(c) for c in ("sr_tr", "se_tr", "sr_ho", "se_ho", "z")) + " FROM t")
def train_holdout_split(spark, folder):
    return pick(M.holdout(M.path(v_ret(spark, folder))), [ID], ["sr_tr", "se_tr", "sr_ho", "se_ho", "z"], ["n_tr", "n_ho"])


def segment_sql(cond: str, a: str, b: str) -> str:
    """CTEs g (rows with segment) and s (segment metrics with the full-path ppy), from p."""
    full = "CASE WHEN wspan>0 THEN wn/wspan ELSE 252.0::DOUBLE END"
    return (f", w AS (SELECT strategy_id, max(n) wn, (epoch_us(max(ts))-epoch_us(min(ts)))::DOUBLE/31557600000000.0::DOUBLE wspan FROM p GROUP BY 1)"
            f", g AS (SELECT strategy_id, ts, ret, CASE WHEN {cond} THEN '{a}' ELSE '{b}' END segment, {full} wppy FROM p JOIN w USING (strategy_id))"
            f", s0 AS ({base_sql('g', 'strategy_id, segment', extra=', max(wppy) wppy', ppy='wppy')})"
            f", gp AS ({path_sql('g', keys='strategy_id, segment')})"
            f", s AS (SELECT s0.*, mdd, CASE WHEN mdd>=0 THEN 0 ELSE cagr/abs(mdd) END calmar FROM s0 JOIN (SELECT strategy_id, segment, least(0,min(dd)) mdd FROM gp GROUP BY 1,2) USING (strategy_id, segment)) ")


@query("oos_gate", PATH.rstrip() + segment_sql("idx<=floor(0.7::DOUBLE*n)", "train", "oos") + """
  , o AS (SELECT strategy_id, max(calmar) FILTER (WHERE segment='train') train_calmar, max(calmar) FILTER (WHERE segment='oos') oos_calmar,
   max(cagr) FILTER (WHERE segment='oos') oos_cagr, max(sharpe) FILTER (WHERE segment='oos') oos_sharpe, max(mdd) FILTER (WHERE segment='oos') oos_mdd,
   max(n) FILTER (WHERE segment='train') train_n, max(n) FILTER (WHERE segment='oos') oos_n FROM s GROUP BY 1)
  SELECT strategy_id, """ + ", ".join(r(c) for c in ("train_calmar", "oos_calmar", "oos_cagr", "oos_sharpe", "oos_mdd")) + ", train_n, oos_n FROM o WHERE train_n+oos_n>=264 AND train_n>=120 AND oos_n>=80")
def oos_gate(spark, folder):
    return pick(M.oos_gate(M.path(v_ret(spark, folder))), [ID], ["train_calmar", "oos_calmar", "oos_cagr", "oos_sharpe", "oos_mdd"], ["train_n", "oos_n"])


_RC = "greatest(floor(n*0.67::DOUBLE), n-greatest(40, floor(n*0.33::DOUBLE)))"


@query("recent_prior_split", PATH.rstrip() + segment_sql(f"idx<={_RC}", "prior", "recent") +
       "SELECT strategy_id, segment, n, " + ", ".join(r(c) for c in ("sharpe", "cagr", "mdd")) + " FROM s")
def recent_prior_split(spark, folder):
    p = M.path(v_ret(spark, folder))
    seg = F.when(F.col("idx") <= M.recent_cut(F.col("n")), "prior").otherwise("recent")
    return pick(M.segment_metrics(p, seg), [ID, "segment", "n"], ["sharpe", "cagr", "mdd"])


# --- limits and sets ----------------------------------------------------------------------------
@query("dedupe_keep_last", ctes("v_evt") + f"SELECT strategy_id, hour, event_id, {r('ret')} FROM (SELECT *, row_number() OVER (PARTITION BY strategy_id, hour ORDER BY event_id DESC) rn FROM (SELECT *, date_trunc('hour', ts) AS hour FROM v_evt)) WHERE rn=1")
def dedupe_keep_last(spark, folder):
    e = v_evt(spark, folder).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return pick(scan.keep_last(e, [ID, "hour"], ["event_id"]), [ID, "hour", "event_id"], ["ret"])


@query("keep_last_n", PATH + f"SELECT strategy_id, ts, {r('ret')} FROM p WHERE idx>n-250")
def keep_last_n(spark, folder):
    return pick(scan.keep_last_n(v_ret(spark, folder), [ID], ["ts"], 250), [ID, "ts"], ["ret"])


# --- scalar functions -----------------------------------------------------------------------------
from pathscreen.functions import exprs as X  # noqa: E402


@query("norm_cdf", ctes("v_ret") + f"SELECT strategy_id, ts, {r(cdf_sql('x'), 9, 'phi')} FROM (SELECT strategy_id, ts, ret*120 x FROM v_ret)")
def norm_cdf(spark, folder):
    return v_ret(spark, folder).withColumn("x", F.col("ret") * 120).select(ID, "ts", rounded(X.norm_cdf(F.col("x")), 9).alias("phi"))


@query("norm_ppf", f"SELECT event_id, {r(ppf_sql('p'), 7, 'z')} FROM (SELECT event_id, ((event_id*7919)%99991+1)/99993.0::DOUBLE p FROM events)")
def norm_ppf(spark, folder):
    from pathscreen.catalog.registry import table
    p = ((F.col("event_id") * 7919) % 99991 + 1) / d(99993)
    return table(spark, folder, "events").withColumn("p", p).select("event_id", rounded(X.norm_ppf(F.col("p")), 7).alias("z"))


_SAT = """SELECT strategy_id, ts, ret, CASE WHEN ret<=0 THEN 0 ELSE ret/(ret+0.02::DOUBLE) END sat,
  least(greatest((ret+0.05::DOUBLE)/0.1::DOUBLE,0),1) lin, (ret+0.06::DOUBLE)*800 x FROM v_ret"""


@query("sat_lin_lerp", ctes("v_ret", t=_SAT) + f"""SELECT strategy_id, ts, {r('sat', 10)}, {r('lin', 10)},
  round(least(greatest(CASE WHEN x<=0 THEN 40 WHEN x<=35 THEN 40+20*x/35 WHEN x<=55 THEN 60+(x-35) WHEN x<=70 THEN 80+10*(x-55)/15 WHEN x<=99 THEN 90+10*(x-70)/29 ELSE 100 END,0),99.9::DOUBLE),4)+0.0::DOUBLE AS shown FROM t""")
def sat_lin_lerp(spark, folder):
    t = v_ret(spark, folder).withColumn("x", (F.col("ret") + d(0.06)) * d(800))
    return t.select(ID, "ts", rounded(X.sat(F.col("ret"), d(0.02)), 10).alias("sat"), rounded(X.lin(F.col("ret"), -0.05, 0.05), 10).alias("lin"),
                    rounded(X.clip(X.lerp(F.col("x")), 0, 99.9), 4).alias("shown"))


@query("overfit_index", ctes("v_ret") + f"SELECT strategy_id, ts, {r('least(greatest(100-(ret*4000+50),0),100)', 5, 'overfit')} FROM v_ret")
def overfit_index(spark, folder):
    return v_ret(spark, folder).select(ID, "ts", rounded(X.overfit_index(F.col("ret") * d(4000) + d(50)), 5).alias("overfit"))


@query("naive_time", """SELECT event_id, ts_text, date_trunc('second', ts) AS ts FROM (SELECT event_id, ts, strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
   CASE event_id%4 WHEN 0 THEN 'Z' WHEN 1 THEN '+08:00' WHEN 2 THEN '-0500' ELSE '' END ts_text FROM events)""")
def naive_time(spark, folder):
    from pathscreen.catalog.registry import table
    m = F.col("event_id") % 4
    zone = F.when(m == 0, "Z").when(m == 1, "+08:00").when(m == 2, "-0500").otherwise("")
    text = F.concat(F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd'T'HH:mm:ss"), zone)
    return table(spark, folder, "events").select("event_id", text.alias("ts_text")).withColumn("ts", X.naive_time(F.col("ts_text")))


@query("flagship_calmar_ranking", CALMAR + f"SELECT strategy_id, n, {r('cagr')}, {r('sharpe')}, {r('mdd')}, {r('calmar')}, row_number() OVER (ORDER BY round(calmar,6) DESC, strategy_id) AS rank FROM c")
def flagship(spark, folder):
    """Track records ranked by Calmar: the smallest end-to-end query."""
    from pyspark.sql import Window
    ret = v_ret(spark, folder)
    j = M.base_metrics(ret).join(M.drawdowns(ret).select(ID, "mdd"), ID)
    j = j.withColumn("calmar", M.calmar_expr(F.col("cagr"), F.col("mdd")))
    out = pick(j, [ID, "n"], ["cagr", "sharpe", "mdd", "calmar"])
    # one row per strategy; the rank of a report over all of them
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("calmar"), ID)).cast("long"))
