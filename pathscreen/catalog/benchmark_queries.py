"""Named queries over the benchmark and resampling operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from pathscreen.catalog.registry import pick, query, r, rounded, stream_sql, uniform_sql
from pathscreen.catalog.views import benchmark_map, both_map, ctes, path_sql, v_beta, v_both, v_logs, v_px, v_ret, v_trd
from pathscreen.staging import stage
from pathscreen.operators import benchmark as B, metrics as M, resample as R, scan

ID = M.ID
US_DAY = "86400000000.0::DOUBLE"
DEDUP = "SELECT strategy_id, ts, product(1+ret)-1 ret FROM {src} GROUP BY 1,2"
BARS = """SELECT asset_key, ts, close, close/lag(close) OVER w-1 aret, lag(ts) OVER w prev_ts FROM v_px WINDOW w AS (PARTITION BY asset_key ORDER BY ts)"""
WIN = f"""SELECT * FROM (SELECT strategy_id, asset_key, lo, hi, (epoch_us(hi)-epoch_us(lo))::DOUBLE/{US_DAY} overlap_days,
   (epoch_us(hi)-epoch_us(lo))::DOUBLE/{US_DAY} < 0.95::DOUBLE*((epoch_us(s1)-epoch_us(s0))::DOUBLE/{US_DAY}) AS partial
   FROM (SELECT strategy_id, asset_key, greatest(s0,a0) lo, least(s1,a1) hi, s0, s1 FROM v_map
   JOIN (SELECT strategy_id, min(ts) s0, max(ts) s1 FROM sr GROUP BY 1) USING (strategy_id)
   JOIN (SELECT asset_key, min(ts) a0, max(ts) a1 FROM v_px GROUP BY 1) USING (asset_key)) WHERE hi>lo) WHERE overlap_days>=20"""
SIDE_S = "SELECT strategy_id, asset_key, ts, ret, lo, hi FROM sr JOIN win USING (strategy_id) WHERE ts BETWEEN lo AND hi"
SIDE_A = "SELECT strategy_id, ts, close, CASE WHEN prev_ts IS NULL OR prev_ts<lo THEN 0 ELSE aret END ret FROM bars JOIN win USING (asset_key) WHERE ts BETWEEN lo AND hi"
JOINED = "SELECT ss.strategy_id, ss.asset_key, ss.ts, ss.ret, b.aret FROM ss JOIN bars b ON b.asset_key=ss.asset_key AND b.ts=ss.ts WHERE b.prev_ts>=ss.lo"


def frame(src: str = "v_beta") -> str:
    views = ["v_px", "v_map", src]
    return ctes(*views, sr=DEDUP.format(src=src), bars=BARS, win=WIN, ss=SIDE_S, aa=SIDE_A, jr=JOINED).rstrip()


def fold_sql(src: str, keys: str = "strategy_id", order: str = "ts") -> str:
    return (f"SELECT {keys}, count(*) n, max_by(equity, idx) growth, least(0, min(dd)) mdd FROM ({path_sql(src, order, keys)}) GROUP BY {keys}")


@query("join_overlap_window", frame() + """ SELECT win.strategy_id, asset_key, lo, hi, round(overlap_days,4)+0.0::DOUBLE overlap_days, partial, s_rows, a_rows FROM win
   JOIN (SELECT strategy_id, count(*) s_rows FROM ss GROUP BY 1) USING (strategy_id) JOIN (SELECT strategy_id, count(*) a_rows FROM aa GROUP BY 1) USING (strategy_id)
   WHERE s_rows>=3 AND a_rows>=2""")
def join_overlap_window(spark, folder):
    out = B.overlap_rows(stage(B.one_return_per_time(v_beta(spark, folder))), stage(v_px(spark, folder)), benchmark_map(spark, folder))
    return pick(out, [ID, "asset_key", "lo", "hi"], ["overlap_days"], ["partial", "s_rows", "a_rows"], 4)


def _joined(spark, folder):
    px, s, m = stage(v_px(spark, folder)), stage(B.one_return_per_time(v_beta(spark, folder))), benchmark_map(spark, folder)
    return B.bar_returns(s, B.asset_bars(px), B.overlap_windows(s, px, m))


@query("join_bar_returns", frame() + f" SELECT strategy_id, asset_key, ts, {r('ret', 9)}, {r('aret', 9)} FROM jr")
def join_bar_returns(spark, folder):
    return pick(_joined(spark, folder), [ID, "asset_key", "ts"], ["ret", "aret"], digits=9)


@query("beta_corr", frame() + f" SELECT strategy_id, count(*) AS observations, {r('corr(ret,aret)', 6, 'corr')}, {r('covar_samp(ret,aret)/var_samp(aret)', 6, 'beta')} FROM jr GROUP BY 1 HAVING count(*)>=40")
def beta_corr(spark, folder):
    return pick(B.dependency_stats(_joined(spark, folder)), [ID, "observations"], ["corr", "beta"])


CMP = """SELECT *, strat_calmar-bnh_calmar cal_alpha, strat_total/nullif(bnh_total,0) ret_capture,
  CASE WHEN bnh_mdd<0 THEN (abs(bnh_mdd)-abs(strat_mdd))/abs(bnh_mdd) ELSE 0 END dd_reduction FROM (
  SELECT *, CASE WHEN strat_mdd<0 THEN strat_cagr/abs(strat_mdd) ELSE 0 END strat_calmar, CASE WHEN bnh_mdd<0 THEN bnh_cagr/abs(bnh_mdd) ELSE 0 END bnh_calmar FROM (
  SELECT win.*, overlap_days/365.25::DOUBLE AS years, s.growth-1 strat_total, a.growth-1 bnh_total, s.mdd strat_mdd, a.mdd bnh_mdd,
  pow(s.growth, 365.25::DOUBLE/overlap_days)-1 strat_cagr, pow(a.growth, 365.25::DOUBLE/overlap_days)-1 bnh_cagr
  FROM win JOIN sfold s USING (strategy_id) JOIN afold a USING (strategy_id) WHERE s.n>=3 AND a.n>=2))"""
_CMP_COLS = ["years", "strat_total", "strat_cagr", "strat_mdd", "strat_calmar", "bnh_total", "bnh_cagr", "bnh_mdd", "bnh_calmar",
             "cal_alpha", "ret_capture", "dd_reduction"]


def cmp_sql(src: str = "v_beta") -> str:
    return frame(src) + f", sfold AS ({fold_sql('ss')}), afold AS ({fold_sql('aa')}), cmp AS ({CMP})"


@query("benchmark_stats", cmp_sql() + " SELECT strategy_id, asset_key, partial, " + ", ".join(r(c) for c in _CMP_COLS) + " FROM cmp")
def benchmark_stats(spark, folder):
    out = B.compare(stage(v_beta(spark, folder)), stage(v_px(spark, folder)), benchmark_map(spark, folder))
    return pick(out, [ID, "asset_key", "partial"], _CMP_COLS)


@query("benchmark_curves", frame() + f""", sp AS ({path_sql('ss')}), ap AS ({path_sql('aa')})
   SELECT strategy_id, ts, 'strategy' side, {r('equity')} FROM sp UNION ALL SELECT strategy_id, ts, 'hold', {r('equity')} FROM ap""")
def benchmark_curves(spark, folder):
    return pick(B.curves(stage(v_beta(spark, folder)), stage(v_px(spark, folder)), benchmark_map(spark, folder)), [ID, "ts", "side"], ["equity"])


# --- resampling ---------------------------------------------------------------------------------
SIZES = """SELECT *, greatest(1, round_even(sqrt(n),0))::BIGINT b FROM (SELECT strategy_id, count(*) n, min(ts) t0, max(ts) t1 FROM v_ret GROUP BY 1) WHERE n>=10"""


def draws_sql(salt: int, sims: str) -> str:
    return f"""SELECT strategy_id, n, b, sim, j, blocks, floor({uniform_sql('sk', 'sim', 'j')}*(n-b+1))::BIGINT AS start,
      CASE WHEN j=blocks-1 THEN n-(blocks-1)*b ELSE b END AS len
      FROM (SELECT *, unnest(range(0, blocks)) j FROM (SELECT *, unnest(range(0, {sims})) sim FROM (SELECT *, ((n+b-1)//b)::BIGINT blocks, {stream_sql('strategy_id', R.SEED, salt)} sk FROM sz)))"""


PPY = "SELECT strategy_id, n, n/((epoch_us(t1)-epoch_us(t0))::DOUBLE/31557600000000.0::DOUBLE) ppy FROM sz"
LOGS = "SELECT strategy_id, idx, sum(ln(1+ret)) OVER (PARTITION BY strategy_id ORDER BY idx ROWS UNBOUNDED PRECEDING) cum FROM p UNION ALL SELECT strategy_id, 0, 0 FROM sz"
BOOT = ctes("v_ret", p=path_sql("v_ret"), sz=SIZES, py=PPY, lg=LOGS, dr=draws_sql(R.SALT_BOOT, "1000"),
            gr="SELECT d.strategy_id, d.sim, exp(sum(e.cum-s.cum)) growth FROM dr d JOIN lg s ON s.strategy_id=d.strategy_id AND s.idx=d.start JOIN lg e ON e.strategy_id=d.strategy_id AND e.idx=d.start+d.len GROUP BY 1,2",
            bp="SELECT strategy_id, quantile_cont(pow(growth, ppy/n)-1, 0.05) bootstrap_p5 FROM gr JOIN py USING (strategy_id) GROUP BY 1")


@query("join_bootstrap_index", BOOT + f"SELECT strategy_id, sim, {r('growth')} FROM gr")
def join_bootstrap_index(spark, folder):
    return pick(R.bootstrap_growth(M.path(v_ret(spark, folder))), [ID, "sim"], ["growth"])


@query("bootstrap_p5", BOOT + f"SELECT strategy_id, {r('bootstrap_p5')} FROM bp")
def bootstrap_p5(spark, folder):
    return pick(R.bootstrap_p5(stage(M.path(v_ret(spark, folder)))), [ID], ["bootstrap_p5"])


MC = ctes("v_ret", p=path_sql("v_ret"), sz=SIZES, py=PPY, dr=draws_sql(R.SALT_PATH, "2000"),
          st="SELECT d.strategy_id, d.sim, d.j*d.b+o+1 step, p.ret FROM (SELECT *, unnest(range(0, len)) o FROM dr) d JOIN p ON p.strategy_id=d.strategy_id AND p.idx=d.start+o+1",
          sp="""SELECT strategy_id, sim, step, equity, equity/greatest(1, max(equity) OVER (PARTITION BY strategy_id, sim ORDER BY step ROWS UNBOUNDED PRECEDING))-1 dd FROM (
             SELECT *, product(1+ret) OVER (PARTITION BY strategy_id, sim ORDER BY step ROWS UNBOUNDED PRECEDING) equity FROM st)""")
_MC_COLS = ["final_p5", "final_p50", "final_p95", "cagr_p5", "cagr_p50", "cagr_p95", "maxdd_p50", "maxdd_worst5", "prob_loss"]
MCQ = """SELECT strategy_id, count(*) n_sims, quantile_cont(g,0.05) final_p5, quantile_cont(g,0.5) final_p50, quantile_cont(g,0.95) final_p95,
   quantile_cont(c,0.05) cagr_p5, quantile_cont(c,0.5) cagr_p50, quantile_cont(c,0.95) cagr_p95, quantile_cont(mdd,0.5) maxdd_p50, quantile_cont(mdd,0.05) maxdd_worst5,
   avg((g<1)::INT::DOUBLE) prob_loss FROM (SELECT *, pow(g, ppy/n)-1 c FROM (SELECT strategy_id, sim, max_by(equity, step) g, least(0,min(dd)) mdd FROM sp GROUP BY 1,2) JOIN py USING (strategy_id)) GROUP BY 1"""


@query("monte_carlo", MC.rstrip() + f", m AS ({MCQ}) SELECT strategy_id, n_sims, " + ", ".join(r(c) for c in _MC_COLS) + " FROM m")
def monte_carlo(spark, folder):
    return pick(R.monte_carlo(M.path(v_ret(spark, folder))), [ID, "n_sims"], _MC_COLS)


@query("mc_bands", MC.rstrip() + f""", m AS (SELECT strategy_id, step, q[1] lo, q[2] AS mid, q[3] hi FROM (SELECT strategy_id, step, quantile_cont(equity, [0.05, 0.5, 0.95]) q FROM sp GROUP BY 1,2)
   UNION ALL SELECT strategy_id, 0, 1, 1, 1 FROM sz) SELECT strategy_id, step, {r('lo')}, {r('mid')}, {r('hi')} FROM m""")
def mc_bands(spark, folder):
    return pick(R.mc_bands(M.path(v_ret(spark, folder))), [ID, "step"], ["lo", "mid", "hi"])


JX = """SELECT strategy_id, n bars, CASE WHEN sp>0 THEN n/sp ELSE 252 END ppy, least(greatest(abs(cv/vr),0.15::DOUBLE),1) exposure FROM (
  SELECT strategy_id, count(*) n, (epoch_us(max(ts))-epoch_us(min(ts)))::DOUBLE/31557600000000.0::DOUBLE sp, covar_samp(ret,aret) cv, var_samp(aret) vr FROM jr GROUP BY 1) WHERE n>=120 AND vr>0"""
POS = f"""SELECT *, abs(pos-prev_pos) turnover, prev_pos*aret-abs(pos-prev_pos)*0.0002::DOUBLE ret FROM (
  SELECT strategy_id, sim, idx, ts, aret, ({uniform_sql('sk', 'sim', 'idx')}<exposure)::INT::DOUBLE pos, CASE WHEN idx>1 THEN ({uniform_sql('sk', 'sim', '(idx-1)')}<exposure)::INT::DOUBLE ELSE 0 END prev_pos
  FROM (SELECT *, unnest(range(0,128)) sim FROM (SELECT jr.strategy_id, ts, aret, exposure, row_number() OVER (PARTITION BY jr.strategy_id ORDER BY ts) idx, {stream_sql('jr.strategy_id', R.SEED, R.SALT_BARS)} sk
  FROM jr JOIN jx USING (strategy_id))))"""


@query("exposure_turnover", frame() + f", jx AS ({JX}), po AS ({POS}) SELECT strategy_id, sim, {r('avg(pos)', 6, 'mean_pos')}, {r('sum(turnover)', 4, 'turnover')}, {r('sum(ret)', 6, 'sum_ret')} FROM po GROUP BY 1,2")
def exposure_turnover(spark, folder):
    pos = R.positions(_joined(spark, folder))
    return pos.groupBy(ID, "sim").agg(rounded(F.avg("pos")).alias("mean_pos"), rounded(F.sum("turnover"), 4).alias("turnover"),
                                      rounded(F.sum("sim_ret")).alias("sum_ret"))


_RC_COLS = ["exposure", "strat_calmar", "random_calmar_p50", "random_calmar_p75", "random_calmar_p95", "random_p"]
CAL = "CASE WHEN {a}mdd>=0 THEN 0 ELSE (CASE WHEN {a}growth<=0 THEN -1 ELSE pow({a}growth, ppy/{a}n)-1 END)/abs({a}mdd) END"
RCB = frame() + f""", jx AS ({JX}), po AS ({POS}), rf AS ({fold_sql('po', 'strategy_id, sim')}), own AS ({fold_sql('jr')}),
  rc AS (SELECT rf.strategy_id, {CAL.format(a='rf.')} calmar, oc strat_calmar, exposure FROM rf JOIN jx USING (strategy_id) JOIN (SELECT own.strategy_id, {CAL.format(a='own.')} oc FROM own JOIN jx USING (strategy_id)) USING (strategy_id)),
  rs AS (SELECT strategy_id, max(exposure) exposure, max(strat_calmar) strat_calmar, quantile_cont(calmar,0.5) random_calmar_p50, quantile_cont(calmar,0.75) random_calmar_p75,
    quantile_cont(calmar,0.95) random_calmar_p95, avg((calmar>=strat_calmar)::INT::DOUBLE) random_p, count(*) random_sims FROM rc GROUP BY 1)"""


@query("random_control_bars", RCB + " SELECT strategy_id, random_sims, " + ", ".join(r(c) for c in _RC_COLS) + " FROM rs")
def random_control_bars(spark, folder):
    return pick(R.random_control_bars(_joined(spark, folder)), [ID, "random_sims"], _RC_COLS)


# --- as-of ----------------------------------------------------------------------------------------
@query("asof_exit_bar", ctes("v_trd", "v_px") + f"""SELECT t.strategy_id, t.trade_no, t.target, b.ts AS bar_ts, {r('b.close', 6, 'close')} FROM
   (SELECT *, entry_ts + INTERVAL 45 DAY target, symbol asset_key FROM v_trd) t ASOF LEFT JOIN v_px b ON t.asset_key=b.asset_key AND t.target<=b.ts""")
def asof_exit_bar(spark, folder):
    t = v_trd(spark, folder).select(ID, "trade_no", (F.col("entry_ts") + F.expr("INTERVAL 45 DAYS")).alias("target"), F.col("symbol").alias("asset_key"))
    out = scan.first_at_or_after(t, v_px(spark, folder), "asset_key", "target", "ts", ["close"])
    return out.select(ID, "trade_no", "target", F.col("bar.ts").alias("bar_ts"), rounded(F.col("bar.close")).alias("close"))


# closed trades of the view against the asset of the same number
TMETA = """SELECT strategy_id, count(*) n, count(*)/((epoch_us(max(ts))-epoch_us(min(ts)))::DOUBLE/31557600000000.0::DOUBLE) ppy FROM v_tr GROUP BY 1"""


def event_frame() -> str:
    tr = "SELECT strategy_id, trade_no, exit_ts ts, ret FROM v_trd"
    base = ctes("v_px", "v_map", "v_trd", v_tr=tr, sr=DEDUP.format(src="v_tr"), bars=BARS, win=WIN, ss=SIDE_S, aa=SIDE_A).rstrip()
    return base + event_ctes("v_trd", "v_tr")


def event_ctes(trd: str, rows: str) -> str:
    """From both sides of the windows (ss, aa) to the control es; ``trd``: the trades, ``rows``: the returns whose number per year counts."""
    sql = f""", tm AS ({TMETA}), eb AS (SELECT * FROM (SELECT strategy_id, ts, close, row_number() OVER (PARTITION BY strategy_id ORDER BY ts) bar, count(*) OVER (PARTITION BY strategy_id) bars FROM aa) WHERE bars>=30),
      el AS (SELECT strategy_id, max(ts) last_ts, max(bars) bars, max_by(close, bar) last_close FROM eb GROUP BY 1),
      tv AS (SELECT v.strategy_id, trade_no, exit_ts, exit_ts-entry_ts hold, events, el.last_ts, el.bars, el.last_close FROM v_trd v JOIN (SELECT strategy_id, count(*) events FROM v_trd WHERE entry_ts<=exit_ts GROUP BY 1) e USING (strategy_id) JOIN el USING (strategy_id) WHERE entry_ts<=exit_ts AND events>=8),
      tr2 AS (SELECT tv.*, least(greatest((SELECT count(*) FROM eb WHERE eb.strategy_id=tv.strategy_id AND eb.ts<=tv.last_ts-tv.hold),1),tv.bars-1) room, {stream_sql('tv.strategy_id', R.SEED, R.SALT_EVENTS)} sk FROM tv),
      td AS (SELECT *, floor({uniform_sql('sk', 'sim', 'trade_no')}*room)::BIGINT+1 bar0 FROM (SELECT *, unnest(range(0,128)) sim FROM tr2)),
      te AS (SELECT td.*, s.ts t0, s.close c0, greatest(s.ts+td.hold, s.ts+INTERVAL 1 MICROSECOND) target FROM td JOIN eb s ON s.strategy_id=td.strategy_id AND s.bar=td.bar0),
      tf AS (SELECT te.strategy_id, te.sim, te.trade_no, te.exit_ts ts, te.events, coalesce(b.close, te.last_close)/te.c0-1 ret FROM te ASOF LEFT JOIN eb b ON te.strategy_id=b.strategy_id AND te.target<=b.ts),
      ef AS ({fold_sql('tf', 'strategy_id, sim', 'ts, trade_no')}), eo AS ({fold_sql('ss')}),
      ec AS (SELECT ef.strategy_id, {CAL.format(a='ef.')} calmar, oc strat_calmar FROM ef JOIN tm USING (strategy_id) JOIN (SELECT eo.strategy_id, {CAL.format(a='eo.')} oc FROM eo JOIN tm USING (strategy_id) WHERE eo.n>=3) USING (strategy_id)),
      es AS (SELECT strategy_id, 1.0::DOUBLE exposure, max(strat_calmar) strat_calmar, quantile_cont(calmar,0.5) random_calmar_p50, quantile_cont(calmar,0.75) random_calmar_p75,
        quantile_cont(calmar,0.95) random_calmar_p95, avg((calmar>=strat_calmar)::INT::DOUBLE) random_p, count(*) random_sims FROM ec GROUP BY 1)"""
    return sql.replace("v_trd", trd).replace("FROM v_tr GROUP", f"FROM {rows} GROUP")


@query("random_control_events", event_frame().replace("tm.n", "tm.n") + " SELECT es.strategy_id, random_sims, events AS random_events, " + ", ".join(r(c) for c in _RC_COLS) +
       " FROM es JOIN (SELECT strategy_id, max(events) events FROM tf GROUP BY 1) USING (strategy_id)")
def random_control_events(spark, folder):
    t, px, m = stage(v_trd(spark, folder)), stage(v_px(spark, folder)), benchmark_map(spark, folder)
    rows = t.select(ID, F.col("exit_ts").alias("ts"), "ret")
    s = B.one_return_per_time(rows)
    w = B.overlap_windows(s, px, m)
    ppy = rows.groupBy(ID).agg(F.count(F.lit(1)).alias("_n"), F.min("ts").alias("_s"), F.max("ts").alias("_e")).select(
        ID, M.ppy_expr(F.col("_n"), "_s", "_e").alias("ppy"))
    out = R.random_control_events(t, B.strategy_side(s, w), B.asset_side(B.asset_bars(px), w), ppy)
    return pick(out, [ID, "random_sims", "random_events"], _RC_COLS)


# --- both kinds in one batch -----------------------------------------------------------------------
def mixed_frame() -> str:
    """Trade logs by the event control, the rest by the bar control, as rs."""
    base = ctes("v_px", "both_map", "v_both", sr=DEDUP.format(src="v_both"), bars=BARS, win=WIN.replace("v_map", "both_map"), ss=SIDE_S, aa=SIDE_A, jr=JOINED).rstrip()
    own = "SELECT strategy_id, {} method, " + ", ".join(_RC_COLS) + ", random_sims, {} random_events FROM {}"
    bars = RCB[len(frame()):].replace("rs AS (", "rb AS (")
    both = own.format("'event_window'", "events", "es JOIN (SELECT strategy_id, max(events) events FROM tf GROUP BY 1) USING (strategy_id)") + " UNION ALL " + own.format("'bar_long_flat'", "0::BIGINT", "rb WHERE strategy_id NOT IN (SELECT strategy_id FROM es)")
    return base + event_ctes("v_logs", "sr") + bars + f", rs AS ({both})"


def mixed_control(ret, px, mp, logs, bars, joined):
    w = stage(B.overlap_windows(ret, px, mp))
    ppy = ret.groupBy(ID).agg(F.count(F.lit(1)).alias("_n"), F.min("ts").alias("_s"), F.max("ts").alias("_e")).select(ID, M.ppy_expr(F.col("_n"), "_s", "_e").alias("ppy"))
    return R.random_control(logs.select(ID), logs, B.strategy_side(ret, w), B.asset_side(bars, w), joined, ppy)


@query("random_control", mixed_frame() + " SELECT strategy_id, method, random_sims, random_events, " + ", ".join(r(c) for c in _RC_COLS) + " FROM rs")
def random_control(spark, folder):
    ret, px, mp, logs = stage(v_both(spark, folder)), stage(v_px(spark, folder)), both_map(spark, folder), stage(v_logs(spark, folder))
    bars = stage(B.asset_bars(px))
    joined = stage(B.bar_returns(ret, bars, B.overlap_windows(ret, px, mp)))
    return pick(mixed_control(ret, px, mp, logs, bars, joined).fillna(0, ["random_events"]), [ID, "method", "random_sims", "random_events"], _RC_COLS)
