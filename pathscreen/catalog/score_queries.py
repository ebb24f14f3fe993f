"""Named queries over scoring, triage, advice and batch summaries."""
from __future__ import annotations

import re

from pyspark.sql import functions as F

from pathscreen.catalog import benchmark_queries as BQ, metric_queries as MQ
from pathscreen.catalog.registry import cdf_sql, pick, query, r, rounded
from pathscreen.catalog.views import LOGS, base_sql, benchmark_map, both_map, path_sql, psr_sql, v_beta, v_both, v_logs, v_px
from pathscreen.operators import benchmark as B, metrics as M, resample as R, scan, scoring as S, triage as T
from pathscreen.operators.metrics import ID
from pathscreen.plans import dims
from pathscreen.staging import stage


# --- Spark side ----------------------------------------------------------------------------
def meta(returns):
    """Facts that come with an upload; here derived from the strategy number."""
    ids = returns.select(ID).distinct()
    m = F.col(ID) % 5
    profile = F.when(m == 0, "crypto").when(m == 1, "stock_index").when(m == 2, "altcoin").when(m == 3, "other").otherwise("unlisted")
    return ids.select(ID, F.lit(None).cast("string").alias("caliber"), profile.alias("profile"), (F.lit(1) + F.col(ID) % 3 * 20).alias("n_trials"),
                      (F.col(ID) % 11 == 7).alias("forward_looking"), F.lit(False).alias("unit_suspect"),
                      F.concat(F.lit("desk"), (F.col(ID) % 4).cast("string")).alias("source"))


def scored(spark, folder):
    """Score rows of the correlated strategies with benchmark and bar control, and what they came from."""
    ret, px, mp = stage(B.one_return_per_time(v_beta(spark, folder))), stage(v_px(spark, folder)), benchmark_map(spark, folder)
    p = stage(M.path(ret))
    bars = stage(B.asset_bars(px))
    joined = stage(B.bar_returns(ret, bars, B.overlap_windows(ret, px, mp)))
    control = R.random_control_bars(joined)
    bench = B.compare(ret, px, mp, bars=bars)
    score = S.score_unified(S.feature_table(p), meta(ret), dims.profiles(spark), bench, control)
    return score, joined, p


def scored_both(spark, folder):
    """Score rows of a batch of bar returns and of trade logs, each with the control of its kind."""
    ret, px, mp, logs = stage(v_both(spark, folder)), stage(v_px(spark, folder)), both_map(spark, folder), stage(v_logs(spark, folder))
    p = stage(M.path(ret))
    bars = stage(B.asset_bars(px))
    joined = stage(B.bar_returns(ret, bars, B.overlap_windows(ret, px, mp)))
    control = BQ.mixed_control(ret, px, mp, logs, bars, joined)
    facts = meta(ret).withColumn("caliber", F.when(F.col(ID) >= LOGS, "closed_trade"))
    return S.score_unified(S.feature_table(p), facts, dims.profiles(spark), B.compare(ret, px, mp, bars=bars), control)


_SCORED: dict = {}


def score_tables(spark, folder):
    """The staged score table of a folder, written once per application: reports read it many times.

    ``pillar_scores``, ``score_unified`` and ``score_batch`` compute it afresh.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _SCORED:
        _SCORED[key] = scored(spark, folder)
    return _SCORED[key]


def score_rows(spark, folder):
    return score_tables(spark, folder)[0]


# --- SQL side ---------------------------------------------------------------------------------
def on(sql: str, src: str) -> str:
    return re.sub(r"\bv_ret\b", src, sql)


def lerp_sql(x: str) -> str:
    return (f"CASE WHEN {x}<=0 THEN 40 WHEN {x}<=35 THEN 40+20*{x}/35 WHEN {x}<=55 THEN 60+20*({x}-35)/20 WHEN {x}<=70 THEN 80+10*({x}-55)/15 "
            f"WHEN {x}<=99 THEN 90+10*({x}-70)/29 ELSE 100 END")


def disp_sql(x: str) -> str:
    return f"round_even(least(greatest({lerp_sql(x)},0),99.9::DOUBLE),1)"


def sat_sql(x: str, k: str) -> str:
    return f"(CASE WHEN {x} IS NULL OR isnan({x}) THEN 0 WHEN isinf({x}) AND {x}>0 THEN 1 ELSE greatest({x},0)/(greatest({x},0)+{k}) END)"


def lin_sql(x: str, lo: str, hi: str) -> str:
    return f"least(greatest(({x}-({lo}))/(({hi})-({lo})),0),1)"


def names_sql(*pairs) -> str:
    """Codes of the true conditions joined by '|', in order."""
    return "coalesce(array_to_string([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in pairs) + "], '|'), '')"


def score_sql(control: str = BQ.RCB, log: str = "false") -> str:
    """``control``: the clauses up to the control rs; ``log``: whether a strategy's record is a trade log."""
    prof = ", ".join(str(p).replace('"', "'") for p in dims.PROFILES)
    parts = control + f", sfold AS ({BQ.fold_sql('ss')}), afold AS ({BQ.fold_sql('aa')}), cmp AS ({BQ.CMP})"
    parts += f", p AS ({path_sql('sr')}), b AS ({base_sql('sr')}), q AS ({psr_sql('b')})"
    parts += ", md AS (SELECT strategy_id, least(0,min(dd)) mdd FROM p GROUP BY 1)"
    parts += f", tl AS ({on(MQ._TAIL, 'sr')}), dk AS ({on(MQ._DROP, 'sr')}), m AS ({on(MQ._MON, 'sr')}), rc0 AS ({MQ._REC}), bk AS ({MQ._BLK}), ac AS ({MQ._AC}), ho AS ({MQ._HO})"
    parts += """, mm AS (SELECT strategy_id, CASE WHEN date_diff('month', min(month), max(month))+1 > count(*) THEN greatest(max(g-1),0) ELSE max(g-1) END max_month FROM m GROUP BY 1)"""
    parts += ", seg1 AS (SELECT * FROM (" + _segment_table("idx<=floor(0.7::DOUBLE*n)", "train", "oos") + "))"
    parts += ", seg2 AS (SELECT * FROM (" + _segment_table(f"idx<={MQ._RC}", "prior", "recent") + "))"
    parts += """, og AS (SELECT strategy_id, max(cagr) FILTER (WHERE segment='oos') oos_cagr FROM seg1 GROUP BY 1 HAVING sum(n)>=264 AND max(n) FILTER (WHERE segment='oos')>=80),
      rp AS (SELECT strategy_id, max(sharpe) FILTER (WHERE segment='recent') sharpe_re, max(sharpe) FILTER (WHERE segment='prior') sharpe_pr, max(cagr) FILTER (WHERE segment='recent') cagr_re,
        max(n) FILTER (WHERE segment='recent') n_re, max(n) FILTER (WHERE segment='prior') n_pr FROM seg2 GROUP BY 1)"""
    parts += f", sz AS ({on(BQ.SIZES, 'sr')}), py AS ({BQ.PPY}), lg AS ({BQ.LOGS}), dr AS ({BQ.draws_sql(R.SALT_BOOT, '1000')}), gr AS (SELECT d.strategy_id, d.sim, exp(sum(e.cum-s.cum)) growth FROM dr d JOIN lg s ON s.strategy_id=d.strategy_id AND s.idx=d.start JOIN lg e ON e.strategy_id=d.strategy_id AND e.idx=d.start+d.len GROUP BY 1,2), bp AS (SELECT strategy_id, quantile_cont(pow(growth, ppy/n)-1, 0.05) bootstrap_p5 FROM gr JOIN py USING (strategy_id) GROUP BY 1)"
    parts += f", pf(profile,sharpe50,sortino50,mdd50,rec50,cvar50,n_min,tol,absurd) AS (VALUES {prof})"
    parts += f"""
    , f0 AS (SELECT q.*, md.mdd, tl.cvar, {MQ._KEEP} keep, mm.max_month, CASE WHEN tot<=0 THEN 0 ELSE len(list_filter(gs, lambda x: x/tot>0.05::DOUBLE))/n_blocks END recurrence,
       CASE WHEN tot<=0 THEN 1 ELSE top/tot END tbs, bk.bpf, ac.ac, ho.sr_ho, ho.z, og.oos_cagr, bp.bootstrap_p5, rp.sharpe_re, rp.sharpe_pr, rp.cagr_re, rp.n_re, rp.n_pr,
       cmp.cal_alpha, cmp.dd_reduction, cmp.partial AS bpart, rs.random_p, 1+(q.strategy_id%3)*20 nt, q.strategy_id%11=7 fwd,
       CASE WHEN md.mdd>=0 THEN 0 ELSE q.cagr/abs(md.mdd) END calmar, pf.*
       FROM q JOIN md USING (strategy_id) JOIN tl USING (strategy_id) JOIN dk USING (strategy_id) JOIN mm USING (strategy_id) JOIN rc0 USING (strategy_id) JOIN bk USING (strategy_id)
       JOIN ac USING (strategy_id) JOIN ho USING (strategy_id) LEFT JOIN og USING (strategy_id) LEFT JOIN bp USING (strategy_id) JOIN rp USING (strategy_id) LEFT JOIN cmp USING (strategy_id) LEFT JOIN rs USING (strategy_id)
       JOIN pf ON pf.profile = ['crypto','stock_index','altcoin','other','other'][1+q.strategy_id%5])
    , f1 AS (SELECT *, least(greatest((tbs-tol)/(1-tol),0),1) pen FROM f0)
    , f2 AS (SELECT *, 65*least(1.5*recurrence,1)*(1-0.5::DOUBLE*pen)+35*(CASE WHEN pen>0 THEN keep ELSE 1 END) rob,
       CASE WHEN n>=150 THEN 50*bpf+50*(CASE WHEN z>1.64::DOUBLE AND sr_ho<0 THEN greatest(0,1-(z-1.64::DOUBLE)/3) WHEN z>1.64::DOUBLE THEN greatest(0.5::DOUBLE,1-(z-1.64::DOUBLE)/6) ELSE 1 END) END cons,
       n>=150 AND z>1.64::DOUBLE AND sr_ho<0 overfit,
       (ac>0.30::DOUBLE AND NOT ({log}))::INT+(sharpe>absurd)::INT+(win_rate>0.9::DOUBLE AND abs(mdd)<0.03::DOUBLE)::INT tg,
       z0-{MQ.best_z_sql('nt')} dz, round_even(eff_n,1) en, 60*(0.5::DOUBLE+0.5::DOUBLE*tanh(cal_alpha/2))+40*(0.5::DOUBLE+0.5::DOUBLE*least(greatest(dd_reduction,-1),1)) edge_score FROM f1)
    , f3 AS (SELECT *, {cdf_sql('dz')} dsr, CASE WHEN tg=0 THEN 99 ELSE greatest(5,100-35*tg) END plaus,
       65*{sat_sql('sharpe', 'sharpe50')}+35*{sat_sql('sortino', 'sortino50')} rq0,
       50*(1-{sat_sql('abs(mdd)', 'mdd50')})+30*{sat_sql('(CASE WHEN mdd<0 THEN (growth-1)/abs(mdd) ELSE 0 END)', 'rec50')}+20*(1-{sat_sql('abs(cvar)', 'cvar50')}) rk0,
       40*coalesce(psr,0.5::DOUBLE)+25*(CASE WHEN bootstrap_p5 IS NULL THEN 0.5::DOUBLE WHEN bootstrap_p5>0 THEN 1 ELSE {lin_sql('bootstrap_p5', '-0.2::DOUBLE', '0')} END)+20*{lin_sql('eff_n', '3', '20')}+15*{lin_sql('n::DOUBLE', 'n_min', 'n_min*4')} stat FROM f2)
    , f4 AS (SELECT *, (0.45::DOUBLE*rob+0.2::DOUBLE*plaus+0.35::DOUBLE*coalesce(cons,0))/(CASE WHEN cons IS NULL THEN 0.65::DOUBLE ELSE 1 END) cr0 FROM f3)
    , f5 AS (SELECT *, least(CASE WHEN tg>0 THEN least(rq0,50) ELSE rq0 END,99) rq1, least(CASE WHEN tg>0 THEN least(cr0,28) ELSE cr0 END,99) cr1, least(rk0,99) rk1 FROM f4)
    , f6 AS (SELECT *, {disp_sql('rq1')} return_quality, {disp_sql('cr1')} credibility, {disp_sql('rk1')} risk FROM f5)
    , f7 AS (SELECT *, round_even(least(greatest(0.35::DOUBLE*return_quality+0.4::DOUBLE*credibility+0.25::DOUBLE*risk-(CASE WHEN nt>1 THEN least(18,3*log10(nt)) ELSE 0 END),0),99),1) uncapped,
       (n<n_min AND NOT ({log})) OR span_years<1 OR en<5 sh,
       CASE WHEN edge_score IS NULL THEN CASE WHEN psr<0.9::DOUBLE OR bootstrap_p5<0 THEN 'luck_unclear' ELSE 'not_evaluated' END WHEN edge_score<40 THEN 'lost' WHEN random_p>0.2::DOUBLE THEN 'random_fail'
         WHEN random_p IS NULL THEN 'hold_only' WHEN edge_score<50 OR random_p>0.05::DOUBLE THEN 'marginal' ELSE 'beat' END light FROM f6)
    , f8 AS (SELECT *, {names_sql(('fwd', 'FORWARD_LOOKING_INPUT'), ('cagr<=0', 'NEGATIVE_RETURN'), ('sh', 'INSUFFICIENT_SAMPLE'), ('oos_cagr<=0', 'OOS_NEGATIVE_RETURN'), ("light='lost'", 'UNDERPERFORMS_HOLD_RISKADJ'), ("light='random_fail'", 'RANDOM_CONTROL_NOT_BEATEN'), ('nt>1 AND dsr<0.5', 'DSR_FAIL'))} hard,
       {names_sql(("light='marginal'", 'RANDOM_CONTROL_WEAK_EDGE'), ("light='hold_only'", 'RANDOM_CONTROL_UNAVAILABLE'), ("light='luck_unclear'", 'EDGE_HARD_TO_DISTINGUISH_FROM_LUCK'), ("light='not_evaluated'", 'EDGE_NOT_EVALUATED'), ('nt>1 AND dsr>=0.5 AND dsr<0.95', 'DSR_OVERFIT_RISK'))} soft,
       {names_sql(('cagr>0 AND NOT sh AND span_years<2', 'SHORT_TRACK_RECORD'), ('cagr>0 AND NOT sh AND span_years>=2 AND en<10', 'LOW_EFFECTIVE_SAMPLE'))} expe,
       {names_sql(('nt>1', 'MULTIPLE_TESTING_PENALTY'), (f'ac>0.30::DOUBLE AND NOT ({log})', 'STALE_OR_INTERPOLATED'), ('sharpe>absurd', 'SHARPE_TOO_GOOD'), ('win_rate>0.9::DOUBLE AND abs(mdd)<0.03::DOUBLE', 'NEAR_MONOTONIC'), ('tg>0', 'TOO_GOOD_TO_BE_TRUE'), ('fwd', 'FORWARD_LOOKING_INPUT'),
         ('(span_years>=1.5 AND cagr>1) OR calmar>10 OR growth>50 OR max_month>1', 'BACKGROUND_REQUIRED'), ('span_years>=1.5 AND cagr>1', 'BACKGROUND_CAGR'), ('calmar>10', 'BACKGROUND_CALMAR'), ('growth>50', 'BACKGROUND_GROWTH'), ('max_month>1', 'BACKGROUND_EXTREME_MONTH'),
         ('cagr<=0', 'NEGATIVE_RETURN'), ('sh', 'INSUFFICIENT_SAMPLE'), (f'({log}) AND NOT sh AND (n<100 OR (CASE WHEN span_years>0 THEN n/span_years ELSE n END)<50)', 'LOW_FREQUENCY'), ('oos_cagr<=0', 'OOS_NEGATIVE_RETURN'), ("light='lost'", 'UNDERPERFORMS_HOLD_RISKADJ'), ("light='random_fail'", 'RANDOM_CONTROL_NOT_BEATEN'), ("light='marginal'", 'RANDOM_CONTROL_WEAK_EDGE'),
         ("light='hold_only'", 'RANDOM_CONTROL_UNAVAILABLE'), ("light='luck_unclear'", 'EDGE_HARD_TO_DISTINGUISH_FROM_LUCK'), ('overfit', 'OVERFIT_SUSPECT_HOLDOUT'), ('nt>1 AND dsr<0.5', 'DSR_FAIL'), ('nt>1 AND dsr>=0.5 AND dsr<0.95', 'DSR_OVERFIT_RISK'),
         ('cagr>0 AND NOT sh AND span_years<2', 'SHORT_TRACK_RECORD'), ('cagr>0 AND NOT sh AND span_years>=2 AND en<10', 'LOW_EFFECTIVE_SAMPLE'))} flags FROM f7)
    , f9 AS (SELECT *, round_even(least(uncapped, CASE WHEN tg>0 OR hard<>'' THEN 59 ELSE least(CASE WHEN soft<>'' THEN 87 ELSE 99 END, CASE WHEN expe<>'' THEN 79 ELSE 99 END) END),1) display,
       CASE WHEN tg>0 THEN 'FLAGGED' WHEN hard<>'' THEN 'CAUTION' ELSE 'OK' END judgement FROM f8)
    , fa AS (SELECT *, judgement='OK' AND edge_score IS NOT NULL AND NOT coalesce(bpart,false) AND random_p IS NOT NULL AND light='beat' AND NOT sh AND expe='' elig FROM f9)
    , sc AS (SELECT *, CASE WHEN tg>0 OR hard<>'' THEN 'insufficient' WHEN elig THEN 'qualified' ELSE 'provisional' END evidence_status,
       CASE WHEN elig THEN CASE WHEN display>=88 THEN 'GOLD' WHEN display>=80 THEN 'SILVER' WHEN display>=60 THEN 'BRONZE' END END tier FROM fa)
    , sx AS (SELECT *, CASE WHEN judgement='FLAGGED' THEN 'FLAGGED' WHEN judgement='CAUTION' THEN 'NEEDS WORK' WHEN evidence_status='provisional' THEN 'PROVISIONAL' ELSE coalesce(tier,'NEEDS WORK') END grade,
       CASE WHEN tg>0 THEN 'TOO_GOOD' WHEN cagr<=0 THEN 'NOT_PROFITABLE' WHEN light='lost' THEN 'LOST_TO_HOLD' WHEN light='random_fail' THEN 'RANDOM_TIMING' WHEN nt>1 AND dsr<0.5 THEN 'SEARCH_LUCK' WHEN sh THEN 'SAMPLE_SMALL'
         WHEN oos_cagr<=0 THEN 'LATE_LOSS' WHEN light='beat' AND expe<>'' THEN 'BEAT_BUT_YOUNG' WHEN light='beat' THEN 'BEAT' WHEN light='hold_only' THEN 'HOLD_ONLY' WHEN light='marginal' THEN 'MARGINAL' WHEN light='luck_unclear' THEN 'LUCK_UNCLEAR' ELSE 'ADD_ASSET' END headline FROM sc) """
    return parts


def _segment_table(cond: str, a: str, b: str) -> str:
    """Segment metrics as one sub-select (own WITH clause) over p."""
    return "WITH " + MQ.segment_sql(cond, a, b).lstrip(", ") + " SELECT * FROM s"


SCORE = score_sql()
PILLARS = ["robustness", "consistency", "plausibility", "statistical_confidence", "edge_score"]


@query("pillar_scores", SCORE + f"SELECT strategy_id, return_quality, credibility, risk, {r('rob', 5, 'robustness')}, {r('cons', 5, 'consistency')}, plaus::DOUBLE AS plausibility, {r('stat', 5, 'statistical_confidence')}, {r('edge_score', 5)} FROM sx")
def pillar_scores(spark, folder):
    s, _, _ = scored(spark, folder)
    return s.select(ID, "return_quality", "credibility", "risk", *[rounded(c, 5).alias(c) for c in PILLARS])


@query("plausibility_flags", SCORE + f"""SELECT strategy_id, {names_sql(('ac>0.30::DOUBLE', 'STALE_OR_INTERPOLATED'), ('sharpe>absurd', 'SHARPE_TOO_GOOD'), ('win_rate>0.9::DOUBLE AND abs(mdd)<0.03::DOUBLE', 'NEAR_MONOTONIC'))} too_good,
  {names_sql(('span_years>=1.5 AND cagr>1', 'BACKGROUND_CAGR'), ('calmar>10', 'BACKGROUND_CALMAR'), ('growth>50', 'BACKGROUND_GROWTH'), ('max_month>1', 'BACKGROUND_EXTREME_MONTH'))} background, plaus::DOUBLE AS plausibility FROM sx""")
def plausibility_flags(spark, folder):
    s, _, _ = score_tables(spark, folder)
    return s.select(ID, F.array_join("too_good_codes", "|").alias("too_good"), F.array_join("background_codes", "|").alias("background"), "plausibility")


@query("score_unified", SCORE + """SELECT strategy_id, uncapped, display, judgement, grade, tier, light AS edge_light, sh AS sample_hard, evidence_status, headline, flags,
   array_to_string(list_filter([hard, soft, expe], lambda x: x<>''), '|') cap_reasons, round(dsr,6)+0.0::DOUBLE dsr, round(random_p,6)+0.0::DOUBLE random_p FROM sx""")
def score_unified(spark, folder):
    s, _, _ = scored(spark, folder)
    return s.select(ID, "uncapped", "display", "judgement", "grade", "tier", "edge_light", "sample_hard", "evidence_status", "headline",
                    F.array_join("flags.code", "|").alias("flags"), F.array_join("cap_reasons", "|").alias("cap_reasons"),
                    rounded("dsr").alias("dsr"), rounded("random_p").alias("random_p"))


@query("score_both_kinds", score_sql(BQ.mixed_frame(), f"strategy_id>={LOGS}") + """SELECT sx.strategy_id, rs.method AS random_method, coalesce(rs.random_events, 0) AS random_events, uncapped, display, judgement, grade, tier, light AS edge_light, sh AS sample_hard, evidence_status, headline, flags,
   array_to_string(list_filter([hard, soft, expe], lambda x: x<>''), '|') cap_reasons, round(sx.random_p,6)+0.0::DOUBLE random_p FROM sx LEFT JOIN rs ON rs.strategy_id=sx.strategy_id""")
def score_both_kinds(spark, folder):
    return scored_both(spark, folder).fillna(0, ["random_events"]).select(ID, "random_method", "random_events", "uncapped", "display", "judgement", "grade", "tier", "edge_light", "sample_hard", "evidence_status", "headline",
                                             F.array_join("flags.code", "|").alias("flags"), F.array_join("cap_reasons", "|").alias("cap_reasons"), rounded("random_p").alias("random_p"))


TRI = SCORE + f""", dp AS (SELECT strategy_id, corr(ret,aret) corr, covar_samp(ret,aret)/var_samp(aret) beta FROM jr GROUP BY 1 HAVING count(*)>=40 AND var_samp(aret)>0),
   t0 AS (SELECT sx.*, dp.corr, dp.beta, CASE WHEN abs(dp.corr)<0.25 THEN 'low' WHEN abs(dp.corr)<0.55 THEN 'medium' WHEN dp.corr IS NULL THEN NULL ELSE 'high' END dependency,
     (CASE WHEN n>=500 THEN 2 WHEN n>=120 THEN 1 ELSE 0 END)+(CASE WHEN span_years>=2 THEN 2 WHEN span_years>=1 THEN 1 ELSE 0 END)+(edge_score IS NOT NULL)::INT+1 pts FROM sx LEFT JOIN dp USING (strategy_id)),
   tr AS (SELECT *, CASE WHEN n<120 OR n_pr<60 OR n_re<40 THEN 'unavailable' WHEN cagr_re<=0 OR sharpe_re-sharpe_pr<=-1 THEN 'deteriorating' WHEN sharpe_re-sharpe_pr<=-0.35::DOUBLE THEN 'weakening' ELSE 'stable' END persistence,
     CASE WHEN pts>=5 THEN 'high' WHEN pts>=3 THEN 'medium' WHEN pts>=2 THEN 'limited' ELSE 'low' END evidence_level,
     CASE WHEN evidence_status<>'qualified' THEN 'collect_evidence' WHEN abs(mdd)>=0.25::DOUBLE OR risk<80 THEN 'overlay' ELSE 'pro' END next_step FROM t0) """


def _triaged(spark, folder):
    s, joined, p = score_tables(spark, folder)
    return T.triage(s, T.dependency(B.dependency_stats(joined))), p


@query("triage", TRI + f"SELECT strategy_id, persistence, evidence_level, least(100, pts*18)::BIGINT AS evidence_score, dependency, {r('corr')}, {r('beta')}, next_step FROM tr")
def triage(spark, folder):
    t, _ = _triaged(spark, folder)
    return t.select(ID, "persistence", "evidence_level", F.col("evidence_score").cast("long").alias("evidence_score"), "dependency",
                    rounded("corr").alias("corr"), rounded("beta").alias("beta"), "next_step")


def _lvl(x):
    return f"(CASE WHEN {x} IS NULL THEN 'medium' WHEN {x}<55 THEN 'high' WHEN {x}<72 THEN 'medium' ELSE 'low' END)"


@query("risk_tags", TRI + f"""SELECT strategy_id, {_lvl('risk')} drawdown_risk, {_lvl('return_quality')} stability_risk,
   CASE WHEN regexp_matches(flags, 'TOO_GOOD_TO_BE_TRUE|DSR_FAIL|OOS_NEGATIVE_RETURN') THEN 'high' WHEN regexp_matches(flags, 'DSR_OVERFIT_RISK|OVERFIT_SUSPECT_HOLDOUT|LOW_EFFECTIVE_SAMPLE') AND {_lvl('credibility')}='low' THEN 'medium' ELSE {_lvl('credibility')} END overfit_tag,
   CASE WHEN regexp_matches(flags, 'INSUFFICIENT_SAMPLE|SHORT_TRACK_RECORD|LOW_EFFECTIVE_SAMPLE') OR sh THEN 'high' WHEN evidence_level IN ('low','limited') THEN 'medium' WHEN span_years>=2 THEN 'low' ELSE 'medium' END sample_risk,
   CASE WHEN abs(mdd)>=0.35::DOUBLE THEN 'high' WHEN abs(mdd)>=0.2::DOUBLE AND {_lvl('risk')}='low' THEN 'medium' ELSE {_lvl('risk')} END tail_risk FROM tr""")
def risk_tags(spark, folder):
    t, _ = _triaged(spark, folder)
    return T.risk_tags(t)


@query("mc_verdict", BQ.MC.rstrip() + f""", m AS ({BQ.MCQ}) SELECT strategy_id, CASE WHEN maxdd_worst5<=-0.75::DOUBLE THEN 'high' WHEN cagr_p5<0 OR 1-prob_loss<0.75::DOUBLE THEN 'medium' WHEN maxdd_worst5<=-0.45::DOUBLE THEN 'medium' ELSE 'low' END mc_level, {r('prob_loss')} FROM m""")
def mc_verdict(spark, folder):
    from pathscreen.catalog.views import v_ret
    return pick(T.mc_verdict(R.monte_carlo(M.path(v_ret(spark, folder)))), [ID, "mc_level"], ["prob_loss"])


@query("route_recommendation", TRI + """SELECT strategy_id, CASE WHEN light='random_fail' OR random_p>0.2::DOUBLE THEN 'pro' WHEN display>=75 AND abs(mdd)*100>=40 THEN 'overlay'
   WHEN dependency='high' OR (display>=60 AND display<82 AND light='marginal') THEN 'exposure' WHEN display<60 THEN 'coaching' ELSE 'pro' END route FROM tr""")
def route_recommendation(spark, folder):
    t, _ = _triaged(spark, folder)
    return T.route(t).select(ID, "route")


_ADV = ", ".join(f"('{c}',{p})" for c, p, _, _ in dims.ADVICE)
_SOFT = ",".join(f"'{c}'" for c in dims.SOFT_EDGE)
FL = ", fl AS (SELECT strategy_id, judgement, grade, unnest(string_split(flags,'|')) code FROM sx)"


@query("coaching_top3", SCORE.rstrip() + FL + f""", ad(code, priority) AS (VALUES {_ADV}), rk AS (SELECT strategy_id, code, row_number() OVER (PARTITION BY strategy_id ORDER BY priority) rn FROM fl JOIN ad USING (code))
   SELECT sx.strategy_id, sx.grade, CASE WHEN judgement='OK' AND sx.strategy_id IN (SELECT strategy_id FROM rk WHERE code IN ({_SOFT})) THEN 'OK_SOFT' ELSE judgement END tone,
   coalesce((SELECT string_agg(code, '|' ORDER BY rn) FROM rk WHERE rk.strategy_id=sx.strategy_id AND rn<=3), '') issues FROM sx""")
def coaching_top3(spark, folder):
    s, _, _ = score_tables(spark, folder)
    c = T.coaching(stage(s.select(ID, "grade", "judgement", "flags")), dims.advice(spark))
    return c.select(ID, "grade", "tone", F.array_join("issues.code", "|").alias("issues"))


def _flag_rows(spark, folder):
    s, _, _ = score_tables(spark, folder)
    return s.select(ID, F.explode("flags").alias("f")).select(ID, "f.*")


@query("distinct_flags", SCORE.rstrip() + FL + " SELECT DISTINCT strategy_id, code FROM fl WHERE code<>''")
def distinct_flags(spark, folder):
    rows = _flag_rows(spark, folder).select(ID, "code")
    return S.distinct_flags(rows.unionByName(rows))


_MSG = ", ".join("('{}','{}','{}')".format(c, lang, t.replace("'", "''")) for c, lang, t in dims.MESSAGES)


@query("join_messages", SCORE.rstrip() + FL + f""", ms(code, lang, template) AS (VALUES {_MSG}) SELECT strategy_id, code, coalesce(w.template, e.template, fl.code) template FROM fl
   LEFT JOIN (SELECT code, template FROM ms WHERE lang='zh') w USING (code) LEFT JOIN (SELECT code, template FROM ms WHERE lang='en') e USING (code) WHERE code<>''""")
def join_messages(spark, folder):
    rows = _flag_rows(spark, folder).withColumn("args", F.array(F.lit("{0}"), F.lit("{1}")))
    return dims.join_messages(rows, dims.messages(spark), "zh").select(ID, "code", F.col("message").alias("template"))
