"""Named queries over asset recognition and batch summaries."""
from __future__ import annotations

from pyspark.sql import functions as F

from pathscreen.catalog import score_queries as SQ
from pathscreen.catalog.registry import pick, query, r, rounded, table
from pathscreen.catalog.views import ctes, v_beta, v_dayret
from pathscreen.operators import assetmatch as A, batch, metrics as M
from pathscreen.operators.metrics import ID
from pathscreen.plans import dims
from pathscreen.staging import stage


def names(spark, folder):
    """File name and symbol column of each strategy, built from its number."""
    n = F.col(ID)
    ids = table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias(ID))
    file = (F.when(n % 3 == 0, F.concat(F.lit("runs/B"), (n + 1).cast("string"), F.lit("USDT_4h_swing.csv")))
            .when(n % 3 == 1, F.lit("swing-test 4H.csv")).otherwise(F.concat(F.lit("B"), (n + 3).cast("string"), F.lit("7H vs B"), (n + 1).cast("string"), F.lit("1D.tsv"))))
    return ids.withColumn("file_name", file).withColumn("symbol", F.when(n % 7 == 3, F.concat(F.lit("B"), (n + 2).cast("string"), F.lit("-USDT"))))


NAMES = """SELECT n_nationkey::BIGINT strategy_id, CASE n_nationkey%3 WHEN 0 THEN 'runs/B'||(n_nationkey+1)||'USDT_4h_swing.csv' WHEN 1 THEN 'swing-test 4H.csv' ELSE 'B'||(n_nationkey+3)||'7H vs B'||(n_nationkey+1)||'1D.tsv' END file_name,
   CASE WHEN n_nationkey%7=3 THEN 'B'||(n_nationkey+2)||'-USDT' END symbol FROM nation"""


def aliases(spark, folder):
    return table(spark, folder, "part").select(F.col("p_brand").alias("asset_key")).distinct().select(
        F.regexp_replace("asset_key", "^Brand#", "B").alias("alias"), "asset_key")


ALIAS = "SELECT DISTINCT replace(p_brand, 'Brand#', 'B') AS alias, p_brand asset_key FROM part"


def tok_sql(src: str, col: str) -> str:
    stem = f"regexp_replace(list_last(regexp_split_to_array({col}, '[\\\\/]')), '\\.(csv|txt|tsv|json)$', '', 'i')"
    pair = f"'^(.+?)({A.PAIR_SUFFIX})$'"
    fr = f"'^([A-Z0-9]+?)\\d+({A.TIMEFRAME})$'"
    return f"""SELECT strategy_id, tok_pos, tok, cand, rk FROM (SELECT strategy_id, tok_pos, tok, unnest([tok, regexp_replace(tok, {pair}, '\\1'), base, regexp_replace(base, {pair}, '\\1')]) cand, unnest([0,1,2,3]) rk
      FROM (SELECT *, regexp_replace(tok, {fr}, '\\1') base FROM (SELECT strategy_id, unnest(t) tok, unnest(range(0, len(t))) tok_pos FROM (SELECT strategy_id, list_filter(regexp_split_to_array(upper({stem}), '[^A-Z0-9]+'), lambda x: x<>'') t FROM {src} WHERE {col} IS NOT NULL))))"""


def key_sql(src: str) -> str:
    return f"SELECT strategy_id, min(asset_key) asset_key FROM (SELECT strategy_id, tok_pos, min_by(asset_key, rk) asset_key FROM {src} JOIN al ON alias=cand GROUP BY 1,2) GROUP BY 1 HAVING count(DISTINCT asset_key)=1"


NK = dict(nm=NAMES, al=ALIAS, tf=tok_sql("nm", "file_name"), ts=tok_sql("nm", "symbol"), fk=key_sql("tf"), sk=key_sql("ts"))


@query("ticker_tokens", ctes(**NK) + "SELECT DISTINCT strategy_id, tok_pos::BIGINT tok_pos, tok, cand AS candidate FROM tf")
def ticker_tokens(spark, folder):
    return A.token_candidates(names(spark, folder), "file_name").select(ID, F.col("tok_pos").cast("long").alias("tok_pos"), "tok", "candidate")


@query("join_alias_tokens", ctes(**NK) + "SELECT strategy_id, asset_key FROM fk")
def join_alias_tokens(spark, folder):
    return A.key_from_name(names(spark, folder), "file_name", aliases(spark, folder)).select(ID, "asset_key")


@query("semi_available", ctes("v_dayret", **NK) + "SELECT strategy_id, asset_key FROM sk WHERE asset_key IN (SELECT asset_key FROM v_dayret)")
def semi_available(spark, folder):
    n = names(spark, folder).where("symbol IS NOT NULL")
    return A.semi_available(A.key_from_name(n, "symbol", aliases(spark, folder)), v_dayret(spark, folder)).select(ID, "asset_key")


FP = """SELECT strategy_id, asset_key, count(*) AS overlap, corr(ret,aret) corr FROM (SELECT strategy_id, ts::DATE AS day, product(1+ret)-1 ret FROM v_beta GROUP BY 1,2) s
   JOIN (SELECT asset_key, ts::DATE AS day, aret FROM v_dayret) a USING (day) GROUP BY 1,2 HAVING count(*)>=60 AND stddev_pop(ret)>0 AND stddev_pop(aret)>0"""
RK = """SELECT *, row_number() OVER w AS rank, abs(corr)-coalesce(lead(abs(corr)) OVER w, 0) margin FROM fp WINDOW w AS (PARTITION BY strategy_id ORDER BY abs(corr) DESC, asset_key)"""


def _fp(spark, folder):
    daily = M.daily_compound(v_beta(spark, folder))
    return A.fingerprints(daily, v_dayret(spark, folder).withColumn("day", F.to_date("ts")))


@query("join_corr_fingerprint", ctes("v_beta", fp=FP) + f"SELECT strategy_id, asset_key, overlap, {r('corr')} FROM fp")
def join_corr_fingerprint(spark, folder):
    return pick(_fp(spark, folder), [ID, "asset_key", "overlap"], ["corr"])


@query("rank_corr", ctes("v_beta", fp=FP, rk=RK) + f"SELECT strategy_id, asset_key, rank, {r('corr')}, {r('margin')} FROM rk")
def rank_corr(spark, folder):
    return pick(A.rank_corr(_fp(spark, folder)), [ID, "asset_key", "rank"], ["corr", "margin"])


DET = """SELECT *, CASE WHEN sym IS NOT NULL AND agree THEN 'symbol+corr' WHEN sym IS NOT NULL AND fil=sym THEN 'symbol+filename' WHEN sym IS NOT NULL THEN 'symbol' WHEN fil IS NOT NULL AND agree THEN 'filename+corr'
    WHEN fil IS NOT NULL THEN 'filename' WHEN abs(tc)>=0.25 THEN 'correlation' END via,
   CASE WHEN sym IS NOT NULL THEN 'high' WHEN fil IS NOT NULL AND agree THEN 'high' WHEN fil IS NOT NULL AND nc IS NOT NULL THEN 'medium' WHEN fil IS NOT NULL AND tov>=30 THEN 'low' WHEN fil IS NOT NULL THEN 'medium'
    WHEN abs(tc)>=0.6 AND mg>=0.1 THEN 'high' WHEN abs(tc)>=0.4 THEN 'medium' WHEN abs(tc)>=0.25 THEN 'low' ELSE 'none' END confidence
   FROM (SELECT nm.strategy_id, sk.asset_key sym, fk.asset_key fil, t.asset_key tk, t.corr tc, t.overlap tov, t.margin mg, n.corr nc, coalesce(abs(n.corr)>=0.3, false) agree FROM nm
    LEFT JOIN (SELECT sk.* FROM sk JOIN st USING (asset_key)) sk USING (strategy_id) LEFT JOIN (SELECT fk.* FROM fk JOIN st USING (asset_key)) fk USING (strategy_id)
    LEFT JOIN (SELECT * FROM rk WHERE rank=1) t USING (strategy_id) LEFT JOIN rk n ON n.strategy_id=nm.strategy_id AND n.asset_key=coalesce(sk.asset_key, fk.asset_key))"""
DETQ = ctes("v_beta", **NK, st="SELECT DISTINCT asset_key FROM v_dayret", fp=FP, rk=RK, de=DET)
for _name in ("v_dayret", "v_beta", "st", "fp", "rk"):  # each is read several times
    DETQ = DETQ.replace(f"{_name} AS (", f"{_name} AS MATERIALIZED (", 1)
BEST = "SELECT strategy_id, coalesce(sym, fil, CASE WHEN via='correlation' THEN tk END) asset_key, via, confidence FROM de"


def _detect(spark, folder):
    nm, al, store = names(spark, folder), aliases(spark, folder), stage(v_dayret(spark, folder).select("asset_key").distinct())
    ranked = stage(A.rank_corr(_fp(spark, folder)))
    fk = A.semi_available(A.key_from_name(nm, "file_name", al), store)
    sk = A.semi_available(A.key_from_name(nm.where("symbol IS NOT NULL"), "symbol", al), store)
    return A.detect_asset(nm, ranked, fk, sk), ranked


@query("detect_asset", DETQ + BEST)
def detect_asset(spark, folder):
    return _detect(spark, folder)[0].select(ID, "asset_key", "via", "confidence")


@query("anti_alternatives", DETQ.rstrip() + f", be AS ({BEST}) SELECT strategy_id, asset_key, alt_rank FROM (SELECT rk.strategy_id, rk.asset_key, row_number() OVER (PARTITION BY rk.strategy_id ORDER BY rank) alt_rank FROM rk JOIN be USING (strategy_id) WHERE be.asset_key IS NULL OR rk.asset_key<>be.asset_key) WHERE alt_rank<=4")
def anti_alternatives(spark, folder):
    det, ranked = _detect(spark, folder)
    return A.anti_alternatives(ranked, det).select(ID, "asset_key", "alt_rank")


_PROF = ", ".join(f"('{key}','{profile}')" for key, profile, _ in dims.ASSETS)
_PN = "SELECT event_id, CASE event_id%6 WHEN 0 THEN 'BTC' WHEN 1 THEN 'XLK' WHEN 2 THEN 'ZZZ' ELSE NULL END asset_key, ['eth_grid','doge7h','spy swing','plain', 'Index_A_share', 'cl trend'][1+(event_id//6)%6] fname FROM events"


@query("profile_from_name", ctes(nm=_PN) + f", pr(k, profile) AS (VALUES {_PROF}) SELECT event_id, coalesce(pr.profile, CASE WHEN regexp_matches(upper(fname), '{A.CRYPTO_NAMES}') THEN 'crypto' WHEN regexp_matches(upper(fname), '{A.ALT_NAMES}') THEN 'altcoin' WHEN regexp_matches(upper(fname), '{A.INDEX_NAMES}') THEN 'stock_index' ELSE 'other' END) profile FROM nm LEFT JOIN pr ON k=asset_key")
def profile_from_name(spark, folder):
    e, m = table(spark, folder, "events"), F.col("event_id") % 6
    nm = e.select("event_id", F.when(m == 0, "BTC").when(m == 1, "XLK").when(m == 2, "ZZZ").alias("asset_key"),
                  F.element_at(F.array(*[F.lit(x) for x in ("eth_grid", "doge7h", "spy swing", "plain", "Index_A_share", "cl trend")]),
                               (F.floor(F.col("event_id") / 6) % 6 + 1).cast("int")).alias("fname"))
    return A.profile_from_name(nm, "fname", dims.assets(spark)).select("event_id", "profile")


_PV = ", ".join(str(p).replace('"', "'") for p in dims.PROFILES)


@query("join_profile", f"SELECT user_id, event_id, mdd50::DOUBLE AS mdd50, n_min::BIGINT AS n_min FROM (SELECT *, CASE WHEN event_type IN ('click','view') THEN 'crypto' WHEN event_type='error' THEN 'altcoin' ELSE event_type END p0 FROM events) JOIN (SELECT * FROM (VALUES {_PV}) t(profile,a,b,mdd50,c,e,n_min,f,g)) pf ON pf.profile=CASE WHEN p0 IN ('crypto','altcoin') THEN p0 ELSE 'other' END")
def join_profile(spark, folder):
    e = table(spark, folder, "events")
    e = e.withColumn("profile", F.when(F.col("event_type").isin("click", "view"), "crypto").when(F.col("event_type") == "error", "altcoin").otherwise(F.col("event_type")))
    return dims.join_profile(e, dims.profiles(spark)).select("user_id", "event_id", "mdd50", "n_min")


# --- batch ---------------------------------------------------------------------------------------
_DIMS = ["source", "profile", "grade", "judgement", "edge_light", "evidence_status", "tier", "headline", "sample_hard", "benchmark_available", "random_available"]
_SQL_DIMS = dict(profile="prof", edge_light="light", sample_hard="sh", benchmark_available="edge_score IS NOT NULL", random_available="random_p IS NOT NULL AND edge_score IS NOT NULL")
BAT = SQ.SCORE.rstrip() + ", ba AS MATERIALIZED (SELECT *, 'desk'||(strategy_id%4) AS source, ['crypto','stock_index','altcoin','other','unlisted'][1+strategy_id%5] AS prof FROM sx) "


@query("score_batch", BAT + "SELECT strategy_id, source, prof AS profile, n, display, grade, judgement FROM ba")
def score_batch(spark, folder):
    return SQ.scored(spark, folder)[0].select(ID, "source", "profile", "n", "display", "grade", "judgement")


@query("outcome_counts", BAT + "SELECT dimension, value, count(*) AS rows FROM (" + " UNION ALL ".join(
    f"SELECT '{d}' dimension, coalesce(({_SQL_DIMS.get(d, d)})::VARCHAR, '') AS value FROM ba" for d in _DIMS) + ") GROUP BY 1,2")
def outcome_counts(spark, folder):
    return batch.outcome_counts(SQ.score_rows(spark, folder), _DIMS)


@query("score_distribution", BAT + f"""SELECT count(*) AS rows, {r('avg(display)', 4, 'mean')}, {r('median(display)', 4, 'median')}, """ + ", ".join(
    r(f"quantile_cont(display, {p})", 4, n) for n, p in (("p05", 0.05), ("p25", 0.25), ("p75", 0.75), ("p95", 0.95))) + ", min(display) AS min, max(display) AS max FROM ba")
def score_distribution(spark, folder):
    return pick(batch.score_distribution(SQ.score_rows(spark, folder)), ["rows", "min", "max"], ["mean", "median", "p05", "p25", "p75", "p95"], digits=4)


@query("score_by_group", BAT + "SELECT grouping, member, count(*) AS count, " + f"{r('avg(display)', 4, 'mean')}, {r('median(display)', 4, 'median')}, min(display) AS min, max(display) AS max FROM (SELECT 'source' grouping, source AS member, display FROM ba UNION ALL SELECT 'profile', prof, display FROM ba) GROUP BY 1,2")
def score_by_group(spark, folder):
    return pick(batch.score_by_group(SQ.score_rows(spark, folder), ["source", "profile"]), ["grouping", "member", "count", "min", "max"], ["mean", "median"], digits=4)


@query("topk_scores", BAT + "(SELECT 'top' side, strategy_id, display, grade FROM ba ORDER BY display DESC, strategy_id LIMIT 20) UNION ALL (SELECT 'bottom', strategy_id, display, grade FROM ba ORDER BY display, strategy_id LIMIT 20)")
def topk_scores(spark, folder):
    rows = SQ.score_rows(spark, folder).select(ID, "display", "grade")
    top, low = batch.topk_scores(rows), batch.topk_scores(rows, best=False)
    return top.select(F.lit("top").alias("side"), "*").unionByName(low.select(F.lit("bottom").alias("side"), "*"))


@query("flag_counts", BAT + """, k0 AS (SELECT 'flag' kind, unnest(string_split(flags,'|')) code FROM ba UNION ALL SELECT 'cap', unnest(string_split(array_to_string(list_filter([hard, soft, expe], lambda x: x<>''), '|'),'|')) FROM ba)
   SELECT * FROM (SELECT kind, code, count(*) AS rows, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, code) AS rank FROM k0 WHERE code<>'' GROUP BY 1,2)""")
def flag_counts(spark, folder):
    rows = SQ.score_rows(spark, folder).select(F.col("flags.code").alias("flag_codes"), "cap_reasons")
    return batch.code_counts(rows, {"flag": "flag_codes", "cap": "cap_reasons"})


@query("sink_report_json", SQ.SCORE + "SELECT strategy_id, display, grade, random_p IS NULL no_control, round(sortino,4)+0.0::DOUBLE sortino FROM sx")
def sink_report_json(spark, folder):
    """Strict JSON documents (non-finite numbers are null), parsed back for the comparison."""
    from pathscreen.sources.sinks import report_json
    docs = report_json(SQ.score_rows(spark, folder))
    back = F.from_json("report", "struct<display:double,grade:string,random_p:double,metrics:struct<sortino:double>>")
    return docs.withColumn("b", back).select(ID, "b.display", "b.grade", F.col("b.random_p").isNull().alias("no_control"), rounded("b.metrics.sortino", 4).alias("sortino"))
