import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import frame, record
from pathscreen.operators import metrics as M, scoring as S, triage as T
from pathscreen.plans import dims
from pathscreen.sources import samples, sinks
from pathscreen.staging import stage
from pathscreen.streaming.drawdown import advance

META = "strategy_id long, caliber string, profile string, n_trials int, forward_looking boolean, unit_suspect boolean"


def score(spark, pdf, meta):
    p = stage(M.path(frame(spark, pdf)))
    return S.score_unified(S.feature_table(p, sims=100), spark.createDataFrame(meta, META), dims.profiles(spark))


def test_gates_and_caps(spark):
    good, ids = record(1100, 9, 1, 0.0013, 0.011), spark.createDataFrame([(5,)], "strategy_id long")
    smooth = samples.flagged(ids, "strategy_id").withColumn("ts", F.expr("timestampadd(DAY, day, TIMESTAMP_NTZ'2021-01-01 00:00:00')")).toPandas()
    rows = pd.concat([good, good.assign(strategy_id=2), record(300, 3, 3, -0.004, 0.01), record(50, 4, 4, 0.002, 0.01), smooth[["strategy_id", "ts", "ret"]]])
    meta = [(1, None, "crypto", 1, False, False), (2, None, "crypto", 500, True, False), (3, None, "other", 1, False, False),
            (4, None, "nobody", 1, False, False), (5, None, "other", 1, False, False)]
    out = score(spark, rows, meta)
    s = out.orderBy("strategy_id").toPandas().set_index("strategy_id")
    codes = {i: [f["code"] for f in s["flags"][i]] for i in s.index}
    assert s.grade[1] == "PROVISIONAL" and s.evidence_status[1] == "provisional" and s.display[1] <= 87
    assert s.judgement[2] == "CAUTION" and s.display[2] <= 59 and {"FORWARD_LOOKING_INPUT", "MULTIPLE_TESTING_PENALTY"} <= set(codes[2])
    assert s.headline[3] == "NOT_PROFITABLE" and "NEGATIVE_RETURN" in codes[3]
    assert "INSUFFICIENT_SAMPLE" in codes[4] and s.consistency.isna()[4]
    assert s.judgement[5] == "FLAGGED" and s.display[5] <= 59 and "STALE_OR_INTERPOLATED" in codes[5]
    advice = T.coaching(out.select("strategy_id", "grade", "judgement", "flags"), dims.advice(spark)).toPandas()
    assert (advice.issues.str.len() <= 3).all()
    tri = T.triage(out)
    assert set(tri.toPandas().next_step) == {"collect_evidence"}
    assert T.risk_tags(tri).where("strategy_id = 5").toPandas().overfit_tag[0] == "high"
    doc = sinks.report_json(out).toPandas().report
    assert not doc.str.contains("NaN|Infinity").any()


def test_branches_of_the_features_are_planned_one_by_one(spark):
    p = stage(M.path(frame(spark, record(300, 7))))
    plan = S.feature_table(p, sims=50)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not any(step in plan for step in ("Aggregate", "Window", "Generate"))


def test_parts_of_the_rules_are_planned_one_by_one(spark, monkeypatch):
    plans = {}
    for name in ("with_pillars", "_gates", "_verdict"):
        def part(f, name=name, real=getattr(S, name)):
            plans[name] = f._jdf.queryExecution().optimizedPlan().toString()
            return real(f)
        monkeypatch.setattr(S, name, part)
    out = score(spark, record(300, 7), [(1, None, "other", 1, False, False)])
    assert out.count() == 1 and len(plans) == 3
    assert not any(step in plan for plan in plans.values() for step in ("Join", "Project"))


def test_live_state_equals_the_batch_and_counts_late_rows():
    pdf = record(200, 8)
    us = pdf.ts.astype("int64").to_numpy() // 1000
    start = (-(2 ** 62), 1.0, 1.0, 0.0, 0, 0.0, 0.0, 0)
    whole = advance(start, us, pdf.ret.to_numpy())
    half = advance(advance(start, us[:90], pdf.ret.to_numpy()[:90]), us[80:], pdf.ret.to_numpy()[80:])
    assert np.allclose(whole[1:7], half[1:7]) and half[7] == 10
    eq = np.cumprod(1 + pdf.ret.to_numpy())
    assert np.isclose(whole[3], min(0, (eq / np.maximum(np.maximum.accumulate(eq), 1) - 1).min()))


def test_every_survey_query_is_registered():
    assert len(E.queries()) >= 119 and set(E.oracle_sql()) <= set(E.queries())


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
@pytest.mark.parametrize("name", ["core_metrics", "trial_budget", "calendar_recurrence", "benchmark_stats", "random_control_events", "trades_to_daily",
                                  "coerce_numeric", "parse_dates", "preflight_report", "detect_asset", "scan_delimited", "stream_live_drawdown"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    cur = con.execute(E.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    got = E.queries()[name](spark, SMALL)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(repr(tuple(r)) for r in got.select(*[f"`{c}`" for c in cols]).collect()) == want


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_entry(spark):
    assert E.entry(spark).count() > 0
