"""Columns of the user that are named like the operators' own."""
import pytest

from pathscreen.llm import chosen_path, curriculum, host_rules, license_templates, license_texts, wu_manber

WORDS = " ".join(f"w{i % 60} x{i}" for i in range(60))
NAMES = ["_name", "_text_key", "_row", "_kept_id", "_key", "_nth", "_p_key", "_host", "_p_positions"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, f"{WORDS} " + ("a" if i < 2 else " ".join(f"b{i}_{k}" for k in range(90))), "s", *(f"{n}{i}" for n in NAMES)) for i in range(4)],
                                 "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in NAMES))


def unharmed(out, columns):
    assert [c for c in out.columns if c in columns] == columns
    rows = out.collect()
    assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in NAMES)
    return rows


def test_columns_pass_through(spark, docs):
    assert sorted(r.doc_id for r in unharmed(chosen_path.keep_one(docs), docs.columns)) == [0, 2, 3]
    unharmed(curriculum.in_training_order(docs), docs.columns)
    assert len(unharmed(host_rules.host_quality(docs), docs.columns)) == 4
    bench = spark.createDataFrame([(1, "w1 x1 w2 x2")], "item_id long, text string")
    assert len(unharmed(wu_manber.decontaminate(docs, bench), docs.columns)) == 4


def test_results_replace_their_names(spark, docs):
    bench = spark.createDataFrame([(1, "w1 x1 w2 x2")], "item_id long, text string")
    for name, run in (("_leak", lambda d: wu_manber.decontaminate(d, bench)), ("_licenses", license_templates.license_scan), ("_license_texts", license_texts.license_texts),
                      ("_measures", host_rules.host_quality), ("_position", curriculum.in_training_order)):
        out = run(docs.withColumn(name, docs.source))
        assert out.columns.count(name) == 1 and out.first()[name] != "s"


def test_one_host_is_rejected(spark):
    """A host of short texts goes with its good documents; hosts beside it stay, also one with a single short text."""
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(k, "few words" if k % 10 else good, "bad") for k in range(200)] + [(1000 + k, good, f"good{k % 20}") for k in range(2000)] + [(5000, "few words", "good1"), (5001, "few words", "tiny")]
    out = host_rules.host_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.source for r in out if r._host_rejected} - {"tiny"} == {"bad"}
    assert all(r._kept == (not r._base_failed and not r._host_rejected) for r in out) and sum(r._kept for r in out) == 2000
    assert sum(not r._base_failed for r in out if r.source == "bad") == 20
