"""No single cell may fail a job."""
from pyspark.sql import functions as F

from pathscreen.operators import batch, mapping, quality, scan


def test_outlier_and_infinite_numbers_in_a_date_column(spark):
    cells = [("a", str(1_600_000_000 + 86400 * i)) for i in range(20)] + [("a", "99999999999999999"), ("a", "inf"), ("a", None)]
    out = mapping.parse_dates(spark.createDataFrame(cells, "file string, txt string")).toPandas()
    assert len(out) == 23 and out.ts.notna().sum() == 20


def test_infinities_have_end_buckets(spark):
    df = spark.createDataFrame([(1, float("inf")), (1, float("-inf")), (1, 2.0), (1, 0.0), (1, 1e300)], "k int, v double")
    rows = scan.ordered_values(df, ["k"], "v").orderBy("below").toPandas()
    assert rows.v.tolist() == [float("-inf"), 0.0, 2.0, 1e300, float("inf")]


def test_clean_series_drops_infinities(spark):
    raw = spark.createDataFrame([(1, i, float(i), i) for i in range(5)] + [(1, 9, float("inf"), 9)], "strategy_id long, ts long, value double, row_no long")
    clean, _ = mapping.clean_series(raw)
    assert clean.count() == 5


def test_phone_pattern_takes_long_digit_runs(spark):
    df = spark.createDataFrame([("c", "1" * 30_000), ("c", "call +44 20 7946 0958"), ("c", "12 34")], "g string, text string")
    assert quality.pii_values(df, "g", "text").toPandas().phone.tolist() == [2]


def test_all_codes_are_counted(spark):
    rows = spark.createDataFrame([([f"c{i}" for i in range(40)],)], "codes array<string>")
    assert batch.code_counts(rows, {"flag": "codes"}).count() == 40
    assert batch.code_counts(rows, {"flag": "codes"}, top=3).agg(F.max("rank")).first()[0] == 3


def test_date_forms(spark):
    rows = [("a", "2024/01/02"), ("a", "2024.01.02 10:00"), ("a", "Jan 2, 2024"), ("a", "2 january 2024 10:00"), ("a", "01/02/2024"), ("a", "Foo 2, 2024"), ("a", None),
            ("b", "13.02.2024"), ("b", "01.02.2024 09:05:07"), ("c", "31/31/2024"), ("c", "02/03/2024")]
    df = spark.createDataFrame([(f, i, t) for i, (f, t) in enumerate(rows)], "file string, row_no long, txt string")
    got = [str(r.ts) for r in mapping.parse_dates(df).orderBy("row_no").collect()]
    assert got == ["2024-01-02 00:00:00", "2024-01-02 10:00:00", "2024-01-02 00:00:00", "2024-01-02 10:00:00", "2024-01-02 00:00:00", "None", "None",
                   "2024-02-13 00:00:00", "2024-02-01 09:05:07", "None", "2024-02-03 00:00:00"]
