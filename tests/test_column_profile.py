"""The profile of all columns against plain Python over the uploaded text."""
import csv
import io
from datetime import datetime, timedelta
from statistics import median

from pathscreen.catalog import loader_queries as Q


def number(text):
    try:
        return float(text)
    except ValueError:
        return None


def test_all_columns_of_all_files(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i), i % 7, "click", 20 + i % 50 + i % 9 / 8) for i in range(1200)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for f in Q.upload_files(spark, str(tmp_path)).collect():
        head, *body = list(csv.reader(io.StringIO(bytes(f.content).decode()))) or [[]]
        for c, name in enumerate(head):
            texts = [x[c] for x in body]
            nums = [abs(x) for x in map(number, texts) if x is not None]
            dates = sum(t[:5].count("-") == 1 and t[4] == "-" or t.isdigit() and 1000 <= int(t) for t in texts)
            want[f.path, c] = (name.replace(" ", "_").lower(), len(body), len(head), dates / len(body), len(nums) / len(body), round(median(nums), 6) if nums else None, False)
    got = {(r.file, r.col_no): tuple(r)[2:] for r in Q.column_profile_all(spark, str(tmp_path)).collect()}
    assert got == want and {c for _, c in got} == {0, 1, 2}
    # the last file of two numbers is file9: ids of three digits are no years; no file without cells has a row
    assert got["file9", 2][3] == 0 and got["file9", 0][3] == 1 and not any(f == "file6" for f, _ in got)
