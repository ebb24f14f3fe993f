"""Files read in ranges: the same cells as Python's csv for every cut."""
import random

import pytest
from hypothesis import given, settings, strategies as st

from pathscreen.sources import big_files as B, files as FI


def by_splits(text: str, sep: str, cuts: list[int]) -> list[list[str]]:
    """Rows of the text's lines, cut before the given lines, as the tasks would read them."""
    lines = text.split("\n")
    parts = [lines[a:b] for a, b in zip([0, *cuts], [*cuts, len(lines)])]
    quotes, rows, state, pending = B.Quotes(sep), [], False, None
    for part in parts:
        split = B.Split(sep, state)
        done = split.rows(part[:1]) + split.rows(part[1:])  # two batches
        turns = []
        for s in (False, True):
            for line in part:
                s = quotes.after(line, s)
            turns.append(s)
        if split.lead is not None:
            pending += split.lead
        if pending is not None and (done or split.held or not split.inside):
            rows += B.rows_of("\n".join(pending), sep)
            pending = None
        rows += done
        if split.held:
            pending = list(split.held)
        assert turns[state] == split.inside
        state = turns[state]
    return rows + (B.rows_of("\n".join(pending), sep) if pending is not None else [])


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet='",;\n\r a"\n', max_size=40), st.sampled_from(",;"), st.randoms(use_true_random=False))
def test_any_cut_gives_the_rows_of_csv(text, sep, rng):
    count = text.count("\n") + 1
    cuts = sorted(rng.sample(range(1, count), rng.randint(0, count - 1))) if count > 1 else []
    assert by_splits(text, sep, cuts) == B.rows_of(text, sep)


def tricky(n=60):
    rng = random.Random(4)
    cells = ['plain', '"two\nlines"', '"a ""b"" c"', '"x,y"', ' "led"', '5" pipe', '""', '"\n\n"', '"end"\r', 'é', '"é\r\nü"']
    return "name,text\n" + "".join(",".join(rng.choice(cells[:-3] + cells[-2:]) for _ in range(2)) + rng.choice(["\n", "\r\n", "\n\n"]) for _ in range(n))


@pytest.mark.parametrize("size", [7, 64, 301, 100_000])
def test_spark_reads_ranges(spark, tmp_path, size):
    bodies = {"utf.csv": tricky().encode(), "mark.csv": b"\xef\xbb\xbf" + tricky(20).encode(), "gb.csv": tricky(15).replace("name", "名|字").encode("gb18030"),
              "semi.txt": "a;b\n1;2\n3;4".encode(), "one.csv": b"x\ny\n", "blank.csv": b"\n\n", "latin.csv": "a,b\n\xe9,1\n".encode("latin1"), "wide.csv": "a,b\n1,2\n".encode("utf-16")}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    if size < 100:  # many tiny splits: the tricky ones alone
        for name in ("semi.txt", "one.csv", "latin.csv", "mark.csv"):
            (tmp_path / name).write_bytes(b"a,b\n1,2\n")
            bodies[name] = b"a,b\n1,2\n"
        (tmp_path / "utf.csv").write_bytes(tricky(8).encode())
        (tmp_path / "gb.csv").write_bytes(tricky(4).encode())
        bodies |= {"utf.csv": tricky(8).encode(), "gb.csv": tricky(4).encode()}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found: dict[str, dict] = {}
        for r in B.scan_ranges(spark, str(tmp_path)).collect():
            cells = found.setdefault(r.path.rsplit("/", 1)[1], {})
            assert (r.row_no, r.col_no) not in cells
            cells[r.row_no, r.col_no] = r.txt
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found.pop("wide.csv") == {(-1, -1): "utf16"} and found.pop("blank.csv") == {(-1, -1): "empty_file"}
    for name in bodies.keys() - {"wide.csv", "blank.csv"}:
        rows = FI._parse(bodies[name])
        assert found[name] == {(i, j): c for i, row in enumerate(rows) for j, c in enumerate(row)}, name
