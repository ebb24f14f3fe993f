"""SimHash links against all pairs: odd texts, cells dealt out in chunks, no link lost."""
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pathscreen.llm import linking, segment_popcounts as sp

BASE = [f"word{i}" for i in range(300)]
rng = random.Random(5)


def near(k):
    w = list(BASE)
    for _ in range(k):
        w[rng.randrange(len(w))] = f"other{rng.randrange(5)}"
    return " ".join(w)


TEXTS = [" ".join(BASE), " ".join(BASE).upper(), *(near(k % 5) for k in range(60)), "", None, "  \n ", "one", "One", "one two three", "a b c d", "A  b\tc d", "x " * 50_000, "y z \x1c q", "ä Ä"]
ROWS = [(i, t, "c") for i, t in enumerate(TEXTS)] + [(None, "one", "c"), (None, "nobody else", "c"), (3, "", "c"), (3, "", "c")]


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or ""))
    grams = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def grouped(marks, bits=4):
    group = list(range(len(marks)))
    changed = True
    while changed:
        changed = False
        for a, x in enumerate(marks):
            for b, y in enumerate(marks):
                if (x ^ y).bit_count() <= bits and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return group


def test_against_all_pairs(spark):
    docs = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, fp string, root int")
    got = sp.near_duplicates(docs).collect()
    marks = [plain(t) for _, t, _ in ROWS]
    group = grouped(marks)
    want = []
    for k, row in enumerate(ROWS):
        ids = [ROWS[j][0] for j in range(len(ROWS)) if group[j] == group[k] and ROWS[j][0] is not None]
        want.append((row[0], f"{marks[k]:016x}", min(ids) if ids else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sp.near_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sp.linked_fingerprints(spark.createDataFrame([(1,)], "fp long"), 5)


@pytest.mark.parametrize(("chunk", "share"), [(1024, 20_000), (4, 10**9), (40, 10**9)])
def test_crowded_cells_lose_no_link(spark, chunk, share):
    """Chains and clusters within a few cells; with small chunks nearly every cell is dealt out."""
    r = np.random.default_rng(9)
    marks = {0, 2**64 - 1}
    for _ in range(4):
        x = int(r.integers(0, 2**63)) * 2
        for _ in range(70):
            marks.add(x)
            for b in r.integers(0, 64, r.integers(1, 7)):
                x ^= 1 << int(b)
            if r.random() < 0.5:
                x = next(iter(marks))
    marks = sorted(marks)
    signed = [m - 2**64 if m >= 2**63 else m for m in marks]
    classes = spark.createDataFrame([(m,) for m in signed], "fp long")
    roots = {row.key: row.root for row in sp.linked_fingerprints(classes, 4, chunk, share).collect()}
    group = grouped(marks)
    named = [roots.get(m, m) for m in signed]
    assert all((named[a] == named[b]) == (group[a] == group[b]) for a in range(len(marks)) for b in range(a))
    if chunk < 100:
        cells = sp.heavy_cells(classes, chunk, share).collect()
        posted = classes.mapInArrow(sp._posted, "cell long, fp long").groupBy("cell").count().where(F.col("count") > max(chunk, 1)).collect()
        assert {c.cell for c in cells} == {c.cell for c in posted} and cells


def test_components_with_a_heavy_vertex(spark):
    star = spark.range(1, 6001).select(F.col("id").alias("a"), F.lit(6001).alias("b"))
    path = spark.range(7000, 7040).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = linking.components(star.unionByName(path)).groupBy("root").count().collect()
    assert {tuple(r) for r in got} == {(1, 6001), (7000, 41)}
    assert linking.components(star.limit(0)).count() == 0
