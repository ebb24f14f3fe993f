"""The manifest against a tree built level by level, with blocks of every size."""
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pathscreen.llm import merkle


def h(*parts):
    return hashlib.sha256("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts).encode()).hexdigest()


def up(nodes):
    return [hashlib.sha256("".join(nodes[i:i + 2]).encode()).hexdigest() for i in range(0, len(nodes), 2)]


def tree(nodes):
    """(root, siblings of each node, by level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, p in zip(paths, at):
            path.append(nodes[p ^ 1] if (p ^ 1) < len(nodes) else "")
        nodes, at = up(nodes), [p // 2 for p in at]
    return nodes[0], paths


def wanted(rows):
    groups = {}
    for r in rows:
        groups.setdefault("" if r[1] is None else "=" + r[1], []).append((r[0] is not None, r[0] or 0, h(*r)))
    keys = sorted(groups, key=str.encode)
    trees = [tree([x[2] for x in sorted(groups[k])]) for k in keys]
    root, over = tree([t[0] for t in trees])
    return sorted((x[2], t[0], root, "".join(p + o)) for k, t, o in zip(keys, trees, over) for x, p in zip(sorted(groups[k]), t[1]))


def leaves(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    return docs.select("doc_id", F.lit("x").alias("start"), F.lit(1).alias("n_chars"), merkle.group_key(F.col("lang")).alias("group"), merkle.record_hash(*map(F.col, docs.columns)).alias("leaf"))


rng = random.Random(3)
MIXED = [(i, rng.choice(["en"] * 6 + ["é", "z", "", None]), rng.choice(["", None, "same", "ü" * 3000, f"t{i}"])) for i in range(150)] + [(None, "en", "a"), (None, "en", "b"), (7, "en", "again"), (7, "en", "again")]


@pytest.mark.parametrize(("rows", "levels"), [(MIXED, 1), (MIXED, 2), (MIXED, 3), (MIXED, 10), (MIXED[:1], 2), ([(i, "en", "t") for i in range(33)], 2), ([(i, str(i), "t") for i in range(9)], 1)])
def test_against_a_tree_level_by_level(spark, rows, levels):
    out = merkle.manifest(leaves(spark, rows), ["doc_id", "leaf"], levels).withColumn("back", merkle.folded(F.col("leaf"), F.col("path")))
    out = out.withColumn("forged", merkle.folded(F.sha2(F.lit("x"), 256), F.col("path")))
    got = out.select("*", merkle.siblings(F.col("path")).alias("proof")).collect()
    assert sorted((r.leaf, r.subroot, r.root, r.proof) for r in got) == wanted(rows)
    assert all(r.back == r.root and r.start == "x" and r.n_chars == 1 and r.forged != r.root for r in got)


def test_empty_tables_and_names(spark):
    some = leaves(spark, MIXED)
    assert merkle.manifest(some.limit(0), ["doc_id", "leaf"]).count() == 0
    with pytest.raises(ValueError, match="path"):
        merkle.manifest(some.withColumn("path", F.lit(1)), ["doc_id"])
    assert [r[0] for r in spark.createDataFrame([(None,), ("",), ("ü",)], "x string").select(merkle.encoded(F.col("x"))).collect()] == ["-", "0:", "2:ü"]
