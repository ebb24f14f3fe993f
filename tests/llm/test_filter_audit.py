"""The audit against a walk through every order, on odd rows."""
import re
from collections import Counter
from itertools import permutations

from pathscreen.llm import filter_audit

LONG = " ".join(f"w{i}" for i in range(130))
SAME = " ".join(f"w{i % 9}" for i in range(150))
TEXTS = [(1, LONG, "en"), (2, LONG, "de"), (2, LONG, "en"), (3, SAME, "en"), (4, "SHOUT " * 3, "en"), (5, None, "de"), (6, "", None), (7, "", ""), (None, LONG, "en"), (None, "", "fr"), (8, "a # b", "en"),
         (9, LONG.upper() + " #", "de"), (10, SAME, None), (11, "x " * 40_000, "fr"), (1, LONG, "en"), (12, "\x1c  ", "en")]
LABELS = [(2, 1, 0), (2, 0, 1), (3, 1, 1), (5, None, 1), (None, 1, 1), (99, 1, 1), (8, 0, None)]


def walked(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    facts = []
    for i, text, lang in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                 "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)}
        facts.append((lang or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    want = []
    for part in {f[0] for f in facts}:
        mine, shapley = [f for f in facts if f[0] == part], Counter()
        rows_of = []
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for s, f in enumerate(order, 1):
                gone, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                failing = [x for x in mine if f in x[1]]
                shapley[f] += len(gone)
                rows_of.append((part, order, s, f, len(left), len(gone), len(failing) - len(gone), sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)))
        want += [(*r, shapley[r[3]]) for r in rows_of]
    return sorted(want)


def test_against_every_order(spark):
    docs = spark.createDataFrame([(*r, "x", 5) for r in TEXTS], "doc_id long, text string, lang string, part string, mask int")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    out = filter_audit.interaction_audit(filter_audit.document_facts(docs, labels))
    assert out.columns == ["part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, out.collect())) == walked(TEXTS, LABELS)
    assert filter_audit.interaction_audit(filter_audit.document_facts(docs.limit(0), labels)).count() == 0
    none = filter_audit.interaction_audit(filter_audit.document_facts(docs, labels.limit(0))).agg({"good_lost": "sum", "toxic_lost": "max"}).first()
    assert tuple(none) == (0, 0)


def test_intervals_cover_every_order_once():
    spans = filter_audit.removal_intervals("ABC")
    for mask in range(1, 8):
        for rank, order in enumerate(filter_audit.orders("ABC")):
            want = next(s for s, f in enumerate(order, 1) if mask >> "ABC".index(f) & 1)
            assert [s for m, s, a, b in spans if m == mask and a <= rank < b] == [want]


def test_two_filters_of_ones_own(spark):
    facts = spark.createDataFrame([("p", 3, True), ("p", 1, None), ("p", None, False), ("p", 2, True)], "part string, mask int, rare boolean")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.rare_lost, r.shapley) for r in filter_audit.interaction_audit(facts, "AB", ("rare",)).collect()}
    assert got == {("AB", 1): (2, 2, 0, 1, 1, 3), ("AB", 2): (1, 1, 1, 1, 1, 3), ("BA", 1): (2, 2, 0, 1, 2, 3), ("BA", 2): (1, 1, 1, 1, 0, 3)}
