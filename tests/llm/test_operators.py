"""Operators on odd rows: nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathscreen.llm import byte_pairs, chosen_path, class_lm, curriculum, host_rules, license_templates, page_diff, snapshots, token_files, wu_manber

BASE = " ".join(f"w{i}" for i in range(120))
NEAR = BASE.replace("w60", "other")
TEXTS = [BASE, BASE, NEAR, "", None, "one", "one", " ".join(f"z{i % 7}" for i in range(300)), "long " * 30_000, "two  spaces\n\nUnder the MIT License. don't", BASE + " tail"]
DOCS = [(i, t, f"s{i % 2}" if i != 5 else None, "x", i) for i, t in enumerate(TEXTS)] + [(None, "no id here", "s0", "x", 0), (3, "", "s1", "x", 0)]
SCHEMA = "doc_id long, text string, source string, node string, n long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def repeated(words):
    grams = Counter(zip(words, words[1:], words[2:]))
    return len({p for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for p in (i, i + 1, i + 2)})


def test_host_rules(docs, empty):
    out = host_rules.host_quality(docs).toPandas()
    assert len(out) == len(DOCS) and {"node", "n"} <= set(out.columns)
    for text, m, kept, host in zip(out.text, out._measures, out._kept, out._host_rejected):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert (m["n_words"], m["word_chars"], m["n_repeat_words"]) == (len(w), sum(map(len, w)), repeated(w))
        assert not kept if len(w) < 50 or 100 * repeated(w) > 50 * len(w) or host else kept
    assert host_rules.host_quality(empty).count() == 0


def sets(text, width):
    w = chosen_path.tokens(text)
    return frozenset(zip(*(w[j:] for j in range(width)))) if len(w) >= width else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_against_all_pairs(docs, empty, width, monkeypatch):
    monkeypatch.setattr(chosen_path, "SMALL", 2)  # nodes of three branch on
    monkeypatch.setattr(chosen_path, "CHUNK", 2)
    monkeypatch.setattr(chosen_path, "SHINGLES", 150)  # several chunks a group
    got = chosen_path.near_duplicates(docs, width).toPandas()
    assert len(got) == len(DOCS)
    s = [sets(r[1], width) for r in DOCS]
    group = list(range(len(DOCS)))
    for _ in DOCS:
        for a, x in enumerate(s):
            for b, y in enumerate(s):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    group[a] = group[b] = min(group[a], group[b])
    want = Counter()
    for k, row in enumerate(DOCS):
        ids = [DOCS[j][0] for j in range(len(DOCS)) if group[j] == group[k] and DOCS[j][0] is not None]
        want[(row[0], len(s[k]), min(ids) if ids else None)] += 1
    none = lambda x: None if x != x else int(x)
    assert Counter((none(a), int(b), none(c)) for a, b, c in zip(got.doc_id, got.n_shingles, got.component_id)) == want
    assert chosen_path.near_duplicates(empty, width).count() == 0
    kept = chosen_path.keep_one(docs, width).toPandas()
    assert list(kept.columns) == docs.columns and sorted(none(i) or -1 for i in kept.doc_id if none(i) in (0, 1, 2, 10, 5, 6)) == [-1, 5]


def test_wu_manber_against_scan(spark, docs, empty):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30, 55))), (2, "the mit license"), (3, None), (None, "z0 z1"), (1, "one")], "item_id long, text string")
    out = wu_manber.decontaminate(docs, bench).toPandas()
    windows = {}
    for item, text in [(b.item_id, b.text) for b in bench.collect()]:
        w = wu_manber.word_list(text)
        for at in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[at:at + 10]), set()).add("" if item is None else str(item))
    for text, leak in zip(out.text, out._leak):
        w, hit, items = wu_manber.word_list(text), set(), set()
        for p, ids in windows.items():
            for at in range(len(w) - len(p) + 1):
                if tuple(w[at:at + len(p)]) == p:
                    hit.update(range(at, at + len(p)))
                    items |= ids
        assert leak["n_words"] == len(w) and {x for a in leak["spans"] for x in range(a["first"], a["end"])} == hit and list(leak["items"]) == sorted(items)
    assert wu_manber.decontaminate(empty, bench).count() == 0 and wu_manber.decontaminate(docs, bench.limit(0)).where(F.size("_leak.spans") > 0).count() == 0


def test_license_templates(spark, docs, empty):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
    out = license_templates.license_scan(spark.createDataFrame([(1, "x " + mit), (2, mit.replace("charge", "cost")), (3, "Foo is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[p.label for p in r._licenses.places] for r in out] == [["mit"], [], ["gpl"]] and out[0]._licenses.places[0].first == 1
    for label, t in license_templates.TEMPLATES.items():
        a = license_templates.Automaton(t)
        for text in (mit, "copyright 2020 2021 a b all rights reserved", t):
            w = wu_manber.word_list(text)
            joined = "".join(x.decode() + " " for x in w)
            assert (a.match(w, 0) is not None) == bool(re.match(license_templates.template_pattern(t), joined)), (label, text)
    assert license_templates.license_scan(docs).count() == len(DOCS) and license_templates.license_scan(empty).count() == 0


def test_token_counts_and_files(spark, docs, empty):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(vocabulary())
    more = docs.unionByName(spark.createDataFrame([(50, "a<|endoftext|>b  \x1c\xa0 \n\n c", None, "", 1), (51, "aaaaaaaaaaaaa 日本語 ½ ''''s", None, "", 1)], SCHEMA))
    texts = {(-1 if r.doc_id is None else r.doc_id, r.text or "") for r in more.collect()}
    want = Counter((i, len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts)
    got = byte_pairs.token_counts(more, vocabulary()).toPandas().fillna(-1)
    assert set(zip(got.doc_id.astype(int), got.n_tokens)) == set(want) and byte_pairs.token_counts(empty, vocabulary()).count() == 0
    back = token_files.read_tokens(spark, *token_files.write_tokens(more, vocabulary(), 2)).toPandas().fillna(-1).sort_values("start")
    assert len(back) == more.count() and (back.start.to_numpy() == np.concatenate(([0], np.cumsum(back.n_tokens)[:-1]))).all() and (back.doc_id.diff().dropna() >= 0).all()
    sums = {(i, zlib.crc32(np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes())) for i, t in texts}
    assert set(zip(back.doc_id.astype(int), back.ids_crc32)) == sums
    assert token_files.read_tokens(spark, *token_files.write_tokens(empty, vocabulary(), 2)).count() == 0


def test_mixing(docs, empty):
    plan = curriculum.mix_plan(docs).toPandas()
    assert len(plan) == len(DOCS) and (plan.taken <= 2 * plan["size"]).all()
    for _, g in plan.groupby(plan.source.fillna("-")):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()
    assert abs(plan.drop_duplicates("source").target.sum() - 1.5 * plan["size"].sum()) < 1e-6
    again = curriculum.mix_plan(docs.repartition(3)).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert plan[key].fillna(-1).astype(str).sort_values(key).values.tolist() == again[key].fillna(-1).astype(str).sort_values(key).values.tolist()
    order = curriculum.in_training_order(docs).toPandas()
    assert order.n.count() == sum(map(len, plan.positions)) and order._position.between(0, 1).all() and curriculum.in_training_order(empty).count() == 0


def test_class_lm(docs, empty):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    out = class_lm.class_scores(docs, held).toPandas()
    rows = [(r[0], chosen_path.tokens(r[1])) for r in DOCS]
    train = [w for i, w in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(x for w in train for x in [*w, None])
    n, v = sum(count.values()), len(count)
    want = sorted((-1 if i is None else i, len(w) + 1, round(sum(np.log10((count[x] + 1) / (n + v + 1)) for x in [*w, None]), 4)) for i, w in rows)
    got = sorted((int(i), int(k), round(b, 4)) for i, k, b in zip(out.doc_id.fillna(-1), out.n_tokens, out.base_score))
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-3)
    assert (out.train_tokens == n).all() and np.isfinite(out.score).all() and class_lm.class_scores(empty, held).count() == 0


def test_snapshots(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (3, 1, "bot", "yo"), (4, 0, None, None), (5, 0, "user", "hi"), (5, 1, "bot", "no"), (None, 0, "user", "q")]
    t = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.n_turns, r.n_copies, r.text) for r in snapshots.maximal_conversations(t).collect()}
    assert got == {(1, 2, 2, "<|user|>\nhi<|end|>\n<|bot|>\nyo<|end|>\n"), (4, 1, 1, "<||>\n<|end|>\n"), (5, 2, 1, "<|user|>\nhi<|end|>\n<|bot|>\nno<|end|>\n"), (None, 1, 1, "<|user|>\nq<|end|>\n")}
    assert snapshots.maximal_conversations(t.limit(0)).count() == 0


def test_main_texts(spark):
    body = "<html><head><title>t</title></head><body><nav>menu</nav><article><h1>A &amp; b</h1><p>one<br>two<p>x&nbsp;y<div class='comments'>c</div></article><footer>f</footer>"
    plain = "<body><p>Shared top</p><p>Own %s</p><p>Shared end</p></body>"
    pages = [(1, "http://h.x/a/1", body), (2, "http://h.x/a/2", plain % "two"), (3, "http://h.x/a/3", plain % "three"), (4, "http://other.x/a", plain % "four"), (5, None, None), (6, "bad", ""), (3, "http://h.x/a/3", plain % "three")]
    out = page_diff.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    got = {(r.page_id, r.text) for r in out}
    assert len(out) == 7 and got == {(1, "A & b\n\none two\n\nx y"), (2, "Own two"), (3, "Own three"), (4, "Shared top\n\nOwn four\n\nShared end"), (5, ""), (6, "")}
    a, b = list("xabcbdab"), list("bdcaba")
    assert len(page_diff.common(a, b)) == 4
