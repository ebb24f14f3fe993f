"""The stages of the pipeline in a chain, each against plain Python on what the stage before kept."""
import random
import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from pathscreen.llm.queries import END_ID, vocabulary

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9)))
    page = lambda n: [word() for _ in range(n)]
    items = [" ".join(page(14)), " ".join(page(6)), "", None]
    good = [page(rng.randint(60, 160)) for _ in range(40)]
    rows = [" ".join(p) for p in good]
    for p in good[:5]:  # exact and near copies, in other letters and spaces too
        near = list(p)
        near[rng.randrange(len(p))] = "changed"
        rows += [" ".join(p), " ".join(near), "  ".join(p).upper()]
    for p in good[5:8]:  # a benchmark passage within a document
        rows.append(" ".join(page(40) + [items[0] if p is not good[6] else items[1]] + page(40)))
    rows += ["", None, "too short", "same same same " * 60, "long " + " ".join(page(6000))]
    return rows, items


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def rejected(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(found, found[1:], found[2:]))
    again = len({p for i in range(len(found) - 2) if grams[tuple(found[i:i + 3])] > 1 for p in (i, i + 1, i + 2)})
    return len(found) < 50 or 100 * again > 50 * len(found)


def groups(rows):
    sets = {r.doc_id: {tuple(w[i:i + 5]) for w in [words(r.text)] for i in range(len(w) - 4)} for r in rows}
    of = {d: d for d in sets}

    def top(d):
        while of[d] != d:
            d = of[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                of[top(b)] = top(a)
    return [{d for d in sets if top(d) == t} for t in {top(d) for d in sets}]


def leaks(text, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    found = words(text, pattern)
    for item in items:
        w = words(item, pattern)
        n = min(10, len(w))
        windows = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
        if any(tuple(found[i:i + n]) in windows for i in range(len(found) - n + 1)):
            return True
    return False


def shares(sizes):
    """Targets: 150% of all sizes by weights 5, 2, 1 in the order of sources, at most twice a source's size, the excess shared again."""
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    rest, free, target = 1.5 * sum(sizes.values()), set(sizes), {}
    while free:
        unit = rest / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] > 2 * sizes[s]}
        for s in full or free:
            target[s] = 2 * sizes[s] if full else unit * weight[s]
        rest -= sum(target[s] for s in full)
        free = free - full if full else set()
    return target


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = texts()
    at = tmp_path_factory.mktemp("pipeline")
    docs = [(i, t, "en", (None, "a", "b", "c")[i % 4], None if t is None else len(t)) for i, t in enumerate(rows)]
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_in_a_chain(spark, folder, tmp_path):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        if name != "token output":
            assert docs.columns == names
            given = {tuple(r) for r in before.collect()}
            assert {tuple(r) for r in kept[name]} <= given  # rows go, none is changed
    first = {r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if not rejected(r.text)}
    assert {r.doc_id for r in kept["quality rules"]} == first and len(first) == 59
    near = groups(kept["quality rules"])
    left = {r.doc_id for r in kept["near duplicates"]}
    assert len(near) == 44 and len(kept["near duplicates"]) == len(near) and all(len(g & left) == 1 for g in near)
    clean = {r.doc_id for r in kept["near duplicates"] if not leaks(r.text, items)}
    assert {r.doc_id for r in kept["benchmark decontamination"]} == clean and len(clean) == 41
    size = {r.doc_id: (r.source, len(words(r.text))) for r in kept["benchmark decontamination"]}
    total, took, longest = Counter(), Counter(), Counter()
    for source, n in size.values():
        total[source] += n
        longest[source] = max(longest[source], n)
    copies = Counter(r.doc_id for r in kept["mixing"])
    for d, n in copies.items():
        took[size[d][0]] += n * size[d][1]
    target = shares(dict(total))
    assert max(copies.values()) <= 2 and all(abs(took[s] - target[s]) <= longest[s] for s in total)
    start, want = 0, []
    for r in sorted(kept["mixing"], key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, END_ID]
        want.append((r.doc_id, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in kept["token output"]) == sorted(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, kept["token output"]))  # reruns agree


def test_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
