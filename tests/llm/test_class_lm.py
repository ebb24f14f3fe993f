"""Exchange, classes and scores against plain Python."""
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pathscreen.llm import class_lm
from pathscreen.llm.chosen_path import tokens


def plain_texts(n=120, seed=5):
    rng = np.random.default_rng(seed)
    nouns, verbs = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    return [" ".join(w for _ in range(rng.integers(0, 12)) for w in (rng.choice(nouns), rng.choice(verbs))) for _ in range(n)]


def bigrams_of(texts, kind):
    out = np.zeros((class_lm.CLASSES + 1,) * 2)
    for t in texts:
        seq = [0, *(kind[w] for w in tokens(t)), 0]
        for a, b in zip(seq, seq[1:]):
            out[a, b] += 1
    return out


def test_exchange_never_falls(spark):
    rng = np.random.default_rng(1)
    units = 40
    pairs = Counter((int(a), int(b)) for a, b in zip(rng.integers(0, units, 4000), rng.integers(0, units, 4000) // 2 * 2))
    frame = spark.createDataFrame([(a, b, n) for (a, b), n in pairs.items()], "a int, b int, n long")
    kind, got, reached = class_lm.exchange(frame, units, 0, classes=4, rounds=8)
    assert len(reached) == 9 and all(b >= a for a, b in zip(reached, reached[1:])) and reached[-1] > reached[0] and kind[0] == 0
    want = np.zeros((5, 5))
    for (a, b), n in pairs.items():
        want[kind[a], kind[b]] += n
    assert (got == want).all() and math.isclose(class_lm.likelihood(want), reached[-1])


def test_scores_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "UNIT_WORDS", 6)
    monkeypatch.setattr(class_lm, "CACHED", 20)
    texts = [*plain_texts(), "", None, "n1 n1 n1", "never seen words n1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    seen = {}
    learned = class_lm.learned

    def spy(rows):
        out = learned(rows)
        seen["words"] = {bytes(r.word): (r.n, r["class"]) for r in out[0].collect()}
        seen["units"], seen["kind"] = out[1:]
        return out

    monkeypatch.setattr(class_lm, "learned", spy)
    got = {r.doc_id: r for r in class_lm.class_scores(docs, held).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    train = [t for i, t in enumerate(texts) if not out[i]]
    count = Counter(w for t in train for w in [*tokens(t), class_lm.END])
    assert {w: n for w, (n, _) in seen["words"].items()} == dict(count)  # every training word has a class of its own
    kind = {w: k for w, (_, k) in seen["words"].items()}
    of = lambda w: kind[w] if w in kind else seen["kind"][seen["units"].ending(w)]
    step = class_lm.transitions(bigrams_of(train, kind))
    mass, types = np.zeros(class_lm.CLASSES + 1), np.zeros(class_lm.CLASSES + 1)
    for w, n in count.items():
        mass[kind[w]] += n
        types[kind[w]] += 1
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        words = [*tokens(t), class_lm.END]
        seq = [0, *map(of, words[:-1]), 0]
        want = sum(math.log10((count[w] + 1) / (mass[k] + types[k] + 1)) + step[a, k] for w, a, k in zip(words, seq, seq[1:]))
        r = got[i]
        assert math.isclose(r.score, want, abs_tol=1e-6) and r.held_out == out[i] and r.n_tokens == len(words) and r.n_known == sum(w in count for w in words)
        assert math.isclose(r.perplexity, 10 ** (-want / len(words)), rel_tol=1e-6)
    # a word that is no unit of its own has the class that its neighbours make most likely
    units = {w: seen["kind"][seen["units"][w]] for w in kind}
    pairs = bigrams_of(train, units)
    before = {w: np.zeros(len(pairs)) for w in kind}
    after = {w: np.zeros(len(pairs)) for w in kind}
    for t in train:
        seq = [class_lm.END, *tokens(t), class_lm.END]
        for a, b in zip(seq, seq[1:]):
            before[b][units[a]] += 1
            after[a][units[b]] += 1
    given = lambda p: np.log((p + (p.sum(axis=0) + 1) / (p.sum() + len(p))) / (p.sum(axis=1, keepdims=True) + 1))
    for w in kind.keys() - seen["units"].keys():
        fit = given(pairs.T) @ before[w] + given(pairs) @ after[w]
        assert fit[kind[w]] >= fit[1:].max() - 1e-9


def test_flat_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "UNIT_WORDS", 300)
    counts = spark.createDataFrame([(bytearray(f"w{i}".encode()), 3) for i in range(1000)], "word binary, n long")
    chosen = class_lm.most_frequent(counts, 300)
    assert 250 < chosen.count() <= 300 and class_lm.most_frequent(counts, 1000).count() == 1000
    assert class_lm.most_frequent(counts.unionByName(spark.createDataFrame([(bytearray(b"top"), 99)], counts.schema)), 300).where("n = 99").count() == 1
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in rng.permutation(1000))) for i in range(8)], "doc_id long, text string")
    words, units, _ = class_lm.learned(docs.select("text"))
    assert words.count() == 1001 and 250 < units.base <= 301


def test_encoded_words():
    texts = ["", None, "  a B\tc d \x1c e\x1df\x85 i\x0bj\x0ck\r\nl ", " Ä É ", "z", "a a"]
    ids, words, sizes = class_lm.encoded(pa.array(texts))
    found = words.to_pylist()
    assert [found[i] for i in ids] == [w for t in texts for w in tokens(t)] and sizes.tolist() == [len(tokens(t)) for t in texts]
    assert class_lm.with_ends(ids, sizes, -1).tolist() == [-1, *(x for t in texts for x in [*(found.index(w) for w in tokens(t)), -1])]
    assert [len(x) for x in class_lm.encoded(pa.array([], pa.string()))] == [0, 0, 0]
