import numpy as np
import pyarrow as pa

from pathscreen.llm import class_lm as C


class Held:
    def __init__(self, value):
        self.value = value


def test_a_batch_without_tokens_keeps_its_types():
    class Row(dict):
        word, n = C.END, 3

    units = C.Units([C.END])
    reader = C.Reader([Row({"class": 0})], units, [0] * (1 + C.ENDINGS))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([True, False]), pa.array(["", None], pa.string())], names=["doc_id", "held_out", "text"])
    read, = C._read(Held(reader), iter([batch]))
    assert read.schema.field("logs").type == pa.float64() and read.column("logs").to_pylist() == [0.0, 0.0]


def test_pairs_handed_on_early_count_the_same(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 30, 50)) for _ in range(40)]
    units = Held(C.Units([C.END, *(f"w{i}".encode() for i in range(20))]))
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i:i + 10])], names=["text"]) for i in range(0, 40, 10)]

    def counted():
        out = {}
        for b in C._count_pairs(units, iter(batches)):
            for r in b.to_pylist():
                out[r["a"], r["b"]] = out.get((r["a"], r["b"]), 0) + r["n"]
        return out

    whole = counted()
    monkeypatch.setattr(C, "PAIRS", 5)
    assert counted() == whole and sum(whole.values()) == 40 * 51
