"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive benchmark words. A shift table over two-word blocks says how far the search may
jump: a block that no pattern holds lets it jump over almost a whole window. At shift 0 the block is the end of
some pattern; the bucket of that block, split by the pattern's first word, holds the candidates, and a direct
comparison confirms. The benchmark is compiled in blocks of bounded size, each broadcast and run over all documents.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pathscreen.llm.common import pieces
from pathscreen.staging import stage

WINDOW = 10
BLOCK = 100_000   # (window, item) pairs compiled and broadcast at a time: about 10 MB
RESULT = "_leak"  # column of the search's result
RESULT_TYPE = T.StructType([T.StructField("n_words", T.LongType()),
                            T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))),
                            T.StructField("items", T.ArrayType(T.StringType()))])
_SPACED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_list(text: str | None) -> list[bytes]:
    """A-Z lowered; words of digits, letters and everything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_SPACED).split() if text else []


class Patterns:
    """Shift table, suffix buckets and patterns of lengths from ``least`` up."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str]]):
        self.items = windows
        self.least = min(map(len, windows))
        self.block = min(2, self.least)
        self.jump = self.least - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for p in windows:
            for end in range(self.block, self.least + 1):
                key = p[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.jump), self.least - end)
            self.bucket.setdefault(p[self.least - self.block:self.least], {}).setdefault(p[0], []).append(p)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(start, pattern) of every occurrence."""
        shift, bucket, jump, least, block, n = self.shift, self.bucket, self.jump, self.least, self.block, len(words)
        end = least
        while end <= n:
            key = (words[end - 2], words[end - 1]) if block == 2 else (words[end - 1],)
            far = shift.get(key, jump)
            if far:
                end += far
                continue
            start = end - least
            for p in bucket[key].get(words[start], ()):
                if tuple(words[start:start + len(p)]) == p:
                    yield start, p
            end += 1


def compiled(pairs: list[tuple[str, str]]) -> list[Patterns]:
    """Full windows and shorter items apart, so that a short item doesn't shorten the jumps of the others."""
    by_size: dict[bool, dict] = {}
    for window, item in pairs:
        key = tuple(window.encode("utf-8", "surrogatepass").split())
        by_size.setdefault(len(key) < WINDOW, {}).setdefault(key, []).append(item)
    return [Patterns(w) for w in by_size.values()]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def item_windows(items: DataFrame) -> DataFrame:
    """Distinct (window, item): windows of 10 words of each item, a shorter item whole; a null id is the empty string."""
    def rows(batches):
        for batch in pieces(batches):
            windows, ids = [], []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = word_list(text)
                for at in range(max(1, len(found) - WINDOW + 1) if found else 0):
                    windows.append(b" ".join(found[at:at + WINDOW]).decode("utf-8", "surrogatepass"))
                    ids.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.string()), pa.array(ids, pa.string())], names=["window", "item"])
    plain = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(rows, "window string, item string").distinct()


def _search(tables, kind: pa.DataType, text: str):
    def rows(batches):
        machines = tables.value
        for batch in pieces(batches, text):
            out = []
            at = batch.schema.get_field_index(RESULT)
            for body, had in zip(batch.column(text).to_pylist(), batch.column(at).to_pylist(), strict=True):
                found = word_list(body)
                spans, items = [(s["first"], s["end"]) for s in had["spans"]], set(had["items"])
                for m in machines:
                    for start, p in m.find(found):
                        spans.append((start, start + len(p)))
                        items.update(m.items[p])
                out.append({"n_words": len(found), "spans": [{"first": a, "end": b} for a, b in merged(spans)], "items": sorted(items)})
            yield pa.RecordBatch.from_arrays([pa.array(out, kind) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)
    return rows


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``_leak``: n_words, spans (word positions inside occurrences, merged) and items
    (ids as strings, sorted) whose windows occur.

    ``items(item_id, text)``. Runs a job over the benchmark. Null or empty texts have no words and no spans; items
    without words match nothing; an empty benchmark finds nothing; repeated rows are searched each; repeated items count
    once by id; other columns pass through, one named like the result is replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    spark, docs = docs.sparkSession, docs.drop(RESULT)
    pairs = stage(item_windows(items))
    blocks = -(-pairs.count() // BLOCK)
    none = F.struct(F.lit(0).cast("long").alias("n_words"), F.array().cast(RESULT_TYPE["spans"].dataType).alias("spans"), F.array().cast("array<string>").alias("items"))
    out = docs.withColumn(RESULT, none)
    schema = T.StructType([*docs.schema.fields, T.StructField(RESULT, RESULT_TYPE)])
    for b in range(max(1, blocks)):
        held = pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(max(1, blocks))) == b).collect()  # at most about BLOCK short rows
        tables = spark.sparkContext.broadcast(compiled([(r.window, r.item) for r in held]))
        out = out.mapInArrow(_search(tables, to_arrow_type(RESULT_TYPE), text), schema)
    return out
