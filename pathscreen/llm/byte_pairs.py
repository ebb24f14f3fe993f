"""Token counts of a byte-level BPE by rank-synchronous array merging.

Pre-tokens lie in ragged numpy arrays (symbols end to end, with the start of each). In every step each sequence
finds the lowest rank among its neighbouring pairs and merges all places of that pair at once; sequences without a
known pair are done, and the symbols that are left are the tokens.
"""
from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from pathscreen.llm.common import pieces

KEPT = 400_000  # counts of text pieces that a worker remembers
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# The public pre-token pattern of this family of vocabularies, with Unicode's white space spelled out.
PRE_TOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Pieces that no pre-token crosses: a run of other characters with the space before it, or white space.
PIECE = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class Merges:
    """Merge table of a vocabulary file; pairs are found by binary search in their sorted codes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        ids, merges = file["model"]["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        self.special = [t["content"] for t in file.get("added_tokens", [])]
        shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
        names = {c: chr(c) for c in shown} | {c: chr(256 + i) for i, c in enumerate(c for c in range(256) if c not in shown)}
        self.byte = np.array([ids[names[c]] for c in range(256)], np.int64)
        self.base = max(ids.values()) + 1
        codes = np.array([ids[a] * self.base + ids[b] for a, b in merges], np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.rank = codes[order], order
        self.result = np.array([ids[a + b] for a, b in merges], np.int64)[order]

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols that are left of each pre-token (none empty)."""
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        out, active = np.ones(len(tokens), np.int64), np.arange(len(tokens))
        symbols = self.byte[np.frombuffer(b"".join(tokens), np.uint8)]
        none = len(self.codes)
        while len(symbols):
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            code = np.empty(len(symbols), np.int64)
            code[:-1] = symbols[:-1] * self.base + symbols[1:]
            code[starts + sizes - 1] = -1
            at = np.minimum(np.searchsorted(self.codes, code), none - 1)
            rank = np.where(self.codes[at] == code, self.rank[at], none)
            best = np.minimum.reduceat(rank, starts)
            open_ = best < none
            out[active] = sizes
            hit = (rank == np.repeat(best, sizes)) & np.repeat(open_, sizes)
            # of neighbouring hits (the same symbol in a row) every other one merges, from the left
            where = np.arange(len(hit))
            since = where - np.maximum.accumulate(np.where(hit, -1, where))
            hit &= since % 2 == 1
            symbols = np.where(hit, self.result[at], symbols)
            stays = np.repeat(open_, sizes)
            stays[1:] &= ~hit[:-1]
            sizes = np.add.reduceat(stays, starts)[open_]
            symbols, active = symbols[stays], active[open_]
        return out


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


class Remembered(dict):
    """Results by piece; beyond KEPT a new one is held for its own batch only."""

    def __init__(self):
        super().__init__()
        self.spare: dict = {}

    def __missing__(self, key):
        return self.spare[key]

    def add(self, new: dict) -> None:
        if len(self) < KEPT:
            self.update(new)
            self.spare = {}
        else:
            self.spare = new


_remembered: dict[str, Remembered] = {}


def _count(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, known = merges(path), _remembered.setdefault(path, Remembered())
    split = re.compile("|".join(map(re.escape, sorted(table.special, key=len, reverse=True)))) if table.special else None
    for batch in pieces(batches):
        found, specials, sizes = [], [], []
        for text in batch.column("text"):
            body = text.as_py() or ""
            sizes.append(len(body.encode("utf-8", "surrogatepass")))
            parts = split.split(body) if split else [body]
            specials.append(len(parts) - 1)
            found.append([x for p in parts for x in PIECE.findall(p)])
        new = list({x for f in found for x in f}.difference(known))
        pre = [PRE_TOKEN.findall(x) for x in new]
        flat = list({t for p in pre for t in p})
        if flat:
            count = dict(zip(flat, table.counts([t.encode("utf-8", "surrogatepass") for t in flat]).tolist(), strict=True))
            known.add({x: sum(map(count.__getitem__, p)) for x, p in zip(new, pre, strict=True)})
        n = [sum(map(known.__getitem__, f)) + s for f, s in zip(found, specials, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every whole text of ``docs(doc_id, text)``; one narrow pass, no shuffle.

    ``vocabulary``: path of a byte-level BPE file (JSON with vocab and merges) that every worker can open. Strings of
    added tokens in a text are one token each. Null or empty texts: 0. Repeated rows each get a row; other columns are
    not read.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_count, vocabulary), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
