"""Token-ID output: flat unsigned integer files with 64-bit document offsets, memory-mapped by readers.

Documents are dealt by ranges of their id, so shard k holds the k-th range in order. Each task encodes its range and
writes three flat files: ``<shard>.ids`` (16 or 32 bit unsigned, by vocabulary size), ``<shard>.offsets``
(little-endian int64, start of each document within the shard and, last, the end) and ``<shard>.docs``
(int64 document ids; the smallest int64 stands for null). A shard's base is the prefix sum of the shards before it.
"""
from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pathscreen.llm.byte_pairs import PIECE, Remembered
from pathscreen.llm.common import pieces, text_key
from pathscreen.session import checkpoint_dir
from pathscreen.staging import stage

NO_ID = -(2**63)
SHARD = "shard long, docs long, tokens long, width int"


class Encoder:
    """Ids of texts by the tokenizers library. Text is cut where no pre-token of a byte-level vocabulary crosses, and each distinct
    piece is encoded once per worker; a text with a string of an added token goes to the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task is one core
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.code = "H" if self.library.get_vocab_size() <= 65536 else "I"
        self.width = array(self.code).itemsize
        added = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.known = Remembered()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [None if self.added and self.added.search(t) else PIECE.findall(t) for t in texts]
        new = list({x for c in cut if c for x in c}.difference(self.known))
        self.known.add(dict(zip(new, self._whole(new), strict=True)))
        return [self._whole([t])[0] if c is None else b"".join(map(self.known.__getitem__, c)) for t, c in zip(texts, cut, strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def _put(store: pafs.FileSystem, temporary: str, name: str) -> None:
    """Attempts of a task write the same bytes; the last to end stays."""
    if not isinstance(store, pafs.LocalFileSystem) and store.get_file_info(name).type == pafs.FileType.File:
        store.delete_file(name)
    store.move(temporary, name)


def _write(folder: str, vocabulary: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    shard, own = task.partitionId(), f"-{task.taskAttemptId()}-{uuid.uuid4().hex}"
    store, at = _store(folder)
    code, names = encoder(vocabulary), {k: f"{at}/{shard:08d}.{k}" for k in ("ids", "offsets", "docs")}
    end, total, docs = array(code.code, [end_id]).tobytes(), 0, 0
    store.create_dir(at, recursive=True)
    files = {k: store.open_output_stream(n + own) for k, n in names.items()}
    for batch in pieces(batches):
        ids = [x + end for x in code.encode([t or "" for t in batch.column("text").to_pylist()])]
        sizes = np.fromiter((len(x) // code.width for x in ids), np.int64, len(ids))
        files["ids"].write(b"".join(ids))
        files["offsets"].write((total + np.cumsum(sizes) - sizes).astype("<i8").tobytes())
        files["docs"].write(batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        total += int(sizes.sum())
        docs += len(ids)
    files["offsets"].write(np.array([total], "<i8").tobytes())
    for k, f in files.items():
        f.close()
        if docs:
            _put(store, names[k] + own, names[k])
        else:
            store.delete_file(names[k] + own)
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([docs]), pa.array([total]), pa.array([code.width], pa.int32())], names=["shard", "docs", "tokens", "width"])


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None) -> tuple[str, DataFrame]:
    """(folder, manifest): files as above and one manifest row per shard: shard, docs, tokens, width, base, doc_base.

    ``docs(doc_id, text)`` with an integer id; ids ascend (null first), rows that repeat an id go by the hash of their text. A null or
    empty text is its end id alone. An empty table writes no files. ``folder``: on a file system that all machines
    share, by default within spark.checkpoint.dir. Runs a job; a retried task writes the same bytes under the same name.
    """
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = [F.col("doc_id").asc_nulls_first(), text_key(F.col("text")).asc()]
    shards = stage(rows.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(partial(_write, folder, vocabulary, end_id), SHARD))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    manifest = shards.select("*", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("doc_base"))
    return folder, stage(manifest)


def _map(store: pafs.FileSystem, name: str, kind: str) -> np.ndarray:
    """Memory map where the file system is local to the machine or mounted, else the file's bytes."""
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(name, dtype=kind, mode="r")
    with store.open_input_file(name) as f:
        return np.frombuffer(f.read(), kind)


def _read(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, at = _store(folder)
    for batch in batches:
        for row in batch.to_pylist():
            name = f"{at}/{row['shard']:08d}"
            ids, offsets, docs = _map(store, f"{name}.ids", f"<u{row['width']}"), _map(store, f"{name}.offsets", "<i8"), _map(store, f"{name}.docs", "<i8")
            for first in range(0, len(docs), 10_000):
                own = np.asarray(docs[first:first + 10_000])
                cut = np.asarray(offsets[first:first + len(own) + 1])
                sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == NO_ID), pa.array(row["base"] + cut[:-1]), pa.array(np.diff(cut)), pa.array(sums, pa.int64())],
                                                 names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files; one task maps one shard at a time."""
    dealt = manifest.repartition(max(1, manifest.count()), "shard")
    return dealt.mapInArrow(partial(_read, folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
