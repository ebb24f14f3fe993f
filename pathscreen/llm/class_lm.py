"""Class-based n-gram scores (Brown et al.): P(word | previous) = P(class | previous class) * P(word | class).

1. The most frequent words (``UNIT_WORDS``) and one unit for all rarer words of an ending are clustered by exchange: units move to the class that
   raises the class-bigram likelihood most, by the counts of their neighbours' classes. A hashed part of the units moves at a time; the likelihood of
   the whole is compared, and a round that lowers it is taken back and the part halved. So it never falls.
2. Every other training word gets a class of its own: the one that its own neighbours' classes make most likely. The classes lie in a
   table (word, n, class) that grows with the corpus; endings only decide for words that training never saw.
3. Class bigrams are counted over all training bigrams under these classes.

Only tables of a fixed size are broadcast: units, and classes and counts of the ``CACHED`` most frequent words. Rarer words get theirs by a join.
"""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from pathscreen.llm.common import pieces
from pathscreen.staging import stage

CLASSES = 48        # besides the end, which is class 0
UNIT_WORDS = 4096   # words that are exchanged one by one
ENDINGS = 1024      # units of rarer words, by hashed last three bytes
ROUNDS = 10
CACHED = 240_000    # words whose classes and counts are broadcast
KEEP = 0.95         # weight of class bigrams against class unigrams
END = b"\n"         # no word holds it
FLUSH = 300_000     # rows of a batch of pairs
PIECE = 4_000_000   # bytes of text that a task holds as words while it counts
READ = 4_000_000    # the same beside the cached words
PAIRS = 2_000_000   # different pairs that a task holds before it hands them on
SHARES = 64         # partitions of the units
LEVELS, PARTS = 16, 4096  # frequency levels an octave, and hashed parts of one level


class Units(dict):
    """Unit numbers: words of their own first, then endings."""

    def __init__(self, words: list[bytes]):
        super().__init__({w: i for i, w in enumerate(words)})
        self.base = len(self)

    def ending(self, word: bytes) -> int:
        return self.base + zlib.crc32(word[-3:]) % ENDINGS

    __missing__ = ending


class Cached(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


def encoded(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(word number of every token, the different words, tokens of each text). Words are those of ``tokens``; null and empty texts have none."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    sizes, words = np.diff(split.offsets.to_numpy()).astype(np.int64), split.flatten()
    some = pc.not_equal(words, "")  # white space at either end of a text leaves an empty word
    if pc.all(some).as_py() is False:
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes), some.to_numpy(zero_copy_only=False), len(sizes)).astype(np.int64)
        words = words.filter(some)
    found = words.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary.cast(pa.binary()), sizes


def with_ends(values: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """The values of texts of these sizes with ``end`` before the first and after each."""
    return np.insert(values, np.concatenate([[0], np.cumsum(sizes)]), end)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, most=PIECE):
        ids, words, sizes = encoded(batch.column("text"))
        n = np.bincount(ids, minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([END], pa.binary())]), pa.array(np.append(n, len(sizes)))], names=["word", "n"])


def _pair_rows(wide: int, codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(codes), FLUSH):
        part = codes[i:i + FLUSH]
        yield pa.RecordBatch.from_arrays([pa.array((part // wide).astype(np.int32)), pa.array((part % wide).astype(np.int32)), pa.array(n[i:i + FLUSH])], names=["a", "b", "n"])


def _count_pairs(units, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = units.value
    end, wide = known[END], known.base + ENDINGS
    codes, n = np.zeros(0, np.int32), np.zeros(0, np.int64)  # wide squared fits into 32 bits
    for batch in pieces(batches, most=PIECE):
        ids, words, sizes = encoded(batch.column("text"))
        of = np.fromiter(map(known.__getitem__, words.to_pylist()), np.int32, len(words))
        flat = with_ends(of[ids], sizes, end)
        new, times = np.unique(flat[:-1] * np.int32(wide) + flat[1:], return_counts=True)
        codes, at = np.unique(np.concatenate([codes, new]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n, times]), len(codes)).astype(np.int64)
        if len(codes) > PAIRS:
            yield from _pair_rows(wide, codes, n)
            codes, n = codes[:0], n[:0]
    yield from _pair_rows(wide, codes, n)


def _f(x):
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-9)), 0.0)


def likelihood(bigrams: np.ndarray) -> float:
    """The part of the class-bigram log likelihood that depends on the classes."""
    return float(_f(bigrams).sum() - _f(bigrams.sum(axis=0)).sum() - _f(bigrams.sum(axis=1)).sum())


def _of(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(side, other unit, count) of the unit in row i of ``adjacent``."""
    near = batch.column("near")
    a, b = near.offsets[i].as_py(), near.offsets[i + 1].as_py()
    return tuple(near.values.field(name).slice(a, b - a).to_numpy() for name in ("side", "other", "n"))


def _bigrams(classes: int, kind, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class bigrams (code, n) of a task's rows of ``adjacent``."""
    of, total = kind.value, np.zeros(classes * classes)
    for batch in batches:
        for i, unit in enumerate(batch.column("unit").to_pylist()):
            side, other, n = _of(batch, i)
            first = side > 0  # the unit's own bigrams as the first of both; those as the second are counted at the other unit
            at = of[unit] * classes
            total[at:at + classes] += np.bincount(of[other[first]], n[first], classes)
    codes = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(total[codes].astype(np.int64))], names=["code", "n"])


def _move(classes: int, shared, turn: int, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best class of each unit of this turn's part, by its rows of ``adjacent``."""
    of, pair = shared.value  # classes of the units, class bigrams
    left, right = pair.sum(axis=1), pair.sum(axis=0)
    for batch in batches:
        units, out = [], []
        for i, unit in enumerate(batch.column("unit").to_pylist()):
            at = int(of[unit])
            if at == 0 or zlib.crc32(f"{unit} {turn}".encode()) % parts:
                continue
            side, other, n = _of(batch, i)
            l, r = (np.bincount(of[other[side == x]], n[side == x], classes) for x in (0, 1))
            own = float(n[side == 2].sum())
            n_first, n_second = r.sum() + own, l.sum() + own
            # without the unit
            p = pair.copy()
            p[:, at] -= l
            p[at, :] -= r
            p[at, at] -= own
            a, b = left.copy(), right.copy()
            a[at] -= n_first
            b[at] -= n_second
            # gain of adding it to each class k; its own bigrams join the pair (k, k)
            f = _f(p)
            gain = (_f(p + l[:, None]) - f).sum(axis=0) + (_f(p + r[None, :]) - f).sum(axis=1)
            d = np.diagonal(p)
            gain += _f(d + l + r + own) - _f(d + l) - _f(d + r) + _f(d)
            gain -= _f(a + n_first) - _f(a) + _f(b + n_second) - _f(b)
            gain[0] = -np.inf
            best = int(gain.argmax())
            if gain[best] > gain[at] + 1e-9:
                units.append(unit)
                out.append(best)
        yield pa.RecordBatch.from_arrays([pa.array(units, pa.int32()), pa.array(out, pa.int32())], names=["unit", "class"])


def adjacent(pairs: DataFrame) -> DataFrame:
    """(unit, near), written: all neighbours of a unit, to its left (side 0), to its right (1) and itself (2). A unit has at most one of each unit and side."""
    other = pairs.where("a != b")
    sides = (other.select(F.col("b").alias("unit"), F.lit(0).cast("tinyint").alias("side"), F.col("a").alias("other"), "n")
             .unionByName(other.select(F.col("a").alias("unit"), F.lit(1).cast("tinyint").alias("side"), F.col("b").alias("other"), "n"))
             .unionByName(pairs.where("a = b").select(F.col("a").alias("unit"), F.lit(2).cast("tinyint").alias("side"), F.col("b").alias("other"), "n")))
    return stage(sides.repartition(SHARES, "unit").groupBy("unit").agg(F.collect_list(F.struct("side", "other", "n")).alias("near")))


def exchange(pairs: DataFrame, units: int, ended: int, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[list[int], np.ndarray, list[float]]:
    """(class of every unit, class bigrams, likelihood after each round) from ``pairs(a, b, n)``. Neighbours are grouped by unit once; a round reads them
    twice without a shuffle. The driver holds one number per unit and the class bigrams, both of fixed size."""
    spark, near = pairs.sparkSession, adjacent(pairs)

    def bigrams(kind: np.ndarray) -> np.ndarray:
        out = np.zeros((classes + 1) ** 2)
        counted = near.mapInArrow(partial(_bigrams, classes + 1, spark.sparkContext.broadcast(kind)), "code int, n long")
        for r in counted.groupBy("code").agg(F.sum("n").alias("n")).collect():  # at most (classes + 1) squared
            out[r.code] = r.n
        return out.reshape(classes + 1, classes + 1)

    kind = np.array([0 if u == ended else 1 + u % classes for u in range(units)])
    p = bigrams(kind)
    reached, parts = [likelihood(p)], 2
    for turn in range(rounds):
        moved = kind.copy()
        shared = spark.sparkContext.broadcast((kind, p))
        for r in near.mapInArrow(partial(_move, classes + 1, shared, turn, parts), "unit int, class int").collect():  # at most one small row per unit
            moved[r.unit] = r["class"]
        if (moved != kind).any():
            q = bigrams(moved)
            if likelihood(q) > reached[-1]:
                kind, p = moved, q
            else:
                parts *= 2
        reached.append(likelihood(p))
    return kind.tolist(), p, reached


def packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary value of the bytes of ``values[starts[i]:starts[i + 1]]`` for each i."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, how many per row) of a column of ``packed``."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]].view(kind), np.diff(at) // np.dtype(kind).itemsize


def _near_words(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per piece and word that is no unit of its own: packed codes (1 byte) and counts (4 bytes). Code: class of the left neighbour's unit, or
    CLASSES + 1 more for the right one's."""
    units, kind = shared.value
    classes, wide = np.array(kind, np.int64), 2 * (CLASSES + 1)
    for batch in pieces(batches, most=PIECE):
        ids, words, sizes = encoded(batch.column("text"))
        of = np.fromiter(map(units.__getitem__, words.to_pylist()), np.int64, len(words))
        around = with_ends(classes[of][ids], sizes, 0)
        rare = np.flatnonzero((of >= units.base)[ids])
        place = rare + 1 + np.repeat(np.arange(len(sizes)), sizes)[rare]  # in ``around``
        codes, n = np.unique(np.concatenate([ids[rare] * wide + around[place - 1], ids[rare] * wide + CLASSES + 1 + around[place + 1]]), return_counts=True)
        word, starts = np.unique(codes // wide, return_index=True)
        starts = np.append(starts, len(codes))
        yield pa.RecordBatch.from_arrays([words.take(pa.array(word)), packed((codes % wide).astype("u1"), starts), packed(n.astype("<i4"), starts)], names=["word", "codes", "n"])


def _assign(weights: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, class) from rows of ``_near_words`` sorted by word: the class with the largest sum of weights over the word's neighbours."""
    wide = len(weights)

    def out(words: pa.Array, counts: np.ndarray):
        best = 1 + (counts @ weights).argmax(axis=1)
        return pa.RecordBatch.from_arrays([words, pa.array(counts[:, :wide // 2].sum(axis=1).astype(np.int64)), pa.array(best.astype(np.int32))], names=["word", "n", "class"])

    last, carry = None, np.zeros(wide)
    for batch in batches:
        if not batch.num_rows:
            continue
        words = batch.column("word")
        new = np.concatenate([[words[0].as_py() != last], pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)]).astype(bool)
        group = np.cumsum(new) - int(new[0])
        if new[0] and last is not None:
            yield out(pa.array([last], words.type), carry[None, :])
        (codes, sizes), (n, _) = unpacked(batch.column("codes"), "u1"), unpacked(batch.column("n"), "<i4")
        counts = np.bincount(np.repeat(group, sizes) * wide + codes, n, minlength=(group[-1] + 1) * wide).reshape(-1, wide)
        if not new[0]:
            counts[0] += carry
        firsts = np.searchsorted(group, np.arange(group[-1] + 1))
        last, carry = words[len(words) - 1].as_py(), counts[-1].copy()
        if len(counts) > 1:
            yield out(words.take(pa.array(firsts[:-1])), counts[:-1])
    if last is not None:
        yield out(pa.array([last], pa.binary()), carry[None, :])


def assigned(texts: DataFrame, units: Units, kind: list[int], bigrams: np.ndarray) -> DataFrame:
    """(word, n, class) of every word that is no unit of its own. A class's weight for a word is the log probability of the
    word's neighbours given the class, which to first order is what the word adds to the likelihood there."""
    def given(rows: np.ndarray) -> np.ndarray:
        """log probability of the other class (second axis) given the word's class (first axis); a class that was hardly seen gives the overall shares."""
        overall = (rows.sum(axis=0) + 1) / (rows.sum() + len(rows))
        return np.log((rows + overall) / (rows.sum(axis=1, keepdims=True) + 1))

    weights = np.concatenate([given(bigrams.T).T, given(bigrams).T])[:, 1:]
    shared = texts.sparkSession.sparkContext.broadcast((units, kind))
    near = texts.mapInArrow(partial(_near_words, shared), "word binary, codes binary, n binary")
    return near.repartition("word").sortWithinPartitions("word").mapInArrow(partial(_assign, weights), "word binary, n long, class int")


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """Rows of at most ``most`` words of ``counts(word, n)``, the most frequent ones; in the last level of frequencies those of the lowest hashes."""
    level, part = F.floor(F.log2("n") * LEVELS).cast("int"), F.pmod(F.crc32("word"), F.lit(PARTS)).cast("int")
    held = 0
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():  # at most 64 octaves
        if held + r.words > most:
            break
        held += r.words
    else:
        return counts
    for q in counts.where(level == r.level).groupBy(part.alias("part")).agg(F.count("*").alias("words")).orderBy("part").collect():  # at most PARTS rows
        if held + q.words > most:
            break
        held += q.words
    return counts.where((level > r.level) | (level == r.level) & (part < q.part))


class Reader:
    """What a task needs to read a text as classes; every part has a fixed bound."""

    def __init__(self, cached: list, units: Units, kind: list[int]):
        self.at = Cached({bytes(r.word): i for i, r in enumerate(cached)})
        self.kind = np.array([r["class"] for r in cached] + [-1], np.int64)
        self.logs = np.array([math.log10(r.n + 1) for r in cached] + [0.0])
        self.units, self.unit_kind = units, kind


def _read(reader, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: tokens and known words without the end, log10(count + 1) of cached words, class bigrams (codes, times) of which both sides are cached,
    and every other word with its place, the classes before and after it (-1: not cached) and the class of its ending."""
    m, wide = reader.value, CLASSES + 1
    for batch in pieces(batches, most=READ):
        ids, found, sizes = encoded(batch.column("text"))
        different = found.to_pylist()
        at = np.fromiter(map(m.at.__getitem__, different), np.int64, len(different))
        ending = np.fromiter((0 if i >= 0 else m.unit_kind[m.units.ending(w)] for w, i in zip(different, at.tolist())), np.int32, len(different))
        text = np.repeat(np.arange(len(sizes)), sizes)
        kinds = with_ends(m.kind[at][ids], sizes, 0)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        other = np.flatnonzero((at < 0)[ids])
        place = other + 1 + text[other]  # in ``kinds``
        rests = np.bincount(text[other], minlength=len(sizes))
        a, b = kinds[:-1], kinds[1:]
        steps = np.where((a >= 0) & (b >= 0), a * wide + b, wide * wide)
        codes, times = [], []
        for i in range(len(sizes)):
            n = np.bincount(steps[ends[i] + i:ends[i + 1] + i + 1], minlength=wide * wide + 1)[:-1]
            some = np.flatnonzero(n)
            codes.append(some)
            times.append(n[some])
        lists = lambda parts, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(parts)]).astype(np.int32)), values)
        many = [len(c) for c in codes]
        rest = pa.StructArray.from_arrays([pa.array((other - ends[text[other]]).astype(np.int32)), pa.array(kinds[place - 1].astype(np.int32)), pa.array(kinds[place + 1].astype(np.int32)),
                                           found.take(pa.array(ids[other])), pa.array(ending[ids[other]])], names=["place", "before", "after", "word", "ending"])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(sizes), pa.array(sizes - rests), pa.array(np.bincount(text, m.logs[at][ids], len(sizes)).astype(float)),  # of no tokens at all, numpy counts in integers
             lists(many, pa.array(np.concatenate(codes).astype(np.int32))), lists(many, pa.array(np.concatenate(times).astype(np.int64))), lists(rests, rest)],
            names=["doc_id", "held_out", "words", "known", "logs", "codes", "times", "rest"])


def _steps(value: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = batch.column("codes")
        n = batch.column("times").flatten().to_numpy() if "times" in batch.schema.names else 1
        rows = np.repeat(np.arange(batch.num_rows), np.diff(codes.offsets.to_numpy()))
        total = np.bincount(rows, value[codes.flatten().to_numpy()] * n, minlength=batch.num_rows)
        keep = [name for name in batch.schema.names if name not in ("codes", "times")]
        yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in keep), pa.array(total.astype(float))], names=[*keep, "steps"])


def learned(texts: DataFrame) -> tuple[DataFrame, Units, list[int]]:
    """The table (word, n, class) of all words of ``texts(text)``, END for the end included; units and their classes, for words it lacks."""
    spark = texts.sparkSession
    counts = stage(texts.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"))
    frequent = {bytes(r.word): r.n for r in most_frequent(counts, UNIT_WORDS).unionByName(counts.where(F.col("word") == END)).collect()}  # at most UNIT_WORDS + 1
    units = Units(sorted(frequent.keys() | {END}, key=lambda w: (-frequent.get(w, 0), w)))
    pairs = stage(texts.mapInArrow(partial(_count_pairs, spark.sparkContext.broadcast(units)), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))
    kind, bigrams, _ = exchange(pairs, units.base + ENDINGS, units[END])
    first = spark.createDataFrame([(bytearray(w), n, kind[units[w]]) for w, n in frequent.items()], "word binary, n long, class int")
    return stage(assigned(texts, units, kind, bigrams).unionByName(first)), units, kind


def class_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every whole text of ``docs(doc_id, text)``.

    The model learns from the rows where ``held_out`` is false. Null or empty texts are the end token alone. base_score: add-one unigrams. score:
    log10 probability by the class bigrams; a class keeps one place for words that were never seen. perplexity: 10 to the power of -score per token.
    No training rows: counts are 0 and scores are those of the smoothing alone. Repeated rows count each; words of equal frequency are
    ordered by hash, so a flat vocabulary is clustered as well; an empty table gives an empty result; other columns are not read. Runs jobs.
    """
    spark, wide = docs.sparkSession, CLASSES + 1
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    vocabulary, units, kind = learned(rows.where(~F.col("held_out")).select("text"))
    cached = spark.sparkContext.broadcast(Reader(most_frequent(vocabulary, CACHED).collect(), units, kind))  # at most CACHED rows
    doc_id = rows.schema["doc_id"].dataType.simpleString()
    read = rows.mapInArrow(partial(_read, cached), f"doc_id {doc_id}, held_out boolean, words long, known long, logs double, codes array<int>, times array<long>, "
                           "rest array<struct<place:int,before:int,after:int,word:binary,ending:int>>")
    read = stage(read.withColumn("row", F.monotonically_increasing_id()))  # written, so the number of a row stays

    rest = read.select("row", "held_out", F.explode("rest").alias("x")).select("row", "held_out", "x.*").join(vocabulary, "word", "left")
    rest = rest.select("row", "held_out", "place", "before", "after", F.coalesce("class", "ending").alias("own"), F.coalesce("n", F.lit(0)).alias("n"))
    previous = F.lag("own").over(Window.partitionBy("row").orderBy("place"))  # one document's words; the one before is not cached either, so it is here
    into = F.when(F.col("before") >= 0, F.col("before")).otherwise(previous) * wide + F.col("own")
    both = F.when(F.col("after") >= 0, F.array(into, F.col("own") * wide + F.col("after"))).otherwise(F.array(into))
    rest = stage(rest.select("row", "held_out", "n", both.alias("codes")).groupBy("row", "held_out").agg(  # the rows of a document are together already
        F.sum((F.col("n") > 0).cast("long")).alias("more_known"), F.sum(F.log10(F.col("n") + 1)).alias("more_logs"), F.flatten(F.collect_list("codes")).alias("codes")))

    pairs = (read.where(~F.col("held_out")).select(F.explode(F.arrays_zip("codes", "times")).alias("x")).select(F.col("x.codes").alias("code"), F.col("x.times").alias("n"))
             .unionByName(rest.where(~F.col("held_out")).select(F.explode("codes").alias("code"), F.lit(1).cast("long").alias("n"))))
    bigrams = np.zeros(wide * wide)
    for r in pairs.groupBy("code").agg(F.sum("n").alias("n")).collect():  # at most (CLASSES + 1) squared
        bigrams[r.code] = r.n
    mass, types, ends = np.zeros(wide), np.zeros(wide), 0
    for r in vocabulary.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("types"), F.max(F.when(F.col("word") == END, F.col("n"))).alias("ends")).collect():  # a row per class
        mass[r["class"]], types[r["class"]], ends = r.n, r.types, max(ends, r.ends or 0)
    total, v = int(mass.sum()), int(types.sum())
    value = (transitions(bigrams.reshape(wide, wide)) - np.log10(mass + types + 1)).ravel()  # by the code of a bigram; each token is the second of one

    more = rest.drop("held_out").mapInArrow(partial(_steps, value), "row long, more_known long, more_logs double, more_steps double")
    out = read.select("row", "doc_id", "held_out", "words", "known", "logs", "codes", "times").mapInArrow(
        partial(_steps, value), f"row long, doc_id {doc_id}, held_out boolean, words long, known long, logs double, steps double").join(more, "row", "left")
    n_tokens, logs = F.col("words") + 1, F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + F.lit(math.log10(ends + 1))
    score = logs + F.col("steps") + F.coalesce("more_steps", F.lit(0.0))
    return out.select("doc_id", "held_out", n_tokens.alias("n_tokens"), (F.col("known") + F.coalesce("more_known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
                      F.lit(total).cast("long").alias("train_tokens"), (logs - n_tokens * math.log10(total + v + 1)).alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / n_tokens).alias("perplexity"))


def transitions(bigrams: np.ndarray) -> np.ndarray:
    """log10 probability of the second class after the first, mixed with that of the second alone."""
    single = (bigrams.sum(axis=0) + 1) / (max(1.0, bigrams.sum()) + len(bigrams))
    rows = bigrams.sum(axis=1, keepdims=True)
    seen = np.divide(bigrams, rows, out=np.tile(single, (len(bigrams), 1)), where=rows > 0)
    return np.log10(KEEP * seen + (1 - KEEP) * single)
