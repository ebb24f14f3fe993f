"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint becomes 32 counts of set bits, one for each two-bit segment. The Manhattan distance of two such vectors
is at most the number of differing bits. Of two fingerprints that differ in at most 4 bits, one half (16 counts) lies within
Manhattan distance 2. So every fingerprint is posted to the grid cells within distance 1 of each of its halves (25 cells on average): two
halves within distance 2 share a cell half-way, and no link is lost. The members of a cell are then verified on all 64 bits.

Equal fingerprints are one class from the start, so copies never meet. Tasks emit the links that connect a cell's members, not
its pairs. A cell with more members than a fair share of a task (some thousands at most, so the list of them can be broadcast) is dealt out in
chunks; afterwards only members that those links have not joined yet are compared across chunks.

Random fingerprints share a cell with 7 in 100,000 of the others, so comparisons (a few ns each) stay below the rest of the work up to some ten million
distinct fingerprints and grow with the square beyond; no cap or sample hides that.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from pathscreen.llm.common import pieces
from pathscreen.llm.linking import components
from pathscreen.staging import stage

SEED = 42
WIDTH = 4
BITS = 4           # differing bits of a link; the grid is laid out for 4 or fewer
CHUNK = 1024       # members of a heavy cell in one chunk
SHARE = 20_000     # a cell with more than CHUNK members and more than one in so many rows is heavy
_PAIRS = 0x55555555


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """A bit is 1 if it is set in more than half of the hashes of all shingles, repeats included; no words: zero."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # lowers A-Z and splits at the six ASCII spaces only
    if not found:
        return 0
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= width:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = [0, *ends[:-1].tolist()]
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1:] - 1).tolist())), np.uint64, len(found) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at:at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * ones > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        marks = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks)], names=["doc_id", "fp"])


def counts(halves: np.ndarray) -> np.ndarray:
    """Of 32-bit halves the 16 counts of two-bit segments, two bits each."""
    return halves - ((halves >> np.uint64(1)) & np.uint64(_PAIRS))


def around(cells: np.ndarray) -> np.ndarray:
    """(rows, 33): each cell and the cells at Manhattan distance 1, those outside the grid as the largest number."""
    steps = np.arange(16, dtype=np.uint64) * np.uint64(2)
    own = (cells[:, None] >> steps) & np.uint64(3)
    one, none = np.uint64(1) << steps, np.uint64(2**64 - 1)
    return np.concatenate([cells[:, None], np.where(own < 2, cells[:, None] + one, none), np.where(own > 0, cells[:, None] - one, none)], axis=1)


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, fp): every fingerprint in all cells within distance 1 of each half."""
    for whole in batches:
        for at in range(0, whole.num_rows, 8192):
            fp = whole.column("fp")[at:at + 8192].to_numpy(zero_copy_only=False).view(np.uint64)
            for half in (0, 1):
                cells = around(counts((fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)))
                inside = cells != np.uint64(2**64 - 1)
                yield pa.RecordBatch.from_arrays([pa.array((cells[inside] | np.uint64(half << 32)).view(np.int64)), pa.array(np.broadcast_to(fp[:, None], cells.shape)[inside].view(np.int64))], names=["cell", "fp"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, near): the cells within distance 1 of each cell."""
    for batch in batches:
        cell = batch.column("cell").to_numpy(zero_copy_only=False).view(np.uint64)
        near = around(cell & np.uint64(0xFFFFFFFF))
        inside = near != np.uint64(2**64 - 1)
        near |= (cell >> np.uint64(32) << np.uint64(32))[:, None]
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(cell[:, None], near.shape)[inside].view(np.int64)), pa.array(near[inside].view(np.int64))], names=["cell", "near"])


def connecting(node: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked among rows of equal ``node``, which stand together: each member with the first of its component."""
    top = np.arange(len(fp))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    at, step = np.arange(len(fp)), 0
    while len(at):
        step += 1
        at = at[at + step < len(fp)]
        at = at[node[at] == node[at + step]]  # rows further away are in the same node only if these are
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= bits]
        near = near[top[near] != top[near + step]]
        for a in near.tolist():
            one, two = find(a), find(a + step)
            if one != two:
                top[max(one, two)] = min(one, two)
        if len(near):
            while (again := top[top]).tobytes() != top.tobytes():
                top = again
    moved = np.flatnonzero(top != np.arange(len(fp)))
    return fp[top[moved]], fp[moved]


def _links(bits: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (node, fp) sorted by node become links (a, b)."""
        node, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            found = np.unique(np.stack(connecting(node, fp, bits)), axis=1).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

        for batch in batches:
            node = np.concatenate([node, batch.column("node").to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            cut = int(np.searchsorted(node, node[-1])) if len(node) else 0
            if cut:
                yield out(node[:cut], fp[:cut])
                node, fp = node[cut:], fp[cut:]
        if len(node):
            yield out(node, fp)
    return linked


def _met(rows: DataFrame, bits: int, *keys: str) -> DataFrame:
    """Links among rows that agree in ``keys``. Keys are hashed to one number; where two fall on one, rows are compared needlessly and nothing is lost."""
    dealt = rows.select(F.xxhash64(*keys).alias("node"), "fp")
    return dealt.repartition("node").sortWithinPartitions("node").mapInArrow(_links(bits), "a long, b long")


def heavy_cells(classes: DataFrame, chunk: int = CHUNK, share: int = SHARE) -> DataFrame:
    """(cell, chunks) of the cells with more members than ``chunk`` and than one in ``share`` of the rows, so at most ``share`` cells.

    A cell's members are the fingerprints whose own vector lies within distance 1, at most 33 vectors: one of them has a 33rd of the members. So only the
    surroundings of frequent vectors are counted."""
    limit = max(chunk, math.ceil(66 * classes.count() / share))
    half = lambda h: F.shiftrightunsigned("fp", 32 * h).bitwiseAND(F.lit(0xFFFFFFFF))
    own = [(half(h) - F.shiftright(half(h), 1).bitwiseAND(F.lit(_PAIRS))).bitwiseOR(F.lit(h << 32)) for h in (0, 1)]
    vectors = stage(classes.select(F.explode(F.array(*own)).alias("cell")).groupBy("cell").agg(F.count("*").alias("n")))
    near = vectors.where(F.col("n") > limit // 33).select("cell").mapInArrow(_neighbours, "cell long, near long").select(F.col("near").alias("cell")).distinct()
    sums = near.mapInArrow(_neighbours, "cell long, near long").join(vectors.withColumnRenamed("cell", "near"), "near").groupBy("cell").agg(F.sum("n").alias("n"))
    return sums.where(F.col("n") > limit).select("cell", F.ceil(F.col("n") / chunk).alias("chunks"))


def _across(members: DataFrame, bits: int, chunk: int) -> DataFrame:
    """Links between members of heavy cells that no link has joined so far; ``members(cell, fp, root)``.

    Members with one root need no comparison. A root with more than a chunk of members has tiles of its own, the others share tiles; two tiles meet unless they have one root alone."""
    held = stage(members.groupBy("cell", "root").agg(F.count("*").alias("n")))
    own = F.col("n") > chunk
    cells = held.groupBy("cell").agg(F.count("*").alias("roots"), F.ceil(F.coalesce(F.sum(F.when(~own, F.col("n"))), F.lit(0)) / chunk).alias("shared")).where("roots > 1")
    plan = held.join(cells, "cell").select("cell", "root", F.when(own, F.ceil(F.col("n") / chunk)).alias("tiles"), "shared")
    tiled = stage(members.join(plan, ["cell", "root"]).select("cell", "fp", F.when(F.col("tiles").isNotNull(), F.col("root")).alias("alone"),
                                                               F.when(F.col("tiles").isNotNull(), F.pmod(F.xxhash64("fp"), "tiles")).otherwise(F.pmod(F.xxhash64("root"), "shared")).alias("tile")))
    tiles = stage(tiled.select("cell", F.struct("alone", "tile").alias("i")).distinct())
    apart = F.col("i.alone").isNull() | F.col("j.alone").isNull() | (F.col("i.alone") != F.col("j.alone"))
    pairs = tiles.join(tiles.withColumnRenamed("i", "j"), "cell").where((F.col("i") <= F.col("j")) & apart)
    pairs = pairs.withColumn("own", F.explode(F.array_distinct(F.array("i", "j"))))
    met = tiled.select("cell", "fp", F.struct("alone", "tile").alias("own")).join(pairs, ["cell", "own"])
    return _met(met, bits, "cell", "i", "j")


def linked_fingerprints(classes: DataFrame, bits: int = BITS, chunk: int = CHUNK, share: int = SHARE) -> DataFrame:
    """(key, root) of all fingerprints ``classes(fp)``, each given once, that others lie within ``bits`` bits of."""
    if not 0 <= bits <= 4:
        raise ValueError("the grid finds links of at most 4 bits")
    heavy = stage(heavy_cells(classes, chunk, share))
    rows = classes.select("fp").mapInArrow(_posted, "cell long, fp long")
    some = not heavy.isEmpty()
    if some:  # at most `share` rows are broadcast
        rows = rows.join(F.broadcast(heavy), "cell", "left")
    part = F.coalesce(F.pmod(F.xxhash64("fp"), F.col("chunks")), F.lit(0)) if some else F.lit(0)
    links = stage(_met(rows.withColumn("part", part), bits, "cell", "part").distinct())
    roots = components(links)
    if not some:
        return roots
    roots = stage(roots)
    crowd = rows.where("chunks IS NOT NULL").join(roots, rows.fp == roots.key, "left").select("cell", "fp", F.coalesce("root", "fp").alias("root"))
    more = stage(_across(stage(crowd), bits, chunk).distinct())
    return components(roots.select(F.col("key").alias("a"), F.col("root").alias("b")).unionByName(more))


def near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs(doc_id, text, ...)``.

    component_id: the smallest doc_id reachable over links of at most ``bits`` differing bits. Null and wordless texts have fingerprint zero and link like
    any other. Rows without an id link, and never give the id of a component (null where no row of it has one). Repeated rows each get their
    result. An empty table gives an empty result; other columns, whatever their names, are not read.
    """
    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = stage(read.mapInArrow(_fingerprints, T.StructType([read.schema["doc_id"], T.StructField("fp", T.LongType())])))
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = stage(linked_fingerprints(classes, bits))
    named = classes.join(roots, F.col("fp") == F.col("key")).select("fp", "least", "root")
    least = named.groupBy("root").agg(F.min("least").alias("all_least"))
    ids = classes.join(stage(named.join(least, "root").select("fp", "all_least")), "fp", "left").select("fp", F.coalesce("all_least", "least").alias("component_id"))
    return rows.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
