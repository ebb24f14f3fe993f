"""MinHash near-duplicates by a chosen-path set similarity join.

Every set gets minwise values. A tree node selects two positions of the signature by its own hash, and a
set goes on to the children named by its values there, so similar sets keep meeting while others part. Small
nodes are compared exhaustively, large ones branch on as long as that parts their members, and independent trees raise recall.

Exact copies are one class from the start. A node's comparison is a screen on sketches and names only groups: sets that may
link, directly or over others. These groups are then resolved on the full shingle sets, again exhaustively but without
emitting pairs: each task emits the links that connect its members. Nodes and groups of any size are dealt to tasks by
pairs of chunks, so no task ever holds one whole.

Missed pairs: two sets of similarity 0.8 meet in one tree of depth 3 with probability 0.94, in none of 6 trees with
probability 4e-8; the screen on 128 two-bit minwise values loses a pair of similarity 0.8 with probability below 1e-5.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from pathscreen.llm.common import pieces, text_key, unused
from pathscreen.llm.linking import components
from pathscreen.staging import stage

VALUES = 128          # minwise values of a signature
TREES = 6
DEPTH = 3             # levels that every set passes; larger nodes branch on
MAX_DEPTH = 10        # nodes still large here are compared as they are
SMALL = 4096          # members of a node that is compared and does not branch on
PARTS = 0.6           # a child with more than this share of its parent is compared too: branching no longer parts its members
MISMATCHES = 38       # of 128 two-bit values; similarity 0.8 has 19 on average, standard deviation 4
CHUNK = 1024          # members of a node in one chunk; a task compares two chunks
SHINGLES = 200_000    # shingles of a group in one chunk
WORDS_KEPT = 400_000  # word hashes a worker remembers

_rng = np.random.default_rng(20)
_MUL = _rng.integers(0, 2**31, VALUES, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, VALUES, dtype=np.uint64).astype(np.uint32)
_C1, _C2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_word_hash: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z lowered: bytes.lower() and bytes.split() do just that, and no more, on UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(found: list[bytes], width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words than ``width`` are one shingle."""
    if not found:
        return np.zeros(0, np.uint64)
    if len(_word_hash) > WORDS_KEPT:
        _word_hash.clear()
    codes = np.empty(len(found), np.uint64)
    for i, w in enumerate(found):
        h = _word_hash.get(w)
        if h is None:
            h = _word_hash[w] = xxhash.xxh64_intdigest(w)
        codes[i] = h
    if len(found) < width:
        out = np.array([len(found)], np.uint64)
        for c in codes:
            out = _mix(out * _STEP + c)
        return out
    n = len(codes) - width + 1
    out = np.full(n, np.uint64(width + 1000))
    for j in range(width):
        out = _mix(out * _STEP + codes[j:j + n])
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    out, short = np.full(VALUES, 2**32 - 1, np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 4096):
        np.minimum(out, (_MUL[:, None] * short[None, i:i + 4096] + _ADD[:, None]).min(axis=1), out=out)
    return out


def branch(nodes: np.ndarray, signatures: np.ndarray) -> np.ndarray:
    """The two children of each node of each row: (rows, nodes) becomes (rows, 2 * nodes)."""
    first = _mix(nodes + _STEP)
    second = _mix(nodes ^ _C2)
    a, b = (first % np.uint64(VALUES)).astype(np.int64), (second % np.uint64(VALUES - 1)).astype(np.int64)
    b += b >= a
    kids = [_mix(nodes * _STEP + ((at.astype(np.uint64) + np.uint64(1)) << np.uint64(32)) + np.take_along_axis(signatures, at, 1).astype(np.uint64))
            for at in (a, b)]
    return np.concatenate(kids, axis=1)


def sketch(signatures: np.ndarray) -> np.ndarray:
    """Two mixed bits of each value, packed in 4 longs a row."""
    bits = (signatures * np.uint32(0x9E3779B1)) >> np.uint32(30)
    parts = bits.reshape(len(bits), 4, 32).astype(np.uint64) << (np.arange(32, dtype=np.uint64) * np.uint64(2))
    return np.bitwise_or.reduce(parts, axis=2).view(np.int64)


def _digests(width: int, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        sizes, keys, signs = [], [], []
        for text in batch.column("text"):
            h = shingle_hashes(tokens(text.as_py()), width)
            sizes.append(len(h))
            keys.append(hashlib.md5(h.tobytes()).digest() if len(h) else None)
            signs.append(signature(h) if len(h) else None)
        marks = sketch(np.stack([np.zeros(VALUES, np.uint32) if s is None else s for s in signs]))
        cols = [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                pa.array([None if s is None else s.tobytes() for s in signs], pa.binary()), *(pa.array(marks[:, i]) for i in range(4))]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def digests(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key, sig, s0..s3 for every row."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), text_key(F.col("text")).alias("text_key"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("text_key", T.BinaryType()), T.StructField("n_shingles", T.LongType()),
                           T.StructField("set_key", T.BinaryType()), T.StructField("sig", T.BinaryType()),
                           *(T.StructField(f"s{i}", T.LongType()) for i in range(4))])
    return rows.mapInArrow(partial(_digests, width, _arrow(schema)), schema)


def _walk(levels: int, start: str | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (set_key, sig, ...) become rows of their nodes ``levels`` further down; ``start``: the column of the node, then also given as
    ``above``, or None for the roots."""
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            signs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, VALUES)
            if start is None:
                nodes = np.tile(_mix(np.arange(1, TREES + 1, dtype=np.uint64) * _STEP), (batch.num_rows, 1))
            else:
                nodes = batch.column(start).to_numpy(zero_copy_only=False).view(np.uint64)[:, None]
            for _ in range(levels):
                nodes = branch(nodes, signs)
            n = nodes.shape[1]
            keys = batch.column("set_key").take(pa.array(np.repeat(np.arange(batch.num_rows), n)))
            cols = [pa.array(nodes.ravel().view(np.int64)), keys]
            if start is not None:
                cols.append(pa.array(np.repeat(batch.column(start).to_numpy(zero_copy_only=False), n)))
            yield pa.RecordBatch.from_arrays(cols, names=["node", "set_key", "above"][:len(cols)])


def _in_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[dict]]:
    """Rows with equal keys, which come one after another, as lists."""
    held: list[dict] = []
    mark = None
    for batch in batches:
        for row in batch.to_pylist():
            now = tuple(row[k] for k in keys)
            if now != mark and held:
                yield held
                held = []
            mark = now
            held.append(row)
    if held:
        yield held


def _near(rows: list[dict], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(which pairs of rows may link, in how many values they differ); of two chunks only the pairs across them."""
    marks = np.array([[r["s0"], r["s1"], r["s2"], r["s3"]] for r in rows], np.int64).view(np.uint64)
    sizes, sides = np.array([r["n_shingles"] for r in rows]), np.array([r["chunk"] for r in rows])
    apart = np.zeros((len(rows), len(rows)), np.uint8)
    for k in range(4):
        x = marks[:, None, k] ^ marks[None, :, k]
        apart += np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555))
    near = (apart <= MISMATCHES) & (np.minimum.outer(sizes, sizes) * 100 >= np.maximum.outer(sizes, sizes) * percent)
    if rows[0]["i"] != rows[0]["j"]:
        near &= sides[:, None] != sides[None, :]
    return near, apart


def _edges(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], names=["a", "b"])


def _screen(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each two chunks of a node: edges that connect the members that may link."""
    out: list[tuple[bytes, bytes]] = []
    for rows in _in_groups(batches, ("node", "i", "j")):
        if len(rows) < 2:
            continue
        near, _ = _near(rows, percent)
        np.fill_diagonal(near, False)
        open_ = near.any(axis=1)
        while open_.any():
            first = int(open_.argmax())
            group = np.zeros(len(rows), bool)
            edge = group.copy()
            edge[first] = True
            while edge.any():
                group |= edge
                edge = near[edge].any(axis=0) & ~group
            open_ &= ~group
            out.extend((rows[first]["set_key"], rows[k]["set_key"]) for k in np.flatnonzero(group) if k != first)
        if len(out) > 50_000:
            yield _edges(out)
            out = []
    yield _edges(out)


def _resolve(width: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each two chunks of a group: links, confirmed on full sets, that connect all members that links connect."""
    for rows in _in_groups((b for batch in batches for b in pieces(iter([batch]))), ("group", "i", "j")):
        if len(rows) < 2:
            continue
        near, apart = _near(rows, percent)
        a, b = np.nonzero(np.triu(near, 1))
        order = np.argsort(apart[a, b], kind="stable")
        sets: dict[int, frozenset] = {}
        above = list(range(len(rows)))
        out = []

        def top(x: int) -> int:
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
            one, two = top(x), top(y)
            if one == two:
                continue
            for k in (x, y):
                if k not in sets:
                    sets[k] = frozenset(shingle_hashes(tokens(rows[k]["text"]), width).tolist())
            both = len(sets[x] & sets[y])
            if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                above[one] = two
                out.append((rows[x]["set_key"], rows[y]["set_key"]))
        yield _edges(out)


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows with ``key`` and ``chunks``, once for every pair i <= j of chunks that holds their own, in order of the pairs."""
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("set_key"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)))
    rows = rows.withColumn("i", F.least("chunk", "with")).withColumn("j", F.greatest("chunk", "with")).drop("with", "chunks")
    return rows.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def _groups(classes: DataFrame, percent: int) -> DataFrame:
    """(key, root): groups of classes that may link, by the trees."""
    marks = classes.select("set_key", "n_shingles", "s0", "s1", "s2", "s3")
    rows = classes.select("set_key", "sig").mapInArrow(partial(_walk, DEPTH, None), "node long, set_key binary").withColumn("parent", F.lit(0).cast("long"))
    edges, level = None, DEPTH
    while True:
        sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.max("parent").alias("parent")).where("n > 1")
        leaf = (F.col("n") <= SMALL) | (F.col("n") > PARTS * F.col("parent")) & (F.col("parent") > 0) | F.lit(level >= MAX_DEPTH)
        shared = stage(rows.select("node", "set_key").join(sizes.withColumn("leaf", leaf), "node"))
        here = shared.where("leaf").select("node", "set_key", F.ceil(F.col("n") / CHUNK).alias("chunks")).join(marks, "set_key")
        found = stage(_dealt(here, "node").mapInArrow(partial(_screen, percent), "a binary, b binary").distinct())
        edges = found if edges is None else edges.unionByName(found)
        large = shared.where(~F.col("leaf"))
        if level >= MAX_DEPTH or large.isEmpty():
            return components(edges)
        below = large.join(classes.select("set_key", "sig"), "set_key").select("node", "n", "set_key", "sig")
        kids = below.select("node", "set_key", "sig").mapInArrow(partial(_walk, 1, "node"), "node long, set_key binary, above long")
        rows = kids.join(large.select(F.col("node").alias("above"), "n").distinct(), "above").select("node", "set_key", F.col("n").alias("parent"))
        level += 1


def linked_components(docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(digest rows, class table (set_key, component_id, keeps_key: the text of the document that stays)) of ``docs(doc_id, text)``; the public form is ``near_duplicates``."""
    rows = stage(digests(docs, width))
    classes = stage(rows.where("set_key is not null").groupBy("set_key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"), F.first("n_shingles").alias("n_shingles"),
        F.first("sig").alias("sig"), *(F.first(f"s{i}").alias(f"s{i}") for i in range(4))))
    groups = stage(_groups(classes, percent))
    weights = groups.join(classes.select("set_key", "n_shingles"), F.col("key") == F.col("set_key")).groupBy("root").agg(F.ceil(F.sum("n_shingles") / SHINGLES).alias("chunks"))
    wanted = groups.join(weights, "root").join(classes, F.col("key") == F.col("set_key"))
    wanted = stage(wanted.select(F.col("root").alias("group"), "chunks", "set_key", "n_shingles", "s0", "s1", "s2", "s3", F.col("first.doc_id").alias("want_id"), F.col("first.text_key").alias("want_key")))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), text_key(F.col("text")).alias("text_key"))
    texts = texts.join(wanted, texts.doc_id.eqNullSafe(wanted.want_id) & (texts.text_key == wanted.want_key)).drop("doc_id", "text_key", "want_id", "want_key")
    links = stage(_dealt(texts, "group").mapInArrow(partial(_resolve, width, percent), "a binary, b binary").distinct())
    roots = stage(components(links))
    named = classes.select("set_key", "first").join(roots, F.col("set_key") == F.col("key"), "left").select("set_key", "first", F.coalesce("root", "set_key").alias("root"))
    ids = named.groupBy("root").agg(F.min("first").alias("keeps"))
    return rows, stage(named.join(ids, "root").select("set_key", F.col("keeps.doc_id").alias("component_id"), F.col("keeps.text_key").alias("keeps_key")))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, stays, text_key for every row of ``docs(doc_id, text, ...)``.

    A document's set is its distinct ``width``-word shingles; sets link at ``percent`` of 100 similarity or more.
    component_id: the smallest doc_id reachable over links. kept: the document has that id. Null or wordless texts: an
    empty set, linked with nothing. Null ids: such a row links, never gives the id of a component with others, and is kept
    only where no row of its component has an id. Rows that repeat an id each get their own result; of kept rows with one id but several texts only one also
    ``stays``. An empty table gives
    an empty result; other columns, whatever their names, are not read.
    """
    rows, named = linked_components(docs.select("doc_id", "text"), width, percent)
    out = rows.select("doc_id", "n_shingles", "set_key", "text_key").join(named, "set_key", "left")
    own = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    stays = F.coalesce(F.col("doc_id") == own, own.isNull())
    return out.select("doc_id", "n_shingles", own.alias("component_id"), stays.alias("kept"), (stays & F.coalesce(F.col("text_key") == F.col("keeps_key"), F.lit(True))).alias("stays"), "text_key")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each near-duplicate group, with all its columns; of rows that repeat id and text one stays.

    Null and empty texts are no one's duplicates: one row of each id stays. A row without id stays only where its group has none with an id. An empty table gives an
    empty result; other columns, whatever their names, pass through and decide which of repeated rows stays.
    """
    own_name, own_key, row = unused(docs.columns, "_name", "_text_key", "_row")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    kept = stage(near_duplicates(docs, width, percent).where("stays").select(name.alias("_kept_id"), F.col("text_key").alias("_kept_key")).distinct())
    kept = kept.toDF(*unused(docs.columns, "_kept_id", "_kept_key"))
    rows = docs.withColumn(own_key, text_key(F.col("text"))).withColumn(own_name, name)
    rows = rows.join(kept, (F.col(own_name) == F.col(kept.columns[0])) & (F.col(own_key) == F.col(kept.columns[1])), "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")] or ["doc_id"]
    one = Window.partitionBy(own_name, own_key).orderBy(*others)  # as the join's partitioning: the text moves once
    return rows.withColumn(row, F.row_number().over(one)).where(F.col(row) == 1).select(*docs.columns)
