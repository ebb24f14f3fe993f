"""Delimited files of any size as cells, read in ranges of bytes.

Spark's text source cuts a file into splits and gives their physical lines. A cell in quotes may hold line ends, so a line or a whole split can begin
inside a cell. What a split does to the two states (outside, inside quotes) is computed for each split alone, a prefix scan over the
splits of a file gives the state at each split's begin, and then every split is parsed alone by Python's csv. Records that a cut goes
through come as pieces and are joined afterwards.
"""
from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pathscreen.sources.files import BATCH, REJECT_ROW, SEPARATORS
from pathscreen.staging import stage

ENCODINGS = ("utf-8", "gb18030", "latin1")  # of ranges: a byte 10 is a line end in each
PIECE = -1          # column number of a part of a record
LEAD = -1           # row number of a part that does not begin its record
_SPLIT = "path string, at long"


def _lines(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """(path, at, line): the lines of each split in order; ``at`` is the split's first byte."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("line"))


class Quotes:
    """Follows the quotes of csv (doubled quotes, spaces before a cell dropped) from line to line."""

    def __init__(self, sep: str):
        stop = re.escape(sep) + "\r"
        after = f'(?:"[^{stop}]*+(?:[{stop}]|\\Z)|(?P<open>\\Z))'  # behind a closing quote the cell goes on without quotes
        self.inner = re.compile(f'(?:[^"]++|"")*+{after}')
        self.cell = re.compile(f' *+(?:"(?:[^"]++|"")*+{after}|[^{stop}]*+(?:[{stop}]|\\Z))')

    def after(self, line: str, inside: bool) -> bool:
        """Whether the end of ``line`` is inside quotes."""
        if '"' not in line:
            return inside
        at = 0
        if inside:
            found = self.inner.match(line)
            if found["open"] is not None:
                return True
            at = found.end()
        while at < len(line):
            found = self.cell.match(line, at)
            if found["open"] is not None:
                return True
            at = found.end()
        return False


def rows_of(text: str, sep: str) -> list[list[str]]:
    csv.field_size_limit(2**31 - 1)
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep, skipinitialspace=True) if r]


def first_width(lines: Iterable[str], sep: str) -> int:
    """Cells of the first record that is not blank; 0 without any."""
    quotes, held, inside = Quotes(sep), [], False
    for line in lines:
        held.append(line)
        inside = quotes.after(line, inside)
        if not inside:
            if rows := rows_of("\n".join(held), sep):
                return len(rows[0])
            held = []
    rows = rows_of("\n".join(held), sep)
    return len(rows[0]) if rows else 0


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[bytes]]]:
    """(path, at, lines) of the neighbouring rows of one split in a batch."""
    for batch in batches:
        path, at, lines = (batch.column(name).to_pylist() for name in ("path", "at", "line"))
        start = 0
        for i in range(1, len(path) + 1):
            if i == len(path) or (path[i], at[i]) != (path[start], at[start]):
                yield path[start], at[start], lines[start:i]
                start = i


def _decodes(raw: bytes, encoding: str) -> bool:
    try:
        raw.decode(encoding)
    except UnicodeError:
        return False
    return True


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a part of a split: which encodings decode it; for the first part of a file also a byte-order mark of UTF-16 and, by encoding, the first
    separator that gives two cells (-1: none)."""
    seen = None
    for path, at, lines in _segments(batches):
        raw = b"\n".join(lines)
        seps, wide = [], False
        if at == 0 and seen != path:
            wide = raw[:2] in (b"\xff\xfe", b"\xfe\xff")
            for encoding in ENCODINGS:
                text = [x.decode(encoding, "replace") for x in lines]
                text[0] = text[0].removeprefix("﻿")
                seps.append(next((k for k, s in enumerate(SEPARATORS) if first_width(text, s) >= 2), -1))
        seen = path
        utf = _decodes(raw, "utf-8")
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([utf]), pa.array([utf or _decodes(raw, "gb18030")]), pa.array([wide]), pa.array([seps], pa.list_(pa.int32()))],
                                         names=["path", "utf", "gb", "wide", "seps"])


def formats(lines: DataFrame) -> DataFrame:
    """(path, encoding, sep) of every file: the first encoding that decodes all of it, and the first separator that gives the first record two cells, else a comma.

    The first record that is not blank must end within the file's first Arrow batch. UTF-16 is told by its mark; its line ends can't be found by bytes.
    """
    facts = lines.mapInArrow(_facts, "path string, utf boolean, gb boolean, wide boolean, seps array<int>").groupBy("path").agg(
        F.bool_and("utf").alias("utf"), F.bool_and("gb").alias("gb"), F.bool_or("wide").alias("wide"), F.flatten(F.collect_list("seps")).alias("seps"))
    number = F.when(F.col("utf"), 0).when(F.col("gb"), 1).otherwise(2)
    sep = F.greatest(F.element_at("seps", number + 1), F.lit(0))
    names = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at + 1)
    return facts.select("path", F.when(F.col("wide") & ~F.col("utf"), "utf-16").otherwise(names(ENCODINGS, number)).alias("encoding"), names(SEPARATORS, sep).alias("sep"))


def _turns(encoding: str, sep: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, at, from_out, from_in): where a split leads from outside and from inside quotes."""
    quotes, key, state = Quotes(sep), None, (False, True)

    def out():
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([state[0]]), pa.array([state[1]])], names=["path", "at", "from_out", "from_in"])

    for path, at, lines in _segments(batches):
        if (path, at) != key:
            if key:
                yield out()
            key, state = (path, at), (False, True)
        for line in lines:
            if b'"' in line:
                text = line.decode(encoding)
                state = tuple(quotes.after(text.removeprefix("﻿") if at == 0 else text, s) for s in state)
    if key:
        yield out()


def begins_inside(turns: DataFrame) -> DataFrame:
    """(path, at, inside): the state at each split's begin. A split either keeps the state, swaps it, or sets it; so the state is the last one set, swapped as
    often as splits have swapped since."""
    whole = Window.partitionBy("path").orderBy("at")  # one row per split of a file
    upto, before = whole.rowsBetween(Window.unboundedPreceding, 0), whole.rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.withColumn("swaps", F.sum((F.col("from_out") & ~F.col("from_in")).cast("int")).over(upto))
    fixed = F.last(F.when(F.col("from_out") == F.col("from_in"), F.struct(F.col("from_out").cast("int").alias("state"), "swaps")), ignorenulls=True).over(before)
    rows = rows.withColumn("fixed", fixed).withColumn("done", F.coalesce(F.lag("swaps").over(whole), F.lit(0)))
    since = F.col("done") - F.coalesce("fixed.swaps", F.lit(0))
    return rows.select("path", "at", ((F.coalesce("fixed.state", F.lit(0)) + since) % 2 == 1).alias("inside"))


class Split:
    """The rows of one split, from its lines. ``lead``: what belongs to the record that the split before left open; ``open``: a record that this one leaves open."""

    def __init__(self, sep: str, inside: bool):
        self.sep, self.quotes, self.inside = sep, Quotes(sep), inside
        self.lead: list[str] | None = [] if inside else None
        self.leading, self.held = inside, []

    def rows(self, lines: Iterable[str]) -> list[list[str]]:
        """Rows that these lines complete."""
        ready: list[str] = []
        for line in lines:
            self.inside = self.quotes.after(line, self.inside)
            if self.leading:
                self.lead.append(line)
                self.leading = self.inside
                continue
            self.held.append(line)
            if not self.inside:
                ready.extend(self.held)
                self.held = []
        return rows_of("\n".join(ready), self.sep) if ready else []


def _cells(encoding: str, sep: str, inside, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, at, row_no within the split, col_no, txt), and parts of records under PIECE."""
    key, split, n, first = None, None, 0, True

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(rows)), pa.array([key[1]] * len(rows), pa.int64()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.string())))],
                                          names=["path", "at", "row_no", "col_no", "txt"])

    def pieces():
        found = ([] if split.lead is None else [(LEAD, PIECE, "\n".join(split.lead))]) + ([(n, PIECE, "\n".join(split.held))] if split.held else [])
        return [out(found)] if found else []

    for path, at, lines in _segments(batches):
        if (path, at) != key:
            if key:
                yield from pieces()
            key, n = (path, at), 0
            split, first = Split(sep, key in inside.value), at == 0
        text = [x.decode(encoding) for x in lines]
        if first:
            text[0], first = text[0].removeprefix("﻿"), False
        cells = []
        for row in split.rows(text):
            cells.extend((n, j, cell) for j, cell in enumerate(row))
            n += 1
            if len(cells) >= BATCH:
                yield out(cells)
                cells = []
        if cells:
            yield out(cells)
    if key:
        yield from pieces()


def _joined(sep: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, at, row_no, text in zip(*(batch.column(name).to_pylist() for name in ("path", "at", "row_no", "text"))):
            cells = [(row_no + i, j, cell) for i, row in enumerate(rows_of(text, sep)) for j, cell in enumerate(row)]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(cells)), pa.array([at] * len(cells), pa.int64()), *(pa.array([c[i] for c in cells], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.string())))],
                                             names=["path", "at", "row_no", "col_no", "txt"])


def _scan(lines: DataFrame, encoding: str, sep: str) -> DataFrame:
    spark, schema = lines.sparkSession, f"{_SPLIT}, row_no long, col_no int, txt string"
    turns = lines.mapInArrow(partial(_turns, encoding, sep), f"{_SPLIT}, from_out boolean, from_in boolean")
    inside = {(r.path, r.at) for r in begins_inside(turns).where("inside").collect()}  # at most one entry per split, some bytes for 128 MB of input
    cells = stage(lines.mapInArrow(partial(_cells, encoding, sep, spark.sparkContext.broadcast(inside)), schema))
    order = Window.partitionBy("path").orderBy("at", "row_no")  # at most two parts per split; a lead comes before what the split leaves open
    parts = cells.where(F.col("col_no") == PIECE).withColumn("record", F.sum((F.col("row_no") != LEAD).cast("int")).over(order))
    whole = parts.groupBy("path", "record").agg(F.array_sort(F.collect_list(F.struct("at", "row_no", "txt"))).alias("p"))  # one record
    whole = whole.select("path", F.col("p")[0]["at"].alias("at"), F.col("p")[0]["row_no"].alias("row_no"), F.array_join(F.transform("p", lambda x: x["txt"]), "\n").alias("text"))
    return stage(cells.where(F.col("col_no") != PIECE).unionByName(whole.mapInArrow(partial(_joined, sep), schema)))


def scan_ranges(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """cells(path, row_no, col_no, txt) of all text files under ``root`` as ``files.decode_files`` gives them, each file read by many tasks.

    Blank lines are left out, row 0 is the first record. Files without a record give ``empty_file`` under ``REJECT_ROW`` if they hold a line (a file of no
    bytes has no split and no row), those in UTF-16 ``utf16``: read them whole. A quote that is never closed takes the rest of its file into one cell (but for a last line end). Runs jobs; the driver
    holds the path and format of every file, as Spark's listing of them does.
    """
    kinds: dict[tuple[str, str], list[str]] = {}
    for r in formats(_lines(spark, root, pattern)).collect():
        kinds.setdefault((r.encoding, r.sep), []).append(r.path)
    out = None
    wide = [p for (encoding, _), paths in kinds.items() if encoding == "utf-16" for p in paths]
    rejects = [(p, REJECT_ROW, REJECT_ROW, "utf16") for p in wide]
    for (encoding, sep), paths in kinds.items():  # at most one turn per encoding and separator
        if encoding == "utf-16":
            continue
        cells = _scan(_lines(spark, paths), encoding, sep)
        rows = cells.groupBy("path", "at").agg((F.max("row_no") + 1).alias("rows"))
        offset = F.coalesce(F.sum("rows").over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = cells.join(rows.select("path", "at", offset.alias("offset")), ["path", "at"]).select("path", (F.col("row_no") + F.col("offset")).alias("row_no"), "col_no", "txt")
        out = found if out is None else out.unionByName(found)
        held = {r.path for r in rows.select("path").distinct().collect()}  # files, as listed
        rejects += [(p, REJECT_ROW, REJECT_ROW, "empty_file") for p in paths if p not in held]
    coded = spark.createDataFrame(rejects, "path string, row_no long, col_no int, txt string")
    return coded if out is None else out.unionByName(coded)
