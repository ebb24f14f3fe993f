"""Small helpers that several operators of this folder share."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD_GAP = r"[ \t-\r]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, made longer than every column's, so that none of them is one of ``columns``."""
    return [name + "_" * max(map(len, columns), default=0) for name in names]


def words(text: Column) -> Column:
    """Runs of characters other than space and U+0009-U+000D; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def text_key(text: Column) -> Column:
    """16 bytes that tell texts apart; null and the empty text differ."""
    return F.unhex(F.md5(F.concat(F.when(text.isNull(), F.lit("n")).otherwise(F.lit("t")), F.coalesce(text, F.lit("")))))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``most`` bytes of text (a longer text comes alone)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        at = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)
