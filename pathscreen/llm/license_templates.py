"""License scans by template markup.

A template is a license wording with optional regions ``[[...]]`` and replaceable regions ``<<name:least-most>>`` (so many words
of any kind). It is compiled into a token automaton; a text carries the license where the automaton accepts words
that stand consecutively in it, that is where all mandatory wording matches exactly. Short phrases are found as well.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pathscreen.llm.common import pieces
from pathscreen.llm.wu_manber import word_list

RESULT = "_licenses"
PLACE = T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("end", T.LongType()), T.StructField("template", T.BooleanType())])
RESULT_TYPE = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(PLACE))])

# Phrases with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# The opening wording of well-known public licenses, with markup. Words are compared without case and punctuation.
TEMPLATES = {
    "mit": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files [[the software]] to deal in the software without restriction""",
    "isc": """permission to use copy modify and[[ or]] distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies""",
    "bsd": """redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met""",
    "apache-2": """licensed under the apache license version 2 0 [[the license]] [[you may not use <<object:1-4>> except in compliance with the license]]""",
    "gpl": """<<program:1-6>> is free software you can redistribute it and or modify it under the terms of the gnu [[lesser]] [[affero]] general public
        license""",
    "cc-by": """licensed under [[a]] [[the]] creative commons attribution [[noncommercial]] [[sharealike]] <<version:0-3>> [[international]] license""",
    "copyright": """copyright <<year:1-3>> <<holder:1-6>> all rights reserved""",
}


def parts(template: str) -> list[tuple]:
    """("word", bytes), ("any", least, most) and ("maybe", [parts]) in order."""
    out: list[tuple] = []
    for optional, name, least, most, text in re.findall(r"\[\[(.*?)\]\]|<<(\w+):(\d+)-(\d+)>>|([^\[<]+)", template, re.S):
        if optional:
            out.append(("maybe", parts(optional)))
        elif name:
            out.append(("any", int(least), int(most)))
        else:
            out.extend(("word", w) for w in word_list(text))
    return out


class Automaton:
    """States are numbers in order; each takes one word (None: any) to the next one, and may be passed by skips without a word."""

    def __init__(self, template: str):
        self.takes: list[bytes | None] = []
        skips: dict[int, set[int]] = {}

        def add(found: list[tuple]) -> None:
            for part in found:
                first = len(self.takes)
                if part[0] == "word":
                    self.takes.append(part[1])
                elif part[0] == "any":
                    self.takes.extend([None] * part[2])
                    for s in range(first + part[1], first + part[2]):
                        skips.setdefault(s, set()).add(first + part[2])
                else:
                    add(part[1])
                    skips.setdefault(first, set()).add(len(self.takes))

        add(parts(template))
        self.accept = len(self.takes)

        def closure(state: int) -> frozenset[int]:
            seen, open_ = {state}, [state]
            while open_:
                for t in skips.get(open_.pop(), ()):
                    if t not in seen:
                        seen.add(t)
                        open_.append(t)
            return frozenset(seen)

        self.from_ = [closure(s) for s in range(self.accept + 1)]
        # the mandatory words before which a fixed range of words can stand: where they occur, a match can begin
        fixed, at, low, high = [], 0, 0, 0
        for part in parts(template):
            if part[0] == "word":
                fixed.append(part[1])
            elif fixed:
                break
            elif part[0] == "any":
                low, high = low + part[1], high + part[2]
        self.anchor, self.before = b" " + b" ".join(fixed) + b" ", range(low, high + 1)

    def match(self, words: list[bytes], start: int) -> int | None:
        """The end of the longest accepted run of words from ``start``."""
        states, end = self.from_[0], None
        for at in range(start, len(words) + 1):
            if self.accept in states:
                end = at
            if at == len(words):
                break
            states = frozenset().union(*(self.from_[s + 1] for s in states if s < self.accept and self.takes[s] in (None, words[at])))
            if not states:
                break
        return end


def template_pattern(template: str) -> str:
    """The same language as a regular expression over words that are each followed by one space."""
    def of(found):
        return "".join(p[1].decode() + " " if p[0] == "word" else f"(?:[^ ]+ ){{{p[1]},{p[2]}}}" if p[0] == "any" else f"(?:{of(p[1])})?" for p in found)
    return of(parts(template))


@lru_cache(maxsize=1)
def automata() -> list[tuple[str, Automaton]]:
    return [(label, Automaton(t)) for label, t in TEMPLATES.items()]


def _where(joined: bytes, wanted: bytes) -> Iterator[int]:
    """Word numbers at which ``wanted`` (spaced words) begins in spaced words."""
    at, seen, words = joined.find(wanted), 0, 0
    while at >= 0:
        words += joined.count(b" ", seen, at)
        seen = at
        yield words
        at = joined.find(wanted, at + 1)


def places(words: list[bytes]) -> list[tuple[str, int, int, bool]]:
    joined, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in PHRASES.items():
        n = len(phrase.split())
        out.extend((label, at, at + n, False) for at in _where(joined, f" {phrase} ".encode()))
    for label, a in automata():
        for at in _where(joined, a.anchor):
            for start in (at - k for k in a.before if k <= at):
                end = a.match(words, start)
                if end is not None:
                    out.append((label, start, end, True))
                    break
    return out


def _scan(kind: pa.DataType, text: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, text):
        out = []
        for body in batch.column(text).to_pylist():
            words = word_list(body)
            out.append({"n_words": len(words), "places": [dict(zip(("label", "first", "end", "template"), p)) for p in places(words)] if words else []})
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, RESULT])


def license_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``_licenses``: n_words and places (label, first word, end, by template or by phrase).

    One narrow pass over whole texts. Null or empty texts have no words and no places; repeated rows are scanned each; an empty
    table gives an empty result; other columns pass through, one named like the result is replaced.
    """
    from functools import partial
    from pyspark.sql.pandas.types import to_arrow_type
    docs = docs.drop(RESULT)
    schema = T.StructType([*docs.schema.fields, T.StructField(RESULT, RESULT_TYPE)])
    return docs.mapInArrow(partial(_scan, to_arrow_type(RESULT_TYPE), text), schema)
