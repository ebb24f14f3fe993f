"""Whole license texts, and license notices under labels of their own.

A text carries a license when all its mandatory wording, conditions and disclaimer included, stands consecutively in it; titles and
copyright lines stand outside of it, paragraph numbers are optional, names of holders replaceable. Notices only refer to a license;
the words that tell licenses apart (lesser, affero, noncommercial, sharealike, noderivatives) are mandatory in them.
"""
from __future__ import annotations

import pkgutil
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_type

from pathscreen.llm.common import pieces
from pathscreen.llm.license_templates import Automaton, _where
from pathscreen.llm.wu_manber import word_list

RESULT = "_license_texts"
PLACE = T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("end", T.LongType()), T.StructField("whole", T.BooleanType())])
RESULT_TYPE = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(PLACE))])

# Typographic signs that are no words, and spellings that count as equal.
SIGNS = {c: " " for c in (0xA0, 0xA9, 0xAB, 0xBB, *range(0x2000, 0x2070), 0x3000, 0xFEFF)}
SAME = ((re.compile(rb" non (infringement|commercial) "), rb" non\1 "), (re.compile(rb" share alike "), b" sharealike "), (re.compile(rb" no(?: derivatives| derivs|derivs) "), b" noderivatives "),
        (re.compile(rb" licence "), b" license "), (re.compile(rb" sublicence "), b" sublicense "), (re.compile(rb" disclaim all warranties "), b" disclaims all warranties "), (re.compile(rb" https "), b" http "))

_MIT_GRANT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
    the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish
    distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"""
_MIT_DISCLAIMER = """the software is provided as is without warranty of any kind express or implied including but not limited to the
    warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<holder:1-20>> be liable for any
    claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with
    the software or the use or other dealings in the software"""
_ISC_GRANT = "permission to use copy modify and[[ or]] distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = """the software is provided as is and <<holder:1-20>> disclaims all warranties with regard to this software including all
    implied warranties of merchantability and fitness in no event shall <<holder:1-20>> be liable for any special direct indirect or
    consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence
    or other tortious action arising out of or in connection with the use or performance of this software"""
_BSD_TWO = """redistribution and use in source and binary forms with or without modification are permitted provided that the following
    conditions are met [[1]] [[a]] redistributions of source code must retain the above copyright notice this list of conditions and the following
    disclaimer [[2]] [[b]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the
    following disclaimer in the documentation and or other materials provided with the distribution"""
_BSD_ADVERTISING = """all advertising materials mentioning features or use of this software must display the following
    acknowledgement this product includes software developed by <<holder:1-20>>"""
_BSD_NAMES = """neither the name [[of]] <<holder:1-20>> nor the names of [[its]] [[other]] [[their]] [[any]] contributors may be used to endorse or promote
    products derived from this software without specific prior written permission"""
_BSD_DISCLAIMER = """this software is provided by <<holder:1-20>> as is and any express or implied warranties including but not limited to the
    implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<holder:1-20>> be
    liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of
    substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability
    whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software
    even if advised of the possibility of such damage"""

# Whole texts with markup; those of FILES lie in the folder texts.
WHOLE = {
    "mit": f"{_MIT_GRANT} subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software {_MIT_DISCLAIMER}",
    "mit-0": f"{_MIT_GRANT} {_MIT_DISCLAIMER}",
    "isc": f"{_ISC_GRANT} provided that the above copyright notice and this permission notice appear in all copies {_ISC_DISCLAIMER}",
    "0bsd": f"{_ISC_GRANT} {_ISC_DISCLAIMER}",
    "bsd-2": f"{_BSD_TWO} {_BSD_DISCLAIMER}",
    "bsd-3": f"{_BSD_TWO} [[3]] [[c]] {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "bsd-4": f"{_BSD_TWO} [[3]] [[c]] {_BSD_ADVERTISING} [[4]] [[d]] {_BSD_NAMES} {_BSD_DISCLAIMER}",
}
FILES = ("apache-2", "gpl-2", "gpl-3", "lgpl-2", "lgpl-2.1", "lgpl-3", "mpl-2", "cc0-1")

_FREE = "free software you can redistribute it and or modify it under the terms of the gnu"
_VERSION = "[[1 0]] [[2 0]] [[2 5]] [[3 0]] [[4 0]]"
_CC = {"by": "", "by-sa": "sharealike", "by-nc": "noncommercial", "by-nd": "noderivatives", "by-nc-sa": "noncommercial sharealike", "by-nc-nd": "noncommercial noderivatives"}
# Fixed values: (label, wording) of notices.
NOTICES = [
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl", f"{_FREE} general public license"),
    ("lgpl", f"{_FREE} lesser general public license"), ("lgpl", f"{_FREE} library general public license"),
    ("agpl", f"{_FREE} affero general public license"),
    *((f"cc-{kind}", f"creative commons attribution {words} {_VERSION} [[international]] [[unported]] [[generic]] [[public]] license") for kind, words in _CC.items()),
    *((f"cc-{kind}", f"licensed under {the} cc {kind.replace('-', ' ')} {v}") for kind, the, v in product(_CC, ("", "a", "the"), ("1 0", "2 0", "2 5", "3 0", "4 0"))),
]


def words(text: str | None) -> list[bytes]:
    """Words without typographic signs, in one spelling."""
    joined = b" " + b" ".join(word_list(text.translate(SIGNS) if text else text)) + b" "
    for pattern, to in SAME:
        joined = pattern.sub(to, joined)
    return joined.split()


def whole_template(label: str) -> str:
    if label in WHOLE:
        return WHOLE[label]
    text = pkgutil.get_data(__package__, f"texts/{label}.txt").decode("utf-8")
    number = re.compile(r"(?:\A|(?<=\n\n))([ \t]*)\(?(\d+(?:\.\d+)*|[a-z])[.)](?=\s)")
    return number.sub(r"\1[[\2]]", text).translate(SIGNS)


def _plain(template: str) -> str:
    """The template with its mandatory words in one spelling; the markup stays."""
    return "".join(part if part[:2] in ("[[", "<<") else f" {b' '.join(words(part)).decode()} " for part in re.split(r"(\[\[.*?\]\]|<<\w+:\d+-\d+>>)", template, flags=re.S))


@lru_cache(maxsize=1)
def automata() -> list[tuple[str, bool, Automaton]]:
    return [(label, True, Automaton(_plain(whole_template(label)))) for label in (*WHOLE, *FILES)] + [(label, False, Automaton(_plain(t))) for label, t in NOTICES]


def places(found: list[bytes]) -> list[tuple[str, int, int, bool]]:
    joined, out = b" " + b" ".join(found) + b" ", []
    for label, whole, a in automata():
        for at in _where(joined, a.anchor):
            end = a.match(found, at)  # no template begins with a replaceable region
            if end is not None:
                out.append((label, at, end, whole))
    return out


def _scan(kind: pa.DataType, text: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, text):
        out = []
        for body in batch.column(text).to_pylist():
            found = words(body)
            out.append({"n_words": len(found), "places": [dict(zip(("label", "first", "end", "whole"), p)) for p in places(found)] if found else []})
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, RESULT])


def license_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``_license_texts``: n_words and places (label, first word, end, whole text or notice).

    Words are those of ``words``. One narrow pass over whole texts. Null or empty texts have no words and no places; repeated rows are
    scanned each; an empty table gives an empty result; other columns pass through, one named like the result is replaced.
    """
    docs = docs.drop(RESULT)
    schema = T.StructType([*docs.schema.fields, T.StructField(RESULT, RESULT_TYPE)])
    return docs.mapInArrow(partial(_scan, to_arrow_type(RESULT_TYPE), text), schema)
