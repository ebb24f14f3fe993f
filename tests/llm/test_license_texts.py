"""Whole license texts and notices: altered conditions, BSD variants, and words that tell notices apart."""
import re

from pathscreen.llm import license_texts as L, license_templates

TWO = """Copyright (c) 2020, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
ADVERTISING = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the Acme Group.\n"
NAMES = "* Neither the name of the Acme Group nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS “AS IS” AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
GNU = "Foo is free software: you can redistribute it and/or modify it under the terms of the GNU %sGeneral Public License"
CC = "This work is licensed under a Creative Commons Attribution%s 4.0 International License."
CASES = [
    (MIT, {("mit", True)}), (MIT.replace("shall be included", "may be left out"), set()), (MIT[:MIT.index(", including")], set()), (MIT[:MIT.index("THE SOFTWARE IS")], set()),
    (TWO + DISCLAIMER, {("bsd-2", True)}), (TWO + NAMES.replace("*", "3.") + DISCLAIMER, {("bsd-3", True)}), (TWO + ADVERTISING + NAMES.replace("*", "4.") + DISCLAIMER, {("bsd-4", True)}),
    (TWO + "3. No commercial use.\n" + DISCLAIMER, set()), (TWO, set()),
    (GNU % "", {("gpl", False)}), (GNU % "Lesser ", {("lgpl", False)}), (GNU % "Affero ", {("agpl", False)}),
    (CC % "", {("cc-by", False)}), (CC % "-NonCommercial", {("cc-by-nc", False)}), (CC % "-ShareAlike", {("cc-by-sa", False)}), (CC % "-NoDerivatives", {("cc-by-nd", False)}),
    (CC % "-Non Commercial-Share Alike", {("cc-by-nc-sa", False)}), ("licensed under CC BY-NC-ND 4.0", {("cc-by-nc-nd", False)}), ("licensed under CC BY 4.0", {("cc-by", False)}), ("", set()), (None, set()),
]


def test_whole_texts_and_notices(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    for r in L.license_texts(rows).collect():
        assert {(p.label, p.whole) for p in r._license_texts.places} == CASES[r.doc_id][1], CASES[r.doc_id][0]
    assert L.license_texts(rows.limit(0)).count() == 0


def test_shipped_texts_carry_their_license_and_no_other():
    import pkgutil
    for label in L.FILES:
        text = pkgutil.get_data("pathscreen.llm", f"texts/{label}.txt").decode()
        assert {p[0] for p in L.places(L.words(text)) if p[3]} == {label}
        assert {p[0] for p in L.places(L.words(text.replace("\n\n", "\n\n# "))) if p[3]} == {label}
        cut = text.split()
        del cut[len(cut) // 2]
        assert not [p for p in L.places(L.words(" ".join(cut))) if p[3]]


def test_automata_against_regular_expressions():
    for label in L.WHOLE:
        template = L._plain(L.whole_template(label))
        for text, want in CASES[:9]:
            joined = " " + "".join(w.decode() + " " for w in L.words(text))
            assert bool(re.search(" " + license_templates.template_pattern(template), joined)) == ((label, True) in want), (label, text)


def test_query(spark, tmp_path):
    from pathscreen.llm.queries import op7_license_texts
    spark.createDataFrame([(1, MIT), (2, CC % "-NonCommercial"), (3, "under the MIT License"), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.whole_labels, r.notice_labels, r.base_labels, r.score) for r in op7_license_texts(spark, str(tmp_path)).collect()}
    assert got == {1: ("mit", "", "", 1.0), 2: ("", "cc-by-nc", "", 0.75), 3: ("", "", "mit", 0.5), 4: ("", "", "", 0.0)}
