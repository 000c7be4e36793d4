from __future__ import annotations

import pytest

from tastemill.llm import licence_classifier as L
from tastemill.llm.storage import table

SMALL = "/root/testdata/sf0.01"
PLANTED = {
    "All rights reserved.": "proprietary",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
}


@pytest.fixture(scope="module")
def model(spark):
    return L.train(table(spark, SMALL, "documents"))


def test_families_of_known_and_altered_notices(model):
    for line, family in {
        **PLANTED,
        "This file is released under the MIT license, see below": "mit",
        "(c) 2020 Someone. Licensed under the Apache License, Version 2.0 (the \"License\")": "apache-2.0",
        "SPDX-License-Identifier: MPL-2.0": "mpl",
    }.items():
        assert [(L.FAMILIES[f], sure) for _, f, _, sure in L.classify([line.encode()], model)] == [(family, True)], line
    for line in ("he was licensed under the table", "the general public was there", "", "!!", "version two of the work"):
        assert not any(sure for *_, sure in L.classify([line.encode()], model)), line


def test_planted_lines_equal_an_exact_search(spark, model):
    docs = table(spark, SMALL, "documents")
    got = {r.doc_id: (r.families, r.n_licences) for r in L.scan(docs, model).collect()}
    for r in docs.collect():
        own = [PLANTED[x] for x in r.text.split("\n") if x in PLANTED]
        assert got[r.doc_id] == (",".join(sorted(set(own))), len(own)), r.doc_id


def test_edges(spark, model):
    rows = [(1, "a\n\nReleased under the MIT License.\r\nb"), (1, None), (None, ""), (4, "\n!\n")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, families string")
    got = sorted(map(tuple, L.scan(docs, model).collect()), key=str)
    assert got == sorted([(1, 3, 1, "mit", "mit:2"), (1, 0, 0, "", ""), (None, 0, 0, "", ""), (4, 0, 0, "", "")], key=str)
    assert L.scan(docs.limit(0), L.train(docs.limit(0))).count() == 0


def test_notices_that_no_table_has(model):
    for line, family in {
        "Distributed under the terms of the GNU Lesser General Public License, version 2.1 or later": "lgpl",
        "The files here are available under the BSD 3-Clause License": "bsd",
        "You can use it under the Mozilla Public License, version 2.0": "mpl",
        "covered by the GNU Affero General Public License, version 3": "agpl",
        "Photos: CC BY-SA 4.0": "cc-by-sa",
    }.items():
        assert [(L.FAMILIES[f], sure) for _, f, _, sure in L.classify([line.encode()], model)] == [(family, True)], line


def test_wrapped_notices_are_one_paragraph(model):
    text = b"Story\nThis program is covered by the GNU Affero\nGeneral Public License, version 3\n\nMore of it here\nMozilla Public\nLicense, version 2.0"
    count, found = L.notices([text, None], model)
    assert {f for f, _, _ in found[0]} == {"agpl", "mpl"} and all(a in (1, 5) and b in (2, 6) for _, a, b in found[0]), found
    assert count[1] == 0 and not found[1]


def test_very_long_line(model):
    line = b"word " * 300_000 + b"SPDX-License-Identifier: MIT"
    count, found = L.notices([line + b"\n" + line[-28:]], model)
    assert count == [2] and found == [[("mit", 1, 1)]]
