from __future__ import annotations

import hashlib
import re

import pytest

from tastemill.llm import digest_tree as D

ROWS = [(4, "a  b"), (2, "a\tb"), (9, "a b"), (9, "a b"), (2, "a\tb"), (1, None), (3, ""), (5, " "), (None, "z"), (None, "z"), (None, "a b"), (7, "long " * 5000), (8, "a b\n")]


def brute(rows):
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for n, i in enumerate(ids):
            first = ids.index(keep) == n if keep in ids else False
            out.append((i, keep, len(ids), first, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("leaves", "fan_in"), [(1, 2), (16, 4), (None, 4)])
def test_equals_brute_force(spark, leaves, fan_in):
    docs = spark.createDataFrame([(t, i, "x", 1) for i, t in ROWS], "text string, doc_id long, node string, keep_id int")
    got = sorted(map(tuple, D.deduplicate(docs, leaves, fan_in).collect()), key=str)
    assert got == brute(ROWS)
    assert sum(r[3] for r in got) == len({r[4] for r in got})


def test_stage_and_empty(spark):
    docs = spark.createDataFrame([(t, i, "x") for i, t in ROWS], "text string, doc_id long, node string")
    kept = D.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len({b[4] for b in brute(ROWS)})
    assert D.deduplicate(docs.limit(0)).count() == 0 and D.keep_first(docs.limit(0)).count() == 0


def test_leaves_grow_with_rows():
    assert D.tree_leaves(0) == 256 and D.tree_leaves(10**7) == 256
    assert D.tree_leaves(10**11) * D.LEAF_ROWS >= 10**11


def test_stage_with_a_column_of_every_internal_name(spark):
    names = ["id", "mark", "kept", "row", "digest", "node", "least", "n", "group_size"]
    docs = spark.createDataFrame([(i, t, *range(len(names))) for i, t in ROWS], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    kept = D.keep_first(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in kept.collect()]
    assert len(got) == len({t for _, t in got}) == len({b[4] for b in brute(ROWS)})
    wanted = {b[4]: b[1] for b in brute(ROWS)}
    assert all(wanted[hashlib.sha256(t.encode()).hexdigest()] == i for i, t in got)
