from __future__ import annotations

import pytest

from tastemill.llm.storage import table

pipeline = pytest.importorskip("corpus_pipeline")
SMALL = "/root/testdata/sf0.001"


def test_stages_and_rows(spark):
    docs = table(spark, SMALL, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    now, seen = docs, set(before)
    for name, stage in pipeline.STAGES[:-1]:
        out = pipeline.settled(stage(spark, now, SMALL), name)
        assert out.columns == docs.columns
        rows = out.collect()
        ids = {r.doc_id for r in rows}
        assert ids <= seen and len(rows) == len(ids) and all(before[r.doc_id] == r for r in rows)
        now, seen = out, ids
    last = {tuple(r) for r in pipeline.STAGES[-1][1](spark, now, SMALL).collect()}
    assert {r[0] for r in last} == seen and len(seen) > 0.5 * len(before)
    assert {tuple(r) for r in pipeline.run(spark, SMALL).collect()} == last
