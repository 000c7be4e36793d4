"""The whole pipeline over tables with nulls, empty and long texts, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tastemill.llm.storage import table

pipeline = pytest.importorskip("corpus_pipeline")
SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i}" for i in range(200_000))


def folder(spark, path, docs):
    """A folder of tables with ``docs`` for documents and the other two of the smallest ones."""
    docs.write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SMALL, name).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_odd_rows(spark, tmp_path):
    small = table(spark, SMALL, "documents")
    passage = table(spark, SMALL, "benchmark").orderBy("item_id").first().text
    near = [f"term{i}" for i in range(300)]
    odd = [
        (9001, None), (9002, ""), (9003, " \t"), (9004, " "), (9005, LONG), (9006, LONG + "\n"), (9007, "a b"), (9007, "a b"), (9008, "a  b"),
        (9009, " ".join(near)), (9010, " ".join([*near[:-1], "other"])), (None, "no id has this text"), (None, "no id has this text"), (9011, "x " + passage + " y"),
    ]
    # Extra columns, also of names that stages use themselves.
    names = ["extra", "id", "mark", "node", "digest", "rows", "component_id", "score", "predicted", "tokens", "n_hit", "keep_id", "kept"]
    extra = lambda df: df.withColumns({n: F.lit(n) for n in names})
    rows = extra(small.select("doc_id", "text", "lang", "source", "n_chars"))
    more = extra(spark.createDataFrame(odd, "doc_id long, text string").select("doc_id", "text", *(F.lit(None).cast(small.schema[c].dataType).alias(c) for c in ("lang", "source", "n_chars"))))
    path = folder(spark, tmp_path / "odd", rows.unionByName(more))
    now, kept = table(spark, path, "documents"), {}
    for name, stage in pipeline.STAGES[:-1]:
        out = pipeline.settled(stage(spark, now, path), name)
        assert out.columns == now.columns and all(r[n] == n for r in out.select(*names).distinct().collect() for n in names)
        kept[name] = sorted((r.doc_id or 0, hash(r.text)) for r in out.where("doc_id is null or doc_id > 9000").collect())
        now = out
    ids = {name: [i for i, _ in found] for name, found in kept.items()}
    assert ids["toxicity"] == sorted(i or 0 for i, _ in odd)  # clean documents stay
    # Null and empty are equal, so are white space alone, the long texts save for a blank at one's end, and 9007 with 9008.
    assert ids["exact_dedup"] == [0, 9001, 9003, 9005, 9006, 9007, 9009, 9010, 9011]
    assert ids["near_dedup"] == [0, 9001, 9003, 9005, 9007, 9009, 9011]
    assert ids["decontaminate"] == [0, 9001, 9003, 9005, 9007, 9009]
    last = {r.doc_id: r for r in pipeline.STAGES[-1][1](spark, now, path).collect()}
    text = {i: t or "" for i, t in reversed(odd)}
    for i in (None, 9001, 9003, 9005, 9007, 9009):
        assert last[i].decoded_sha256 == hashlib.sha256(text[i].encode()).hexdigest()
    assert last[9001].n_tokens == 0


def test_empty_tables(spark, tmp_path):
    path = folder(spark, tmp_path / "none", table(spark, SMALL, "documents").limit(0))
    out = pipeline.run(spark, path)
    assert out.count() == 0 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
