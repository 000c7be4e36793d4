from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tastemill.llm import toxicity_pu as T


def corpus(n=1500):
    rnd = random.Random(1)
    plain = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = rnd.choices(plain, k=rnd.randint(5, 80))
        toxic = int(rnd.random() < 0.15)
        if toxic:
            for _ in range(rnd.randint(2, 5)):
                words.insert(rnd.randrange(len(words)), rnd.choice(["snarvel", "wugmox", "Zrrkton"]))
        rows.append((i, " ".join(words)))
        if rnd.random() < 0.6:
            labels.append((i, 1, toxic))
    return rows, labels, {i for i, _, y in labels if y}


def test_grams_of_pieces_equal_those_of_the_whole(monkeypatch):
    texts = [b"", None, b"abc", b"Hello, World! " * 40, "é漢".encode() * 100, b"x" * 999]
    whole = set(zip(*map(list, T.gram_columns(texts)), strict=True))
    monkeypatch.setattr(T, "CHUNK", 37)
    assert set(zip(*map(list, T.gram_columns(texts)), strict=True)) == whole
    wanted = np.zeros(1 << T.BITS, bool)
    some = [c for _, c in sorted(whole)[::7]]
    wanted[some] = True
    assert set(zip(*map(list, T.gram_columns(texts, wanted)), strict=True)) == {k for k in whole if k[1] in set(some)}


def test_held_out_accuracy(spark):
    rows, labels, _ = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in T.score(docs, T.train(docs, marks)).collect()}
    test = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % T.FOLDS == 0]
    assert np.mean([(got[i] >= 0.5) == y for i, y in test]) > 0.97


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (3, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = T.train(docs, none)
    assert sorted(r.score for r in T.score(docs, model).collect()) == [0.0] * 4
    assert T.keep_clean(docs, model).count() == 4
    assert T.score(docs.limit(0), model).count() == 0
    r = docs.select("doc_id", T.held_out(docs.doc_id).alias("h")).distinct().collect()
    assert {x.doc_id: x.h for x in r} == {i: i is None or zlib.crc32(str(i).encode()) % 5 == 0 for i in (1, None, 3)}


def test_stage_keeps_columns(spark):
    rows, labels, toxic = corpus(600)
    docs = spark.createDataFrame([(t, i, 0.5) for i, t in rows], "text string, doc_id long, score double")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = T.keep_clean(docs, T.train(docs, marks))
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()}
    assert len(toxic & left) <= 0.1 * len(toxic) and len(left) > 450


@pytest.mark.parametrize("prior", [0.1, 0.3])
def test_risk_never_counts_below_zero(prior):
    rng = np.random.default_rng(0)
    rows = [rng.choice(500, 30, replace=False).astype(np.int32) for _ in range(300)]
    model = T.fit(rows, np.array([1] * 100 + [0] * 200), prior)
    assert np.isfinite(model.weights).all() and np.isfinite(model.bias)


def test_risk_and_gradient_equal_a_plain_loop():
    import math

    rng = np.random.default_rng(3)
    kept = [rng.choice(6, rng.integers(0, 5), replace=False) for _ in range(30)]
    y = np.array([1] * 10 + [0] * 20)
    cols, where = np.concatenate(kept), np.repeat(np.arange(30), [len(r) for r in kept])

    def plain(w, b, prior):
        z = [sum(w[c] for c in r) + b for r in kept]
        called_clean = lambda x: math.log1p(math.exp(x))
        p = [x for x, k in zip(z, y, strict=True) if k]
        u = [x for x, k in zip(z, y, strict=True) if not k]
        clean = sum(map(called_clean, u)) / len(u) - prior * sum(map(called_clean, p)) / len(p)
        return prior * sum(called_clean(-x) for x in p) / len(p) + max(0.0, clean), clean

    held = 0
    for _ in range(40):
        w, b, prior = rng.normal(size=6) * 2, float(rng.normal()) * 2, float(rng.uniform(0.05, 0.95))
        value, slope, lift = T.risk(w, b, cols, where, y, prior)
        wanted, clean = plain(w, b, prior)
        held += clean < 0
        assert abs(value - wanted) < 1e-9
        for k in range(7):
            dw, db = np.eye(7)[k, :6] * 1e-6, 1e-6 * (k == 6)
            rise = (plain(w + dw, b + db, prior)[0] - plain(w - dw, b - db, prior)[0]) / 2e-6
            assert abs(rise - (slope[k] if k < 6 else lift)) < 1e-5
    assert held  # cases where the clean part is held at zero


def test_table_sample_equals_the_same_in_memory(spark):
    rows, labels, _ = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    names, kept, y, prior = T._sample(docs, marks, 1000, 1000)
    toxic = {i for i, _, t in labels if t and zlib.crc32(str(i).encode()) % 5}
    texts = dict(rows)
    own = [texts[i] for i in toxic] + [t for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    mine = [T.gram_columns([t.encode()])[1] for t in own]
    whole = np.array([1] * len(toxic) + [0] * (len(own) - len(toxic)))
    count = lambda k: np.bincount(np.concatenate([m for m, z in zip(mine, whole, strict=True) if z == k]), minlength=1 << T.BITS)
    assert names.tolist() == T.clear_columns(count(1), count(0), len(toxic), len(own) - len(toxic)).tolist()
    assert sorted(zip(y.tolist(), map(tuple, kept), strict=True)) == sorted((int(z), tuple(np.flatnonzero(np.isin(names, m)))) for m, z in zip(mine, whole, strict=True))
    assert 0 < prior < 0.3


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 600_000), (2, "x" * 3_000_000)], "doc_id long, text string")
    rows, labels, _ = corpus(300)
    model = T.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert all(0 <= r.score <= 1 for r in T.score(docs, model).collect())
