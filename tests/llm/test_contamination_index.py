from __future__ import annotations

import hashlib
import random
import re

import numpy as np

from tastemill.llm import contamination_index as C

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    out = []
    for i, text in docs:
        w = words(text)
        hit, names = set(), set()
        for name, item in items:
            b = words(item)
            for k in range(max(1, len(b) - window + 1)) if b else ():
                p = b[k : k + window]
                for j in range(len(w) - len(p) + 1):
                    if w[j : j + len(p)] == p:
                        hit.update(range(j, j + len(p)))
                        names.add("null" if name is None else str(name))
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(names), sha, bool(hit)))
    return sorted(out, key=str)


def material(seed):
    rnd = random.Random(seed)
    vocabulary = ["a", "b", "B", "ça", "x1", "wort"]
    text = lambda n: "".join(rnd.choice(vocabulary) + rnd.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(k, text(rnd.choice([3, 4, 10, 12, 30]))) for k in range(8)] + [(9, None), (10, ""), (11, "!!"), (None, text(11))]
    docs = [(k, text(rnd.randint(0, 60))) for k in range(30)]
    for k in range(30, 60):
        docs.append((k, text(rnd.randint(0, 9)) + rnd.choice(items)[1].__str__() + " " + text(5)))
    return [*docs, (60, None), (61, ""), (3, docs[3][1]), (None, docs[35][1])], items


def test_index_counts_and_locates():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 200))
        text = np.append(rng.integers(1, int(rng.integers(2, 40)), n), 0)
        index = C.FMIndex(text, int(rng.integers(1, 9)))
        patterns = [text[(s := int(rng.integers(0, n))) : min(n, s + int(rng.integers(1, 6)))] for _ in range(30)]
        rows = np.zeros((30, 6), np.int64)
        for k, p in enumerate(patterns):
            rows[k, : len(p)] = p[::-1]
        phrase, low, high = index.search(rows, np.array([len(p) for p in patterns]))
        assert phrase.tolist() == list(range(30))
        for p, a, b in zip(patterns, low, high, strict=True):
            want = [i for i in range(n) if text[i : i + len(p)].tolist() == p.tolist()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_report_equals_brute_force(spark):
    for seed in range(3):
        docs, items = material(seed)
        d = spark.createDataFrame([(t, i, 7) for i, t in docs], "text string, doc_id long, n_hit int")
        b = spark.createDataFrame(items, "item_id long, text string")
        want = brute(docs, items)
        assert sorted(map(tuple, C.report(d, b).collect()), key=str) == want
        assert sorted(map(tuple, C.report(d, b, block_chars=60).collect()), key=str) == want
        kept = C.keep_uncontaminated(d, b)
        assert kept.columns == d.columns and kept.count() == sum(not r[-1] for r in want)


def test_spans_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "x Über a-B c! d y"), (2, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(5, "A b C")], "item_id long, text string")
    assert [tuple(r) for r in C.removal_spans(d, b).collect()] == [(1, 7, 12)]
    assert C.report(d.limit(0), b).count() == 0
    assert not any(r.contaminated for r in C.report(d, b.limit(0)).collect())


def test_columns_of_internal_names_stay(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    rows = [(1, "x a b c d e f g h i j k y", 5, "s"), (2, "clean words here", 6, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found_words int, FOUND_spans string")
    kept = C.keep_uncontaminated(docs, bench)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [rows[1]]
