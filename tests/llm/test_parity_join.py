from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from tastemill.llm import parity_join as J
from tastemill.llm.graph import components


def brute(rows, k, num, den):
    """doc_id -> (n, component) by comparing all pairs; ids unique."""
    sets = {}
    for i, text in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\v\f\r":
            text = text.replace(c, " ")
        w = [x for x in text.split(" ") if x]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    find = lambda a: a if comp[a] == a else find(comp[a])
    for a, b in itertools.combinations(sets, 2):
        inter = len(sets[a] & sets[b])
        if inter and den * inter >= num * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            comp[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed, n_groups=25):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 4)))
    rows, at = [], 0
    for g in range(n_groups):
        base = [word() for _ in range(rnd.choice([1, 2, 3, 8, 12, 13, 20, 40, 90, 300]))]
        for _ in range(rnd.choice([1, 2, 5, 9])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, len(w) // 15])):
                w[rnd.randrange(len(w))] = word()
            if rnd.random() < 0.3:
                w = w[: len(w) - rnd.randint(0, len(w) // 12)]
            text = rnd.choice([" ", "\n", "  "]).join(w)
            rows.append((at * 7 % 1009, text.upper() if rnd.random() < 0.2 and text.isascii() else text))
            at += 1
    return [*rows, (5000, None), (5001, ""), (5002, " \t\n"), (5003, "one"), (5004, "ONE"), (5005, "one two")]


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_components_equal_brute_force(spark, monkeypatch, k, num, den):
    for seed, most in ((1, 4096), (2, 3)) if k == 3 else ((3, 1),):  # the others deal clusters to three and more chunks
        monkeypatch.setattr(J, "TASK_DOCS", most)
        monkeypatch.setattr(J, "KEY_SETS", 64 if seed == 1 else 3)
        rows = corpus(seed)
        docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_shingles int")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.linked_components(docs, k, (num, den)).collect()}
        assert got == brute(rows, k, num, den)


def shares_enough(a, b):
    """Whether two sets' keys make an edge."""
    x, y = (dict(zip(k.tolist(), n.tolist(), strict=True)) for k, n in (a, b))
    both = set(x) & set(y)
    if any(k & 128 for k in both):
        return True
    return any(sum(j & 127 == band for j in both) >= max(max(x[k], y[k]) for k in both if k & 127 == band) for band in {k & 127 for k in both})


def test_sketch_distance_is_a_lower_bound_and_a_block_agrees():
    rng = np.random.default_rng(2)
    shape = J.bands(90, 100)
    for _ in range(400):
        n = int(rng.integers(9, 400))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        cut = int(rng.integers(0, max(1, len(a) // 9)))
        b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, int(rng.integers(0, 3)), dtype=np.uint64)]))
        differ = len(np.setxor1d(a, b))
        blocks = 9
        unlike = sum(x != y for x, y in zip(J.sketch(a, blocks)[0], J.sketch(b, blocks)[0], strict=True))
        assert unlike <= differ
        inter = len(np.intersect1d(a, b))
        if 100 * inter >= 90 * len(np.union1d(a, b)) and differ:
            assert shares_enough(J.block_keys(a, shape), J.block_keys(b, shape))


def test_empty_blocks_lose_no_link(monkeypatch):
    # Sketches with many more blocks than elements: most blocks are empty, and often the only ones that agree.
    monkeypatch.setattr(J.Bands, "shape", lambda self, band: (60, 25))
    rng = np.random.default_rng(3)
    for _ in range(40):
        a = np.unique(rng.integers(0, 2**63, 35, dtype=np.uint64))
        b = np.unique(rng.integers(0, 2**63, 35, dtype=np.uint64))
        monkeypatch.setattr(J.Bands, "of", lambda self, n: [3])
        (x, ex), (y, ey) = J.sketch(a, 60), J.sketch(b, 60)
        agree = int((x == y).sum())
        monkeypatch.setattr(J.Bands, "shape", lambda self, band, r=agree: (60, max(2, r)))
        if 2 <= agree and ex.sum() < agree + 8 and ey.sum() < agree + 8:
            assert shares_enough(J.block_keys(a, J.bands(80, 100)), J.block_keys(b, J.bands(80, 100)))


def test_local_links_equal_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(150):
        base = rng.integers(0, 2**63, 60, dtype=np.uint64)
        sets = []
        for _ in range(int(rng.integers(2, 14))):
            s = base.copy()
            for _ in range(int(rng.integers(0, 7))):
                s[rng.integers(0, 60)] = rng.integers(0, 90, dtype=np.uint64)
            sets.append(np.unique(s[: 60 - int(rng.integers(0, 4))]))
        comp = list(range(len(sets)))
        for a, b in itertools.combinations(range(len(sets)), 2):
            if 100 * len(np.intersect1d(sets[a], sets[b])) >= 90 * len(np.union1d(sets[a], sets[b])):
                comp = [comp[a] if c == comp[b] else c for c in comp]
        mine = list(range(len(sets)))
        for a, b in J.local_links(sets, 90, 100):
            assert comp[a] == comp[b]
            mine = [mine[a] if c == mine[b] else c for c in mine]
        assert len(set(mine)) == len(set(comp))


def test_graph_components(spark):
    rnd = random.Random(9)
    edges = [(k, k + 1) for k in range(40)] + [(100 + k, 100 + rnd.randrange(max(1, k))) for k in range(50)] + [(500, 500), (700, 701), (701, 700)]
    got = {r.v: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(50)} | {700: 700, 701: 700}


def test_ids_of_any_type_and_repeated_ids(spark):
    one, two = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    near = lambda t, w: t.rsplit(" ", 1)[0] + " " + w
    rows = [("1", one), ("1", two), ("2", near(two, "x")), ("3", near(one, "y")), ("4", "c d e f"), ("5", near(one, "z")), ("5", "g h i j"), ("6", near(two, "w"))]
    docs = spark.createDataFrame([(i, t, i, 0) for i, t in rows], "doc_id string, text string, mark string, d1 int")
    got = sorted((r.doc_id, r.component_id) for r in J.linked_components(docs, 3, (90, 100)).collect())
    assert got == [("1", "1"), ("1", "1"), ("2", "1"), ("3", "1"), ("4", "4"), ("5", "1"), ("5", "5"), ("6", "1")]
    kept = J.keep_representatives(docs, 3, (90, 100))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text[:1]) for r in kept.collect()) == [("1", "a"), ("1", "b"), ("4", "c"), ("5", "g")]


def test_rest_of_a_cluster_of_many_chunks(spark, monkeypatch):
    """Two near groups that share a key only: the second is the rest and is compared with every chunk."""
    monkeypatch.setattr(J, "TASK_DOCS", 5)
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        cut = 40 if i % 3 == 0 else 0  # every third text has another end
        w[200 - cut :] = [f"z{k}" for k in range(cut)]
        w[rnd.randrange(100)] = f"v{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.linked_components(docs, 3, (90, 100)).collect()}
    assert got == brute(rows, 3, 90, 100) and len({c for _, c in got.values()}) > 1


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (0, "a b  c\nD"), (7, None)], "doc_id long, text string")
    got = sorted(map(str, J.linked_components(docs, 3, (90, 100)).collect()))
    want = [(1, 2, 0), (1, 2, 0), (None, 2, None), (0, 2, 0), (7, 0, 7)]
    assert got == sorted(f"Row(doc_id={a}, n_shingles={b}, component_id={c})" for a, b, c in want)
    assert J.linked_components(docs.limit(0)).count() == 0
    kept = J.keep_representatives(docs, 3, (90, 100))
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["0", "7", "None"]


@pytest.mark.parametrize("sieved", [1 << 24, 0])
def test_keys_are_matched_in_parts(spark, monkeypatch, sieved):
    monkeypatch.setattr(J, "PART_BYTES", 1, raising=False)
    monkeypatch.setattr(J, "SIEVED", sieved)
    sizes, settled = [], J.settled
    monkeypatch.setattr(J, "settled", lambda df, label, made=None: (out := settled(df, label, made), sizes.append(out.count()) if label == "shared" else None)[0])
    rows = corpus(5)
    got = J.linked_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, (90, 100)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 90, 100)
    assert len(sizes) == J.MOST_PARTS and 0 < max(sizes) < sum(sizes) / 3
