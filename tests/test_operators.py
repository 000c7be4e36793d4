from __future__ import annotations

import itertools
import json
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tastemill.config import RankSettings
from tastemill.functions.paths import normalize_text
from tastemill.operators import bayes, bpe, cache, ngrams, playlist, ranking
from tastemill.plans import library as L
from tastemill.plans import queries as Q
from tastemill.plans import ranking as R
from tastemill.sources import files as FS
from tastemill.sources import probe
from tastemill.streaming import labels as S

SMALL = "/root/testdata/sf0.001"


def test_windows_and_combinations(spark):
    df = spark.createDataFrame([(["<ROOT>", "a", "b", "c", "<EOL>"],), (["a"],), ([],)], "t array<string>")

    def rows(make):
        return [sorted(map(tuple, r.x)) for r in df.select(make(F.col("t")).alias("x")).collect()]

    for k, sizes in ((0, [0, 0, 0]), (1, [3, 1, 0]), (2, [6, 1, 0]), (3, [7, 1, 0])):
        got = rows(lambda c, k=k: ngrams.combinations(c, k))
        assert [len(x) for x in got] == sizes
        want = {tuple(sorted(c)) for n in range(1, k + 1) for c in itertools.combinations("abc", n)}
        assert set(got[0]) == want
    full = ["<ROOT>", "a", "b", "c", "<EOL>"]
    for w in (0, 1, 2, 5, 7):
        want = {tuple(full[i : i + n]) for n in range(1, w + 1) for i in range(len(full) - n + 1)}
        assert set(rows(lambda c, w=w: ngrams.windows(c, w))[0]) == want
    twice = spark.createDataFrame([(["x", "x"],)], "t array<string>").select(ngrams.combinations(F.col("t"), 2).alias("x")).first().x
    assert sorted(map(tuple, twice)) == [("x",), ("x", "x")]


def whole_string_training(texts):
    """The merge rule over whole token strings, with all counts made anew for each merge."""
    vocabulary = list(bpe.SPECIAL)
    for t in texts:
        for c in t:
            if c not in vocabulary:
                vocabulary.append(c)
    rows = [[bpe.ROOT, *(vocabulary.index(c) for c in t), bpe.EOL] for t in texts]
    merges, least = [], max(2, int(math.log2(len(texts) + 1)))
    while True:
        counts = {}
        for r in rows:
            for p in zip(r, r[1:], strict=False):
                if min(p) >= len(bpe.SPECIAL):
                    counts[p] = counts.get(p, 0) + 1
        best = max(((n, *p) for p, n in counts.items()), default=(0, 0, 0))
        if best[0] < least:
            return vocabulary, merges
        text = vocabulary[best[1]] + vocabulary[best[2]]
        if text not in vocabulary:
            vocabulary.append(text)
        merges.append((best[1], best[2], vocabulary.index(text)))
        rows = [bpe.replaced(r, *merges[-1]) for r in rows]


def test_segment_training_equals_whole_strings(spark):
    rnd = random.Random(2)
    for n in (1, 12, 60):
        texts = sorted("".join(rnd.choice("abc /") for _ in range(rnd.randint(0, 14))) for _ in range(n))
        vocabulary, merges = whole_string_training(texts)
        t = bpe.train(spark.createDataFrame([(x,) for x in texts], "text string"))
        assert list(t.vocabulary) == vocabulary and list(t.merges) == merges
        got = {r.text: r.tokens for r in bpe.tokenize(spark.createDataFrame([(x,) for x in texts], "text string"), t).collect()}
        for x in texts:
            row = [bpe.ROOT, *(vocabulary.index(c) for c in x), bpe.EOL]
            for m in merges:
                row = bpe.replaced(row, *m)
            assert got[x] == row
    assert bpe.train(spark.createDataFrame([], "text string")).merges == ()


def test_small_tokenizer_example(spark):
    df = spark.createDataFrame([("hello world",)] * 10, "text string")
    t = bpe.train(df)
    assert [t.vocabulary[i] for i in bpe.tokenize(df, t).first().tokens] == ["<ROOT>", "hello", " ", "world", "<EOL>"]
    assert bpe.tokenize(spark.createDataFrame([("q",)], "text string"), t).first().tokens == [bpe.ROOT, bpe.UNK, bpe.EOL]


def test_score_equals_the_sum_over_ngrams(spark):
    pairs = [(1, ["a"]), (1, ["b"]), (2, ["a"]), (3, ["c"]), (3, ["a"])]
    p = spark.createDataFrame(pairs, "doc_id long, ngram array<string>")
    labels = spark.createDataFrame([(1, 1), (2, -1), (2, -1), (3, 0)], "doc_id long, s int")
    model = bayes.train_counts(p, labels, "doc_id")
    sums = bayes.totals(model, labels)
    assert tuple(sums.first()) == (1, 3, 2, 4, 3)
    entries = spark.createDataFrame([(1,), (7,)], "doc_id long")
    got = {r.doc_id: r.naive_bayes for r in bayes.score(entries, p, model, sums, "doc_id").collect()}
    lp = lambda c, t: math.log((1 + c) / (t + 3))
    base = math.log(2 / 6) - math.log(4 / 6)
    assert got[1] == pytest.approx(base + lp(1, 2) - lp(3, 4) + lp(1, 2) - lp(0, 4))
    assert got[7] == pytest.approx(base)
    none = bayes.train_counts(p, labels.limit(0), "doc_id")
    assert all(r.naive_bayes == 0 for r in bayes.score(entries, p, none, bayes.totals(none, labels.limit(0)), "doc_id").collect())


def test_ngrams_of_every_entry(spark):
    data = R.corpus(L.files(spark, SMALL), L.labels(spark, SMALL), Q.SETTINGS)
    texts = {(r.doc_id, 0): r.text for r in data.candidates.collect()} | {(r.doc_id, 1): r.text for r in data.labelled.collect()}
    assert {l for _, l in texts} == {0, 1}
    runs, combined = {}, {}
    for key, text in texts.items():
        t = [ngrams.ROOT, *re.findall(r"[ /]|[^ /]+", text), ngrams.EOL]
        plain = [x for x in t if x not in ngrams.SPECIAL]
        runs[key] = "\n".join(sorted({"|".join(t[i : i + n]) for n in range(1, 6) for i in range(len(t) - n + 1)}))
        combined[key] = "\n".join(sorted({"|".join(sorted(c)) for n in (1, 2) for c in itertools.combinations(plain, n)}))
    for name, wanted in (("ngram_windows_all", runs), ("ngram_combinations_all", combined)):
        assert {(r.doc_id, r.l): r.ngrams for r in Q.QUERIES[name](spark, SMALL).collect()} == wanted


def test_minmax_keeps_constant_columns(spark):
    df = spark.createDataFrame([(1, 5.0, 2.0), (2, 7.0, 2.0)], "k int, a double, b double")
    assert sorted(tuple(r) for r in ranking.minmax(df, ["a", "b"]).collect()) == [(1, 0.0, 2.0), (2, 1.0, 2.0)]


def test_picks(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 0.5)], "path string, score double")
    assert ranking.next_pick(df).first().path == "a"
    assert {ranking.next_pick(df, 0.3, seed).first().path for seed in range(30)} == {"a", "b", "c"}
    assert [r.filename for r in ranking.listing(df).collect()] == ["c", "a", "b"]


def test_rank_without_labels_or_scorers(spark):
    files, labels = L.files(spark, SMALL), L.labels(spark, SMALL)
    rows = R.rank(R.corpus(files, labels.limit(0)), RankSettings(), L.NOW).collect()
    assert rows and all(r.score == 0 for r in rows)
    some = R.rank(R.corpus(files, labels, RankSettings(include_classified=True, exclude=("*.avi",))), RankSettings(file_size_bias=2.0), L.NOW)
    assert all(not r.path.endswith(".avi") and 0 <= r.file_size <= 1 for r in some.collect())


def test_feature_ngrams_stay_apart(spark):
    df = spark.createDataFrame([(["x"], ["f:1", "f:2"])], "t array<string>, f array<string>")
    got = {tuple(g) for g in df.select(ngrams.build(F.col("t"), 1, 2, F.col("f"), 2).alias("x")).first().x}
    assert got == {("x",), ("f:1",), ("f:2",), ("f:1", "f:2")}
    assert df.select(ngrams.build(F.col("t"), 1, 2, F.col("f"), 0).alias("x")).first().x == [["x"]]


def test_cache_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    f = {"w": 1280, "h": 720, "s": 1234, "vc": "h264", "ac": "aac", "d": 100.5}
    lines = [json.dumps({"k": "a", "u": 5, "f": f}), json.dumps({"key": "a", "last_used": 9, "features": {**f, "fps": 24.0, "new": 1}}), "garbage", json.dumps({"k": "b", "u": 1, "f": {"w": 1}}), "", json.dumps({"k": "c", "u": 100, "f": f})]
    os.makedirs(tmp_path / "c/gen=3")
    (tmp_path / "c/gen=3/x.jsonl").write_text("\n".join(lines))
    got = cache.read(spark, root)
    assert {r.k: (r.u, r.f.fps) for r in got.collect()} == {"a": (9, 24.0), "c": (100, None)}
    keys = spark.createDataFrame([("a",), ("z",)], "k string")
    kept = cache.compact(got, keys, 200, 0)
    assert {r.k: r.u for r in kept.collect()} == {"a": 200, "c": 100}  # a limit of 0 days drops nothing
    assert {r.k: r.u for r in cache.compact(got, keys, 100 + 86_399, 1).collect()} == {"a": 100 + 86_399, "c": 100}
    assert {r.k for r in cache.compact(got, keys, 100 + 86_400, 1).collect()} == {"a"}
    assert [r.k for r in cache.missing(keys, kept).collect()] == ["z"]
    fresh = keys.select("k", F.lit(300).cast("long").alias("u"), cache.default_media().alias("f"))
    merged = cache.merge(kept, fresh)
    assert {r.k: (r.u, r.f.w) for r in merged.collect()} == {"a": (300, 0), "c": (100, 1280), "z": (300, 0)}
    cache.write_generation(spark.createDataFrame(got.collect(), got.schema), root)
    assert [p.name for p in (tmp_path / "c").iterdir()] == ["gen=4"]
    assert {r.k: (r.u, r.f.fps) for r in cache.read(spark, root).collect()} == {"a": (9, 24.0), "c": (100, None)}


def test_cache_without_expiry(spark):
    entries = spark.createDataFrame([("a", 9, (1, 1, 1, "", "", 1.0, None)), ("c", 100, (2, 1, 1, "", "", 1.0, None))], f"k string, u long, f {cache.MEDIA}")
    keys = spark.createDataFrame([("a",), ("z",)], "k string")
    kept = cache.compact(entries, keys, 10**9, 0)
    assert {r.k: (r.u, r.f.w) for r in kept.collect()} == {"a": (10**9, 1), "c": (100, 2)}
    assert [r.k for r in cache.missing(keys, kept).collect()] == ["z"]
    fresh = keys.select("k", F.lit(300).cast("long").alias("u"), cache.default_media().alias("f"))
    assert {r.k: (r.u, r.f.w) for r in cache.merge(kept, fresh).collect()} == {"a": (300, 0), "c": (100, 2), "z": (300, 0)}


def test_label_file(spark, tmp_path):
    FS.register(spark)
    (tmp_path / "a b.mkv").touch()
    store = playlist.LabelFile(str(tmp_path / "l.m3u"))
    store.append(spark, [(str(tmp_path / "a b.mkv"), 1, 50), (str(tmp_path / "sub/c.mkv"), -1, 60), (str(tmp_path / "gone.mkv"), 1, 70)])
    text = (tmp_path / "l.m3u").read_text().split("\n")
    assert text[0] == "#EXTM3U" and text[2] == "a b.mkv" and json.loads(text[1][1:])["f"] == "a b.mkv" and len(text) == 6
    with open(tmp_path / "l.m3u", "a") as f:
        f.write("# a comment\nforeign.mkv\n" + '#{"f":"x/../y.mkv","a":1,"s":1,"z":0}\n')
    entries = store.entries(spark)
    assert [(r.f, r.a, r.s) for r in entries.orderBy("pos").collect()] == [("a b.mkv", 50, 1), ("sub/c.mkv", 60, -1), ("gone.mkv", 70, 1), ("x/../y.mkv", 1, 1)]
    assert [r.path for r in playlist.listed(entries, str(tmp_path), True).collect()] == [f"{tmp_path}/{n}" for n in ("a b.mkv", "gone.mkv", "y.mkv")]
    moved = playlist.rebased(entries, str(tmp_path), str(tmp_path / "sub"))
    assert {r.f for r in moved.collect()} == {"../a b.mkv", "c.mkv", "../gone.mkv", "../y.mkv"}
    assert store.reconcile(spark) and not store.reconcile(spark)
    assert "comment" not in (tmp_path / "l.m3u").read_text()
    with open(tmp_path / "l.m3u", "a") as f:
        f.write('#{"f":"x","a":1}\n')
    with pytest.raises(Exception, match="bad label line"):
        store.entries(spark).collect()
    (tmp_path / "bad.m3u").write_text("no\n")
    with pytest.raises(ValueError, match="does not begin"):
        playlist.LabelFile(str(tmp_path / "bad.m3u"))


def test_file_scan(spark, tmp_path):
    for p in ("a.mkv", ".hidden.MKV", ".mkv", "_u.mkv", "b.txt", "d/c.mkv", "d/sample/x.mkv", "d/e/f.mkv"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("xy")
    (tmp_path / "link.mkv").symlink_to(tmp_path / "a.mkv")
    rows = FS.scan(spark, [str(tmp_path), str(tmp_path / "d/e"), str(tmp_path / "none")], ["mkv"], ["sample"]).collect()
    got = sorted(os.path.relpath(r.path, tmp_path) for r in rows)
    assert got == sorted([".hidden.MKV", "_u.mkv", "a.mkv", "d/c.mkv", "d/e/f.mkv", "d/e/f.mkv"])
    assert all(r.size == 2 and r.mtime is not None for r in rows)
    assert FS.scan(spark, [str(tmp_path)], [], ["/" + str(tmp_path).strip("/")]).count() == 0


def test_probe(spark):
    video = {"codec_type": "video", "codec_name": "h264", "width": 1920, "height": 1080, "avg_frame_rate": "24000/1001"}
    audio = {"codec_type": "audio", "codec_name": "aac"}
    cases = {
        "ok": {"format": {"duration": "100.567"}, "streams": [audio, video, {"codec_type": "audio", "codec_name": "mp3"}]},
        "silent": {"format": {"duration": "1"}, "streams": [{**video, "avg_frame_rate": "0/0"}]},
        "novideo": {"format": {"duration": "1"}, "streams": [audio]},
        "nosize": {"format": {"duration": "1"}, "streams": [{"codec_type": "video"}]},
        "noduration": {"streams": [video]},
        "badduration": {"format": {"duration": "x"}, "streams": [video]},
    }

    def call(path):
        if path == "fails":
            raise OSError("no such program")
        return json.dumps(cases[path]) if path != "broken" else "{"

    files = spark.createDataFrame([(p, 7) for p in (*cases, "fails", "broken")], "path string, size long")
    got = {r.path: r for r in probe.extract(probe.probe(files, call)).collect()}
    assert tuple(got["ok"].media) == (1920, 1080, 7, "h264", "aac", 100.57, 23.98) and got["ok"].reason is None
    assert got["silent"].media.fps is None and got["silent"].media.ac == ""
    assert {p: got[p].reason for p in got if got[p].media is None} == {"novideo": "no video stream", "nosize": "no size", "noduration": "no duration", "badduration": "bad duration", "fails": "no such program", "broken": "bad JSON"}


def test_state_machine():
    def play(answers, attempts=3):
        state, left = S.WAITING, attempts
        for status, file in answers:
            state, left, label = S.step(state, left, status, file, "w")
            if label:
                return label
        return None

    assert play([("playing", "x"), ("playing", "w"), ("playing", "w"), ("stopped", "w")]) == "Positive"
    assert play([("playing", "w"), ("paused", "w")]) == "Negative"
    assert play([("playing", "w"), (None, None)]) == "Skipped"
    assert play([(None, None)] * 3) == "Skipped" and play([(None, None)] * 2) is None


def test_streamed_counts_equal_batch(spark):
    batch = {r.ngram: (r.cp, r.cn) for r in Q.QUERIES["nb_train_counts"](spark, SMALL).collect()}
    assert {r.ngram: (r.cp, r.cn) for r in Q.QUERIES["stream_incremental_nb"](spark, SMALL).collect()} == batch
    assert {r.label for r in Q.QUERIES["stream_status_fsm"](spark, SMALL).collect()} <= {"Positive", "Negative", "Skipped"}


def test_build_loop_equals_one_pass_and_survives_a_repeated_batch(spark, tmp_path):
    data = R.corpus(L.files(spark, SMALL), L.labels(spark, SMALL).where("doc_id % 2 = 0"), Q.SETTINGS)
    late = L.labels(spark, SMALL).where("doc_id % 2 = 1")
    loops = [S.Build(data, Q.SETTINGS, L.NOW, f"file://{tmp_path}/{k}") for k in range(2)]
    for number, part in enumerate((late.where("doc_id % 3 = 0"), late.where("doc_id % 3 <> 0"), late.where("doc_id % 3 = 0"))):
        loops[0].fold(part, number)  # the third batch brings labels that are known
        if number == 1:
            loops[0].fold(part, number)
    loops[1].fold(late, 0)
    got, whole = ({r.doc_id: round(r.score, 9) for r in loop.ranked(spark).collect()} for loop in loops)
    assert got == whole and got
    known = {r.doc_id for r in L.labels(spark, SMALL).collect()}
    assert not known & set(got) and loops[0].picks(spark).count() == 3
    best = min(got, key=lambda i: (-got[i], i))
    assert got[loops[0].picks(spark).where("batch = 2").first().doc_id] == got[best]


def test_functions_for_sql(spark):
    from tastemill.functions import sql

    sql.register(spark)
    r = spark.sql("SELECT normalize_path(\"/A b's--C/ x\") a, geometric_bucket(2.25D, 1.5D) b, geometric_bucket(0.5D, 1.5D) c, log_score(99D, 1, 10D) d, log_score(99D, 1, -10D) e").first()
    assert (r.a, r.b, r.c, round(r.d, 9), round(r.e, 9)) == ("/a bs c/x", 2, None, 2.0, -2.0)
    tokenizer = bpe.train(spark.createDataFrame([("hello world",)] * 10, "text string"))
    sql.register_tokenizer(spark, tokenizer)
    assert spark.sql("SELECT array_join(token_strings('hello world'), ',') t").first().t == "<ROOT>,hello, ,world,<EOL>"


def test_every_query_has_rows_and_plain_columns(spark):
    import __spark_entry__ as entry

    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known) and len(Q.QUERIES) >= 35
    assert entry.entry(spark).count() > 0
    plain = spark.createDataFrame([("A b",)], "t string").select(normalize_text(F.col("t")).alias("x")).first().x
    assert plain == "a b"
