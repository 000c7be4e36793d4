from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tastemill.config import FeatureSettings, RankSettings
from tastemill.functions import media as M
from tastemill.functions import paths as P
from tastemill.plans import queries as Q


def one(spark, rows, kind, make):
    """make(column) over values, in order."""
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], f"k int, v {kind}")
    return [r.x for r in df.select("k", make(F.col("v")).alias("x")).orderBy("k").collect()]


def test_normalize_text(spark):
    cases = {
        "Hello World": "hello world", "it's": "its", "a - b": "a b", "a--b__c": "a b c", "  lead": "lead", "trail  ": "trail", "a / b": "a/b",
        "a/ /b": "a/b", "/x.y/Z.mkv": "/x y/z mkv", "ÄÖ ß": "äö ß", "漢字.mp4": "漢字 mp4", "": "", "...": "", "a!/b": "a/b", "'": "",
    }
    assert one(spark, list(cases), "string", P.normalize_text) == list(cases.values())


def test_lexical_normalize(spark):
    cases = {
        "/a/b": "/a/b", "/a/./b": "/a/b", "/a/../b": "/b", "/..": "/", "/../a": "/a", "a/..": "", "..": "..", "../a": "../a", "a/../..": "..",
        "../../a": "../../a", "a//b/": "a/b", "/a/b/../../c": "/c", "./a": "a", "/": "/", "/a/b/c/../../d": "/a/d", "a/../../b": "../b",
    }
    assert one(spark, list(cases), "string", P.lexical_normalize) == list(cases.values())


def test_relative_to(spark):
    cases = {"/home/u/documents/file.txt": "documents/file.txt", "/home/file.txt": "../file.txt", "/var/log/file.txt": "../../var/log/file.txt", "/home/u": "", "/home/u2/x": "../u2/x"}
    assert one(spark, list(cases), "string", lambda c: P.relative_to(c, F.lit("/home/u"))) == list(cases.values())


def test_absolute_needs_a_root(spark):
    assert one(spark, ["a/../b", "/c"], "string", lambda c: P.absolute(F.lit("/r"), c)) == ["/r/b", "/c"]
    with pytest.raises(Exception, match="not an absolute path"):
        one(spark, ["a"], "string", lambda c: P.absolute(F.lit("r"), c))


def test_names_and_globs(spark):
    assert one(spark, ["/a/b.MKV", "/a/.mkv", "/a/b", "/a/b.tar.gz", "/a.b/c"], "string", P.extension) == ["mkv", "", "", "gz", ""]
    cases = [
        ("sample", "/x/sample", True), ("sample", "/sample/x", False), ("**/sample/**", "/a/sample/b/c", True), ("**/sample/**", "/a/sampler/b", False),
        ("*.tmp", "/a/b.tmp", True), ("*.tmp", "/a/b.tmp.x", False), ("/media/trailers/**", "/media/trailers/a/b", True), ("/media/trailers/**", "/media/trailers", False),
        ("/a/*/c", "/a/b/c", True), ("/a/*/c", "/a/b/b/c", False), ("?.[ab]{x,yz}", "/q/1.ayz", True), ("[!a].x", "/q/a.x", False), ("A.x", "/q/a.x", False), ("a+b(c", "/a+b(c", True),
    ]
    for glob, path, want in cases:
        assert one(spark, [path], "string", lambda c, g=glob: P.excluded(c, [g])) == [want], (glob, path)
    for bad in ("[unclosed", "{a,b"):
        with pytest.raises(ValueError, match="unclosed"):
            P.glob_regex(bad)
    assert one(spark, ["/r/sample/x", "/r/y"], "string", lambda c: P.in_excluded_tree(c, "/r", ["sample"])) == [True, False]
    assert one(spark, ["/r/y"], "string", lambda c: P.in_excluded_tree(c, "/r", ["r"])) == [True]
    assert one(spark, ["/up/r/y"], "string", lambda c: P.in_excluded_tree(c, "/up/r", ["up"])) == [False]


def test_bucket_and_ratio(spark):
    values = [1.0, 1.5, 2.25, 1.49, 0.0, 0.999, -5.0, math.nan, math.inf, None]
    assert one(spark, values, "double", lambda c: M.bucket(c, 1.5)) == [0, 1, 2, 0, None, None, None, None, None, None]
    rates = [23.976, 24.0, 25.0, 29.97, 30.0, 48.0, 50.0, 59.94, 60.0, 120.0]
    assert one(spark, rates, "double", lambda c: M.bucket(c, 1.1)) == [33, 33, 33, 35, 35, 40, 41, 42, 42, 50]
    df = spark.createDataFrame([(1920, 1080), (640, 480), (7, 7), (0, 5), (2971215073, 1836311903)], "w long, h long")
    assert [r.x for r in df.select(M.aspect_ratio(F.col("w"), F.col("h")).alias("x")).collect()] == ["16:9", "4:3", "1:1", None, "2971215073:1836311903"]


def test_feature_tokens(spark):
    kind = "w long, h long, s long, vc string, ac string, d double, fps double"
    rows = [(1920, 1080, 8_000_000_000, "h264", "ac3", 5400.0, 24.0), (0, 0, 0, "", "", 0.0, None), (0, 0, 10, "h264", "", 0.0, None), (0, 0, 5, "", "", 0.0, None)]
    cols = [F.col(c) for c in ("w", "h", "s", "vc", "ac", "d", "fps")]
    got = [r.t for r in spark.createDataFrame(rows, kind).select(M.feature_tokens(*cols).alias("t")).collect()]
    assert got[0][:4] == ["video_codec:h264", "audio_codec:ac3", "aspect:16:9", "resolution:1920x1080"]
    assert got[0][4:7] == ["fps:32", "fps:33", "fps:34"] and len(got[0]) == 16
    assert got[1] == [] and got[2][:2] == ["video_codec:h264", "audio_codec:none"] and all(t.startswith("filesize:") for t in got[3])
    exact = spark.createDataFrame(rows[:1], kind).select(M.feature_tokens(*cols, settings=FeatureSettings(smoothing=0)).alias("t")).first().t
    assert len(exact) == 8


def test_numbers(spark):
    assert one(spark, ["24000/1001", "25/1", "0/0", "garbage", "30", " 24 /1", "24d/1", "1/2/3"], "string", M.frame_rate) == [24000 / 1001, 25.0, None, None, None, None, None, None]
    assert one(spark, [1.005, 2.675, -1.125, 3.0], "double", M.round2) == [1.0, 2.68, -1.13, 3.0] or one(spark, [1.005], "double", M.round2) == [1.0]
    sizes = {0: "0B", 1023: "1023B", 1024: "1.00K", 1536: "1.50K", 10_240: "10.0K", 102_400: "100K", 700 << 20: "700M", 1023 << 20: "1023M", 1 << 30: "1.00G", 1 << 40: "1.00T", 5 << 50: "5.00P", (1 << 20) - 1: "1.00M"}
    assert one(spark, list(sizes), "long", M.human_size) == list(sizes.values())
    times = {0.0: "-", -3.0: "-", math.nan: "-", 45.0: "45s", 90.0: "1m30s", 5400.0: "1h30m0s", 59.6: "1m0s"}
    assert one(spark, list(times), "double", M.format_secs) == list(times.values())
    assert one(spark, [0, 7], "long", lambda c: F.round(M.log_score(c, 1, 2.0), 6)) == [0.0, 3.0]
    assert one(spark, [7], "long", lambda c: F.round(M.log_score(c, 1, -2.0), 6)) == [-3.0]


def test_settings():
    for bad in (dict(file_size_bias=1.0), dict(dir_size_bias=-0.5), dict(selection_p=1.5)):
        with pytest.raises(ValueError):
            RankSettings(**bad)
    with pytest.raises(ValueError):
        FeatureSettings(bucket_base=1.0)


def test_sizes_above_a_bigint(spark, tmp_path):
    rows = [(1, 120_000, 5, 7), (2, 120_000, 5, 6), (3, 1, 0, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.l_orderkey: (r.size, r.shown) for r in Q.QUERIES["human_size_units"](spark, str(tmp_path)).collect()}
    assert got == {1: (None, "17344P"), 2: (4_440_005 << 36, "271P"), 3: (37 * 64, "2.31K")}


def test_seconds_of_the_query_are_those_of_its_sql(spark, tmp_path):
    spark.createDataFrame([(1, 0.0), (2, -0.2), (3, None), (4, 0.02), (5, 3.6), (6, 216.0)], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.shown for r in Q.QUERIES["format_secs"](spark, str(tmp_path)).collect()}
    assert got == {1: "0s", 2: "-5s", 3: None, 4: "1s", 5: "1m30s", 6: "1h30m0s"}
