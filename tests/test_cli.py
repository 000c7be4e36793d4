from __future__ import annotations

import json

from tastemill import cli


def test_commands(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    for name in ("good one.mkv", "good two.mkv", "bad one.mkv", "bad two.mkv", "good three.mkv", "bad three.mkv", "skip.txt"):
        (tmp_path / name).write_text(name)
    run = lambda *argv: cli.run(spark, cli.parser().parse_args(list(argv)))
    store = cli.playlist.LabelFile(str(tmp_path / "l.m3u"))
    store.append(spark, [(f"{tmp_path}/{n}.mkv", s, 5) for n, s in (("good one", 1), ("good two", 1), ("bad one", -1), ("bad two", -1), ("good one", 1))])
    lines = run("score", "l.m3u", ".")
    assert lines[0] == "SCORE\tFILENAME" and [x.split("\t")[1] for x in lines[1:]] == ["bad three.mkv", "good three.mkv"]
    assert lines[1].startswith("0.000") and lines[2].startswith("1.000")
    rows = json.loads(run("score", "l.m3u", ".", "--json", "--reverse", "--include-size", "--absolute", "--file-size-bias", "2")[0])
    assert [r["filename"] for r in rows][0].endswith("/good three.mkv") and rows[0]["size"] == len("good three.mkv")
    assert run("score", "l.m3u", ".", "--by-dir", "--no-header", "--include-classified")[0].split("\t")[1:] == ["6", "73", ""]
    assert run("list-positive", "l.m3u") == ["good one.mkv", "good two.mkv", "good one.mkv"]
    assert run("list-negative", "l.m3u", "--absolute") == [f"{tmp_path}/bad one.mkv", f"{tmp_path}/bad two.mkv"]
    (tmp_path / "sub").mkdir()
    run("move", "l.m3u", "sub/n.m3u")
    assert run("list-positive", "sub/n.m3u")[0] == "good one.mkv" and "../good one.mkv" in (tmp_path / "sub/n.m3u").read_text()
    assert run("reconcile", "sub/n.m3u") == ["unchanged"]


def test_move_keeps_time_score_and_features(spark, tmp_path):
    media = {"w": 1280, "h": 720, "s": 1234, "vc": "h264", "ac": "aac", "d": 100.5}
    entries = [{"f": "a.mkv", "a": 5, "s": 1, "m": {**media, "fps": 24.0}}, {"f": "b.mkv", "a": 6, "s": -1, "m": media}, {"f": "c.mkv", "a": 7, "s": 1}]
    (tmp_path / "l.m3u").write_text("#EXTM3U\n" + "".join(f"#{json.dumps(e)}\n" for e in entries))
    (tmp_path / "sub").mkdir()
    cli.run(spark, cli.parser().parse_args(["move", str(tmp_path / "l.m3u"), str(tmp_path / "sub/n.m3u")]))
    got = [json.loads(x[1:]) for x in (tmp_path / "sub/n.m3u").read_text().split("\n")[1:] if x.startswith("#")]
    zero = {"w": 0, "h": 0, "s": 0, "vc": "", "ac": "", "d": 0.0}
    assert got == [{**e, "f": "../" + e["f"], "m": e.get("m", zero)} for e in entries]


def test_score_fills_the_cache(spark, tmp_path):
    lib = tmp_path / "lib"
    lib.mkdir()
    for name in ("one.mkv", "two.mkv", "bad.mkv"):
        (lib / name).write_text(name)
    calls, root = tmp_path / "calls", tmp_path / "cache"
    calls.touch()

    def call(path):
        with open(calls, "a") as f:
            f.write(path + "\n")
        if path.endswith("bad.mkv"):
            raise OSError("broken")
        return json.dumps({"format": {"duration": "9"}, "streams": [{"codec_type": "video", "codec_name": "h264", "width": 640, "height": 480}]})

    (root / "gen=1").mkdir(parents=True)
    f = {"w": 1, "h": 1, "s": 1, "d": 1.0}
    (root / "gen=1/x.jsonl").write_text(json.dumps({"k": "gone", "u": 5, "f": f}) + "\n")

    keyed = spark.createDataFrame([(n, str(lib / n), 7) for n in ("one.mkv", "two.mkv", "bad.mkv")], "k string, path string, size long").coalesce(1)

    def run(*more):
        calls.write_text("")
        a = cli.parser().parse_args(["score", str(tmp_path / "l.m3u"), str(lib), "--cache", str(root), *more])
        kept = {r.k: r.f.w for r in cli._populated(spark, keyed, a.cache, cli.settings(a), 10**9, call).collect()}
        return sorted(p.rsplit("/", 1)[1] for p in calls.read_text().split()), kept

    seen, kept = run("--cache-ttl-days", "0")
    assert seen == ["bad.mkv", "one.mkv", "two.mkv"] and sorted(kept.values()) == [1, 640, 640] and "gone" in kept
    seen, kept = run()  # what failed is tried again, what expired goes
    assert seen == ["bad.mkv"] and sorted(kept.values()) == [640, 640]
    assert [p.name for p in root.iterdir()] == ["gen=3"]
