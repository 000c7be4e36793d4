"""Command line: score, list-positive, list-negative, move and reconcile."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.config import EXTENSIONS, FeatureSettings, RankSettings
from tastemill.functions.media import entry_key, feature_tokens
from tastemill.functions.paths import absolute, relative_to
from tastemill.operators import cache, playlist, ranking
from tastemill.plans.ranking import corpus, rank
from tastemill.sources import files as sources
from tastemill.sources import probe


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tastemill")
    commands = top.add_subparsers(dest="command", required=True)
    score = commands.add_parser("score")
    score.add_argument("playlist")
    score.add_argument("dirs", nargs="+")
    score.add_argument("--exclude", action="append", default=[], metavar="GLOB")
    score.add_argument("--video-exts", default=",".join(EXTENSIONS))
    score.add_argument("--windows", type=int, default=5)
    score.add_argument("--combinations", type=int, default=2)
    for name, offset in (("file-size", 1 << 20), ("dir-size", 0), ("file-age", 86_400)):
        score.add_argument(f"--{name}-bias", type=float)
        score.add_argument(f"--{name}-offset", type=int, default=offset)
    score.add_argument("--cache", help="folder of the feature cache; without it every file is probed and nothing is stored")
    score.add_argument("--cache-ttl-days", type=int, default=30, help="days that entries of files not found stay; 0 for ever")
    score.add_argument("--features-combinations", type=int, default=2)
    score.add_argument("--features-smoothing", type=int, default=1)
    score.add_argument("--features-bucket-base", type=float, default=1.5)
    score.add_argument("--features-fps-base", type=float, default=1.1)
    for flag in ("include-classified", "no-header", "include-size", "json", "reverse", "by-dir", "absolute"):
        score.add_argument(f"--{flag}", action="store_true")
    for name in ("list-positive", "list-negative"):
        own = commands.add_parser(name)
        own.add_argument("playlist")
        own.add_argument("--absolute", action="store_true")
        own.add_argument("--exists", action="store_true")
    move = commands.add_parser("move")
    move.add_argument("original")
    move.add_argument("new")
    commands.add_parser("reconcile").add_argument("playlist")
    return top


def settings(a: argparse.Namespace) -> RankSettings:
    return RankSettings(
        windows=a.windows, combinations=a.combinations, file_size_bias=a.file_size_bias, dir_size_bias=a.dir_size_bias, file_age_bias=a.file_age_bias,
        file_size_offset=a.file_size_offset, dir_size_offset=a.dir_size_offset, file_age_offset=a.file_age_offset, cache_ttl_days=a.cache_ttl_days,
        include_classified=a.include_classified, extensions=tuple(e.strip().lower() for e in a.video_exts.split(",")), exclude=tuple(a.exclude),
        features=FeatureSettings(a.features_bucket_base, a.features_fps_base, a.features_smoothing, a.features_combinations),
    )


def score(spark: SparkSession, a: argparse.Namespace, call: Callable[[str], str] = probe.run_program) -> list[str]:
    s, now = settings(a), int(time.time())
    store = playlist.LabelFile(a.playlist)
    found = sources.scan(spark, a.dirs, s.extensions, s.exclude)
    files = found.select(F.col("path").alias("row"), "path", "size", F.unix_timestamp("mtime").alias("mtime_s"))
    entries = store.entries(spark).withColumn("path", absolute(F.lit(store.root), F.col("f")))
    labels = entries.select(F.concat_ws("#", F.col("pos").cast("string"), "path").alias("row"), "path", "s", F.col("m").alias("media"))
    # Tokens are kept: each branch of the ranking's plan would hold, compile and evaluate their expressions anew.
    featured, known = _featured(spark, files, a, s, now, call).persist(), _tokens(labels, s).persist()
    data = corpus(featured, known, s, key="row", byte_pairs=True, features="features")
    rows = rank(data, s, now, key="row")
    base = None if a.absolute else os.getcwd()
    if base is not None:
        rows = rows.withColumn("path", relative_to(F.col("path"), F.lit(base)))
    if a.by_dir:
        out = ranking.by_directory(rows, ascending=a.reverse)
        names, line = ["AVG_SCORE", "ENTRIES", "TOTAL_SIZE", "DIRECTORY"], lambda r: f"{r[0]:.3f}\t{r[1]}\t{r[2]}\t{r[3]}"
    else:
        # The listing runs from the lowest score up unless it is reversed.
        out = ranking.listing(rows, ascending=not a.reverse, sizes=a.include_size)
        names = ["SCORE", *(["SIZE"] if a.include_size else []), "FILENAME"]
        line = lambda r: "\t".join([f"{r.score:.3f}", *([str(r["size"])] if a.include_size else []), r.filename])
    if a.json:
        return [json.dumps([r.asDict() for r in out.toLocalIterator()], indent=2, ensure_ascii=False)]
    return [*([] if a.no_header else ["\t".join(names)]), *map(line, out.toLocalIterator())]


def _featured(spark: SparkSession, files: DataFrame, a: argparse.Namespace, s: RankSettings, now: int, call: Callable[[str], str]) -> DataFrame:
    """Files with the feature tokens of the filled cache; zeros for those that can't be probed."""
    keyed = files.withColumn("k", entry_key(F.col("path"), F.col("mtime_s"), F.col("size")))
    return _tokens(cache.attach(keyed, _populated(spark, keyed, a.cache, s, now, call)).drop("k"), s)


def _populated(spark: SparkSession, keyed: DataFrame, folder: str | None, s: RankSettings, now: int, call: Callable[[str], str]) -> DataFrame:
    """The cache after a pass over it: entries refreshed or expired, files without one probed, all stored as a new generation."""
    if folder:
        folder = os.path.abspath(folder)
        os.makedirs(folder, exist_ok=True)
    root = f"file://{folder}"
    known = cache.read(spark, root) if folder else spark.createDataFrame([], f"k string, u long, f {cache.MEDIA}")
    kept = cache.compact(known, keyed, now, s.cache_ttl_days)
    lost = cache.missing(keyed, kept).select("k", "path", "size").distinct().repartition(spark.sparkContext.defaultParallelism)
    probed = probe.extract(probe.probe(lost, call)).where(F.col("media").isNotNull())
    fresh = lost.select("k", "path").join(probed, "path").select("k", F.lit(now).cast("long").alias("u"), F.col("media").alias("f"))
    filled = cache.merge(kept, fresh)
    if not folder:
        return filled.persist()  # a file is probed once, however often its features are read
    cache.write_generation(filled, root)
    return cache.read(spark, root)


def _tokens(rows: DataFrame, s: RankSettings) -> DataFrame:
    """Feature tokens beside the rows, as 63-bit ids below zero, apart from those of path tokens."""
    cols = [F.col(f"media.{c}") for c in ("w", "h", "s", "vc", "ac", "d", "fps")]
    ids = F.transform(feature_tokens(*cols, settings=s.features), lambda t: -1 - F.shiftrightunsigned(F.xxhash64(t), 1))
    return rows.withColumn("features", ids).drop("media")


def run(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    sources.register(spark)
    if a.command == "score":
        return score(spark, a)
    if a.command == "move":
        old, new = playlist.LabelFile(a.original), playlist.LabelFile(a.new)
        rows = old.entries(spark).withColumn("p", absolute(F.lit(old.root), F.col("f"))).orderBy("pos").collect()  # one file's entries
        new.append(spark, [(r.p, r.s, r.a, r.m) for r in rows])
        return []
    store = playlist.LabelFile(a.playlist)
    if a.command == "reconcile":
        return ["changed" if store.reconcile(spark) else "unchanged"]
    out = playlist.listed(store.entries(spark), store.root, a.command == "list-positive", None if a.absolute else os.getcwd())
    paths = [r.path for r in out.collect()]
    return [p for p in paths if not a.exists or os.path.exists(p)]


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tastemill").getOrCreate()
    print("\n".join(run(spark, a)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
