"""Scorers, their normalized sum, listings and picks."""

from __future__ import annotations

import math
import random
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.media import log_score
from tastemill.functions.paths import parent_dir

EPSILON = 2.220446049250313e-16


class Scorer(Protocol):
    """A score column for entries with path, size, mtime_s and dir_count."""

    name: str

    def column(self) -> Column: ...


class LogScorer:
    def __init__(self, name: str, value: Column, offset: int, bias: float):
        if abs(bias) <= 1:
            raise ValueError("a bias must be above 1 or below -1")
        self.name, self._score = name, log_score(value, offset, bias)

    def column(self) -> Column:
        return self._score


def scorers(settings, now: int) -> list[LogScorer]:
    """The scorers that are set, in their fixed order; Naive Bayes comes after them."""
    out = []
    if settings.file_size_bias is not None:
        out.append(LogScorer("file_size", F.col("size"), settings.file_size_offset, settings.file_size_bias))
    if settings.dir_size_bias is not None:
        out.append(LogScorer("dir_size", F.col("dir_count"), settings.dir_size_offset, settings.dir_size_bias))
    if settings.file_age_bias is not None:
        out.append(LogScorer("file_age", F.greatest(F.lit(now) - F.col("mtime_s"), F.lit(0)), settings.file_age_offset, settings.file_age_bias))
    return out


def with_dir_count(entries: DataFrame) -> DataFrame:
    """Candidates per directory, pre-aggregated and joined back, so that a large directory is no single task."""
    rows = entries.withColumn("dir", parent_dir(F.col("path")))
    return rows.join(rows.groupBy("dir").agg(F.count("*").alias("dir_count")), "dir").drop("dir")


def minmax(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each column scaled to 0..1; one whose range is not above EPSILON keeps its values.

    The ends come from an evaluation of their own, whose sums of doubles can
    differ in the last bit, so what would fall outside is set to the end.
    """
    ends = rows.agg(*(f(c).alias(f"__{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))))
    both = rows.crossJoin(F.broadcast(ends))
    for c in columns:
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        both = both.withColumn(c, F.when(hi - lo > EPSILON, F.least(F.greatest(F.lit(0.0), (F.col(c) - lo) / (hi - lo)), F.lit(1.0))).otherwise(F.col(c)))
    return both.select(*rows.columns)


def ranked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Normalized columns and their sum as score."""
    scaled = minmax(rows, columns)
    return scaled.withColumn("score", sum((F.col(c) for c in columns[1:]), F.col(columns[0])))


def listing(rows: DataFrame, ascending: bool = True, sizes: bool = False) -> DataFrame:
    """score, filename (and size), ordered by score, ties by name."""
    order = F.col("score") if ascending else F.col("score").desc()
    return rows.select("score", F.col("path").alias("filename"), *(["size"] if sizes else [])).orderBy(order, "filename")


def listing_lines(rows: DataFrame, ascending: bool = True, sizes: bool = False) -> DataFrame:
    """The listing as tab-separated lines with three decimals."""
    x = listing(rows, ascending, sizes)
    cells = [F.format_string("%.3f", "score"), *([F.col("size").cast("string")] if sizes else []), F.col("filename")]
    return x.select(F.concat_ws("\t", *cells).alias("line"))


def by_directory(rows: DataFrame, ascending: bool = False) -> DataFrame:
    out = rows.groupBy(parent_dir(F.col("path")).alias("directory")).agg(
        F.avg("score").alias("average_score"), F.count("*").alias("entry_count"), F.sum("size").alias("total_size")
    )
    order = F.col("average_score") if ascending else F.col("average_score").desc()
    return out.select("average_score", "entry_count", "total_size", "directory").orderBy(order, "directory")


def next_pick(rows: DataFrame, selection_p: float | None = None, seed: int | None = None) -> DataFrame:
    """The row to judge next: the best, or with ``selection_p`` the one at which a draw per rank first succeeds (the best if none does)."""
    best = rows.orderBy(F.col("score").desc(), "path")
    if selection_p is None or selection_p in (0.0, 1.0):
        return best.limit(1)
    k = int(math.log(1 - random.Random(seed).random()) / math.log(1 - selection_p))
    return best.limit(1) if k == 0 or k >= rows.count() else best.offset(k).limit(1)


def viewport(rows: DataFrame, cursor: int, height: int) -> DataFrame:
    """The rows that are shown around the cursor, with their rank: ``height`` before it and twice as many from it on, in the order of the ranking."""
    height = max(1, height)
    first = max(0, cursor - height)
    best = rows.orderBy(F.col("score").desc(), "path").offset(first).limit(cursor + 2 * height - first)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "path")) - 1 + first)


def top_ngrams(pairs: DataFrame, influence: DataFrame, key: str, most: int = 50) -> DataFrame:
    """The ``most`` n-grams of each row by absolute influence."""
    order = Window.partitionBy(key).orderBy(F.abs("influence").desc(), "ngram")
    x = pairs.join(influence, "ngram", "left").withColumn("influence", F.coalesce("influence", F.lit(0.0)))
    return x.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
