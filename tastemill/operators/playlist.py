"""The label store: playlist text with a JSON comment per label."""

from __future__ import annotations

import os
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.functions.paths import absolute, relative_to

from .cache import MEDIA, default_media

HEADER = "#EXTM3U"
ENTRY = f"struct<f:string,a:bigint,s:int,m:{MEDIA}>"


def parse(lines: DataFrame) -> DataFrame:
    """pos, f, a, s, m of the label lines of (pos, value); other lines are nothing; a broken label line is an error."""
    is_label = F.startswith(F.col("v"), F.lit("#{"))
    own = lines.select("pos", F.trim("value").alias("v")).where(is_label)
    # The condition is repeated inside: a plan may move later filters below the one above.
    text = F.when(is_label, F.substring("v", 2, 1 << 30))
    x = own.select("pos", "v", F.from_json(text, ENTRY, {"mode": "FAILFAST"}).alias("e"))
    bad = F.startswith(F.col("v"), F.lit("#{")) & (F.col("e.f").isNull() | F.col("e.a").isNull() | F.col("e.s").isNull())
    m = F.col("e.m")
    bad = bad | (m.isNotNull() & (m["w"].isNull() | m["h"].isNull() | m["s"].isNull() | m["d"].isNull()))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("bad label line: "), F.col("v")))).otherwise(F.col("e.f"))
    media = F.when(
        m.isNotNull(),
        F.struct(m["w"].alias("w"), m["h"].alias("h"), m["s"].alias("s"), F.coalesce(m["vc"], F.lit("")).alias("vc"), F.coalesce(m["ac"], F.lit("")).alias("ac"), m["d"].alias("d"), m["fps"].alias("fps")),
    ).otherwise(default_media())
    return x.select("pos", checked.alias("f"), F.col("e.a").alias("a"), F.col("e.s").alias("s"), media.alias("m"))


def line(f: Column, a: Column, s: Column, m: Column | None = None) -> Column:
    """The label line of an entry; null fields are left out."""
    parts = [f.alias("f"), a.cast("long").alias("a"), s.cast("int").alias("s")]
    return F.concat(F.lit("#"), F.to_json(F.struct(*parts, *([m.alias("m")] if m is not None else [])), {"ignoreNullFields": "true"}))


def render(entries: DataFrame, exists: Column, m: Column | None = None) -> DataFrame:
    """pos, text: each entry's label line and, for a positive one whose file exists, its bare path."""
    own = line(F.col("f"), F.col("a"), F.col("s"), m)
    return entries.select("pos", F.when((F.col("s") > 0) & exists, F.concat(own, F.lit("\n"), F.col("f"))).otherwise(own).alias("text"))


def rebased(entries: DataFrame, old_root: str, new_root: str) -> DataFrame:
    """Entries as another root's playlist holds them; time, score and features stay."""
    return entries.withColumn("f", relative_to(absolute(F.lit(old_root), F.col("f")), F.lit(new_root)))


def listed(entries: DataFrame, root: str, positive: bool, relative: str | None = None, present: DataFrame | None = None) -> DataFrame:
    """pos, path of positive or negative entries in stored order, repeats kept; only those in ``present`` (path) if given."""
    x = entries.where(F.col("s") > 0 if positive else F.col("s") < 0).select("pos", absolute(F.lit(root), F.col("f")).alias("path"))
    if present is not None:
        x = x.join(present.select("path"), "path", "left_semi").select("pos", "path")
    if relative is not None:
        x = x.select("pos", relative_to(F.col("path"), F.lit(relative)).alias("path"))
    return x.orderBy("pos")


class LabelFile:
    """A playlist file with one writer, on the driver."""

    def __init__(self, path: str):
        self.path = os.path.abspath(path)
        self.root = os.path.dirname(self.path)
        if not os.path.exists(self.path):
            with open(self.path, "w", encoding="utf-8") as f:
                f.write(HEADER + "\n")
        with open(self.path, encoding="utf-8") as f:
            first = f.readline()
        if not first:
            raise ValueError(f"{path} is empty")
        if first.strip() != HEADER:
            raise ValueError(f"{path} does not begin with {HEADER}")

    def lines(self, spark) -> DataFrame:
        return spark.read.format("m3u").option("path", self.path).load()

    def entries(self, spark) -> DataFrame:
        return parse(self.lines(spark))

    def append(self, spark, rows: list[tuple]) -> None:
        """Add (absolute path, score, time or None for now, features if known) in order."""
        made = [(k, p, s, int(time.time()) if a is None else a, m[0] if m else None, os.path.exists(p)) for k, (p, s, a, *m) in enumerate(rows)]
        df = spark.createDataFrame(made, f"pos long, p string, s int, a long, m {MEDIA}, there boolean")
        df = df.withColumn("f", relative_to(F.col("p"), F.lit(self.root)))
        text = [r.text for r in render(df, F.col("there"), F.coalesce("m", default_media())).orderBy("pos").collect()]  # the rows given
        with open(self.path, "a", encoding="utf-8") as f:
            f.writelines(t + "\n" for t in text)

    def reconcile(self, spark) -> bool:
        """Rewrite the file from its entries; True if it changed."""
        entries = self.entries(spark).collect()  # the file's own entries, held by one writer
        there = [os.path.exists(os.path.normpath(os.path.join(self.root, r.f))) for r in entries]
        rows = [(r.pos, r.f, r.a, r.s, r.m, t) for r, t in zip(entries, there, strict=True)]
        df = spark.createDataFrame(rows, f"pos long, f string, a long, s int, m {MEDIA}, there boolean")
        df = df.withColumn("f", relative_to(absolute(F.lit(self.root), F.col("f")), F.lit(self.root)))
        text = "\n".join([HEADER, *(r.text for r in render(df, F.col("there"), F.col("m")).orderBy("pos").collect())]) + "\n"
        with open(self.path, encoding="utf-8") as f:
            if f.read() == text:
                return False
        draft = self.path + ".draft"
        with open(draft, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(draft, self.path)
        return True
