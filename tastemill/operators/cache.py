"""The feature cache: lenient JSON lines, newest entry per key, expiry, merge, generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEDIA = "struct<w:bigint,h:bigint,s:bigint,vc:string,ac:string,d:double,fps:double>"
_LINE = f"struct<k:string,key:string,u:bigint,last_used:bigint,f:{MEDIA},features:{MEDIA}>"
SHARD_RECORDS = 49_000


def default_media() -> Column:
    """What a file without known features has."""
    zero = F.struct(
        F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("s"), F.lit("").alias("vc"), F.lit("").alias("ac"), F.lit(0.0).alias("d"), F.lit(None).cast("double").alias("fps")
    )
    return zero


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """k, u, f of the lines that hold an entry, under short or long names; others are dropped."""
    x = lines.select(F.from_json(column, _LINE).alias("e"))
    x = x.select(F.coalesce("e.k", "e.key").alias("k"), F.coalesce("e.u", "e.last_used").alias("u"), F.coalesce("e.f", "e.features").alias("f"))
    whole = F.col("k").isNotNull() & F.col("u").isNotNull() & F.col("f.w").between(0, 2**32 - 1) & F.col("f.h").between(0, 2**32 - 1) & (F.col("f.s") >= 0) & F.col("f.d").isNotNull()
    named = F.struct("f.w", "f.h", "f.s", F.coalesce("f.vc", F.lit("")).alias("vc"), F.coalesce("f.ac", F.lit("")).alias("ac"), "f.d", "f.fps")
    return x.where(whole).select("k", "u", named.alias("f"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All entries of the shards below ``path``, the newest one per key."""
    lines = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").text(path)
    return newest(parse_lines(lines))


def newest(entries: DataFrame) -> DataFrame:
    """The entry of each key with the greatest u (of equal ones, the greatest features)."""
    return entries.groupBy("k").agg(F.max(F.struct("u", "f")).alias("e")).select("k", "e.u", "e.f")


def compact(entries: DataFrame, keys: DataFrame, now: int, ttl_days: int) -> DataFrame:
    """Survivors: entries of present keys with u = now, others while younger than the limit; with a limit of 0 all stay."""
    seen = keys.select("k").distinct().withColumn("present", F.lit(True))
    x = entries.join(seen, "k", "left").withColumn("present", F.coalesce("present", F.lit(False)))
    if ttl_days:
        x = x.where(F.col("present") | (F.lit(now) - F.col("u") < ttl_days * 86_400))
    return x.select("k", F.when(F.col("present"), F.lit(now).cast("long")).otherwise(F.col("u")).alias("u"), "f")


def missing(keys: DataFrame, survivors: DataFrame) -> DataFrame:
    """Rows of ``keys`` that have no survivor: the ones to probe."""
    return keys.join(survivors.select("k"), "k", "left_anti")


def merge(survivors: DataFrame, probed: DataFrame) -> DataFrame:
    """Both, the probed one where a key has two."""
    both = survivors.select("k", "u", "f", F.lit(0).alias("o")).unionByName(probed.select("k", "u", "f", F.lit(1).alias("o")))
    return both.groupBy("k").agg(F.max(F.struct("o", "u", "f")).alias("e")).select("k", "e.u", "e.f")


def attach(entries: DataFrame, cache: DataFrame) -> DataFrame:
    """``entries`` (with k) and their features; zeros for those without."""
    return entries.join(cache.select("k", F.col("f").alias("media")), "k", "left").withColumn("media", F.coalesce("media", default_media()))


def write_generation(cache: DataFrame, root: str, records: int = SHARD_RECORDS) -> str:
    """Write the cache as a new generation of shards below ``root``, then drop older ones; returns its path.

    A generation counts once its success mark is there; readers take the newest
    entry per key, so that leftovers of a broken run change nothing.
    """
    spark = cache.sparkSession
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    store = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [p.getPath() for p in store.listStatus(base)] if store.exists(base) else []
    old = [p for p in old if p.getName().startswith("gen=") and p.getName()[4:].isdecimal()]
    target = f"{root}/gen={max([int(p.getName()[4:]) for p in old], default=0) + 1}"
    line = F.to_json(F.struct("k", "u", "f"), {"ignoreNullFields": "true"})
    cache.select(line.alias("value")).write.option("maxRecordsPerFile", records).format("text").save(target + ".draft")
    draft, final = jvm.org.apache.hadoop.fs.Path(target + ".draft"), jvm.org.apache.hadoop.fs.Path(target)
    store.mkdirs(final)
    for p in [p.getPath() for p in store.listStatus(draft)]:
        name = p.getName()
        if name.startswith("part-"):
            store.rename(p, jvm.org.apache.hadoop.fs.Path(final, name.rsplit(".", 1)[0] + ".jsonl"))
    store.delete(draft, True)
    for p in old:
        store.delete(p, True)
    return target
