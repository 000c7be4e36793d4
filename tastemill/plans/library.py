"""The standard tables seen as a file library with labels, features and a cache."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def shared_root(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share; a local session without one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tastemill-")
    return f"{root.rstrip('/')}/tastemill/{label}-{uuid.uuid4().hex}"


EPOCH = 1_700_000_000
NOW = EPOCH + 2_000_000_000
EXTENSIONS = ("mkv", "MP4", "txt", "avi", "nfo")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, size, mtime_s: a file for each document; no text is read."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    path = F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang", F.lit("/Doc_"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return d.select("doc_id", path.alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") * 3600 + EPOCH).alias("mtime_s"))


FILES_SQL = """
files AS (
  SELECT doc_id, '/lib/' || source || '/' || lang || '/Doc_' || doc_id || '.' || (['mkv', 'MP4', 'txt', 'avi', 'nfo'])[doc_id % 5 + 1] AS path,
         n_chars AS size, doc_id * 3600 + 1700000000 AS mtime_s
  FROM documents)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, s: 1 for good quality, -1 otherwise."""
    return table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, 1).otherwise(-1).alias("s"))


LABELS_SQL = "marks AS (SELECT doc_id, CASE WHEN quality = 1 THEN 1 ELSE -1 END AS s FROM labels)"


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media values of order lines: width, height, size, codecs, duration, frame rate."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_partkey") % 1921).alias("w"),
        (F.col("l_suppkey") % 1081).alias("h"),
        F.floor(F.col("l_extendedprice") * 1000).cast("long").alias("s"),
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.lower("l_returnflag")).alias("vc"),
        F.when(F.col("l_linestatus") == "O", "").otherwise(F.lower("l_linestatus")).alias("ac"),
        (F.col("l_discount") * F.col("l_quantity") * 100).alias("d"),
        F.when(F.col("l_tax") > 0.02, F.col("l_quantity")).alias("fps"),
    )


MEDIA_SQL = """
media AS (
  SELECT l_orderkey, l_linenumber, l_partkey % 1921 AS w, l_suppkey % 1081 AS h, CAST(floor(l_extendedprice * 1000) AS BIGINT) AS s,
         CASE WHEN l_returnflag = 'N' THEN '' ELSE lower(l_returnflag) END AS vc, CASE WHEN l_linestatus = 'O' THEN '' ELSE lower(l_linestatus) END AS ac,
         l_discount * l_quantity * 100 AS d, CASE WHEN l_tax > 0.02 THEN l_quantity END AS fps
  FROM lineitem)"""


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, u, f: entries of a feature cache, many per key."""
    x = table(spark, sf_dir, "events")
    f = F.struct(
        F.col("user_id").alias("w"), F.lit(1).cast("long").alias("h"), F.col("event_id").alias("s"), F.col("event_type").alias("vc"),
        F.lit("").alias("ac"), F.col("value").alias("d"), F.lit(None).cast("double").alias("fps"),
    )
    return x.select(F.concat_ws(":", "user_id", "event_type").alias("k"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("u"), f.alias("f"))


CACHE_SQL = "entries AS (SELECT user_id || ':' || event_type AS k, CAST(floor(epoch(ts)) AS BIGINT) AS u, event_id, value FROM events)"
