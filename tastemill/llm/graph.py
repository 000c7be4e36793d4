"""Connected components by rounds of DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .storage import discard, scratch, shuffles_removed


def components(edges: DataFrame, label: str = "components", most_rounds: int = 60) -> DataFrame:
    """v, component (the smallest vertex of v's component) for the vertices of ``edges`` (a, b).

    Each round replaces edges by a star around the smallest neighbour, first for
    larger neighbours and then for smaller ones, until nothing changes; the
    number of rounds grows with the logarithm of the longest path.  Rounds are
    written to the shared folder, so an executor that is lost costs its tasks
    only; a round is one write for each half, which also counts what it writes.
    Rows are edges throughout: no neighbour list is gathered.  Vertices are of any
    type that has an order.
    """
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType

    def kept(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path, seen = scratch(spark, label), Observation()
        sums = F.count(F.lit(1)).alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("s"), F.bit_xor(F.xxhash64("a", "b")).alias("x")
        with shuffles_removed(spark):
            df.observe(seen, *sums).write.parquet(path)
        got = seen.get
        return spark.read.schema(f"a {kind.simpleString()}, b {kind.simpleString()}").parquet(path), path, (got["n"], got["s"], got["x"])

    def directed(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def stars(e: DataFrame, larger: bool) -> DataFrame:
        """For large stars every neighbour above v, for small ones v and every neighbour below it, go to v's least neighbour."""
        pairs = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else e
        least = pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        own = least.where("m < a").select("a", F.col("m").alias("b"))
        moved = pairs.join(least, "a").where("b > a" if larger else "b < a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return directed(moved if larger else moved.unionByName(own))

    now, path, before = kept(directed(edges))
    for _ in range(most_rounds if before[0] else 0):
        large, large_path, _ = kept(stars(now, True))
        now, small_path, after = kept(stars(large, False))
        discard(spark, path)
        discard(spark, large_path)
        path = small_path
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    roots = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "v")
    return roots.unionByName(roots.select(F.col("component").alias("v"), "component").distinct())
