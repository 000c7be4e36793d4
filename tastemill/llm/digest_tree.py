"""Exact deduplication by a tree merge of sorted digest runs; DataFrame operations only.

Rows are dealt to leaves by a number of their own, whatever their id or text, so
that even one text, or no id at all, that a third of all rows have is spread over
every leaf.  Each leaf reduces its rows to a run: one entry per distinct text, in
the order of digests, with the smallest id, the number of rows and, as a check
beside the SHA-256, the length and an independent 64-bit hash of the text.

In each round ``FAN_IN`` neighbouring runs come together and are merged: the sort
of an entry's exchange puts the runs of one node in one order, and equal
neighbours are folded to the smallest verified id, which is Spark's sort
aggregation.  The work of a round is split by digest, so the last round, where
one run is left, is as wide as the first.  Every level is written to the shared
folder.  The decisions on texts that occur more than once then go back down the
same tree: a level is joined to the one below on (node, digest, check), and a
leaf at last to its own rows.  No key of these joins holds more rows than a leaf,
and the number of leaves grows with the rows: about ``LEAF_ROWS`` each, and never
fewer than ``LEAST_LEAVES`` leaves.

Defined results: a null text counts as empty.  Rows that repeat a doc_id with an
equal text form part of the group like any others; one of them is kept if they
carry the smallest id.  Null ids never win against others; a group of nothing
but null ids keeps one row, with keep_id null.  Columns other than doc_id and
text are not read, whatever their names.  Very long texts are one value like any
other.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import matching, settled, table, text_mark

LEAST_LEAVES = 256
LEAF_ROWS = 1 << 17
FAN_IN = 4
_SPACE = r"[\x20\x09-\x0D]+"
_KEY = ["node", "digest", "chars", "check"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, " ")


def digested(docs: DataFrame) -> DataFrame:
    """One slim row per document: id, a mark of its text as it stands, digest, check values, and a number of its own."""
    text = docs.select(F.col("doc_id").alias("doc_id"), text_mark(docs).alias("mark"), normalised(F.col("text")).alias("norm"))
    return text.select(
        "doc_id",
        "mark",
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.length("norm").alias("chars"),
        F.xxhash64("norm").alias("check"),
        F.monotonically_increasing_id().alias("row"),
    )


def tree_leaves(rows: int, fan_in: int = FAN_IN) -> int:
    """A power of ``fan_in`` that gives leaves of about ``LEAF_ROWS`` rows."""
    leaves = 1
    while leaves < max(LEAST_LEAVES, rows / LEAF_ROWS):
        leaves *= fan_in
    return leaves


def _merged(runs: DataFrame, node: Column) -> DataFrame:
    """Runs of a node as one: the smallest entry and all rows of each digest whose check values agree.

    The entry is a struct, for which Spark aggregates by sorting.
    """
    return runs.withColumn("node", node.cast("int")).groupBy(*_KEY).agg(F.min("least").alias("least"), F.sum("rows").alias("rows"))


def _decided(docs: DataFrame, leaves: int | None, fan_in: int) -> DataFrame:
    """doc_id, mark, digest, keep_id, group_size, kept: one row per row of ``docs``."""
    rows = settled(digested(docs), "digests")
    width = leaves or tree_leaves(rows.count(), fan_in)
    rows = rows.withColumn("node", F.pmod(F.xxhash64(F.lit(7), "row"), F.lit(width)).cast("int"))
    entry = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("mark").alias("mark"), F.col("row").alias("row"))
    levels = [settled(_merged(rows.select(*_KEY, entry.alias("least"), F.lit(1).cast("long").alias("rows")), F.col("node")), "run")]
    while width > 1:
        levels.append(settled(_merged(levels[-1], F.floor(F.col("node") / fan_in)), "run"))
        width = -(-width // fan_in)

    # A text of one row keeps it: only the others' decisions go down.
    decided = levels[-1].where("rows > 1").select(*_KEY, "least", F.col("rows").alias("group_size"))
    for below in reversed(levels[:-1]):
        up = decided.withColumnRenamed("node", "up")
        decided = below.select(*_KEY, F.floor(F.col("node") / fan_in).cast("int").alias("up")).join(up, ["up", "digest", "chars", "check"])
        decided = decided.select(*_KEY, "least", "group_size")
    single = F.col("group_size").isNull()
    return rows.join(decided, _KEY, "left").select(
        "doc_id",
        "mark",
        "digest",
        F.when(single, F.col("doc_id")).otherwise(F.col("least.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("least.row") == F.col("row"))).alias("kept"),
    )


def deduplicate(docs: DataFrame, leaves: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``."""
    found = _decided(docs, leaves, fan_in)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all its columns unchanged.

    Rows are told apart by their id and text.  Those to go are taken out by an
    anti join; of rows that repeat both, one comes back.
    """
    found = _decided(docs, None, FAN_IN).groupBy(F.col("doc_id").alias("id"), "mark").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    out_of_place = settled(found.where("not kept or n > 1"), "dropped")
    out = matching(docs, out_of_place.select("id", "mark"), "left_anti")
    again = out_of_place.where("kept").select("id", "mark")
    if again.isEmpty():
        return out
    return out.unionByName(matching(docs, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM n
"""

QUERIES = {"op10_exact_dedup": op10_exact_dedup}
ORACLES = {"op10_exact_dedup": ORACLE}
