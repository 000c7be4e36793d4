"""Tables in and shared storage for intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of keys up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
#: Rows and bytes of an Arrow batch where the session has Spark's default: its 10,000 texts are held several times over on either side.
ARROW_ROWS, ARROW_BYTES = 1024, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of this session, unless it sets their rows itself."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(ARROW_ROWS))
        spark.conf.set(size, str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; what works on it gets small Arrow batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session.  Only where that is unset and
    the session is local, as in tests, a temporary folder of this machine is made
    and remembered in the session's settings; elsewhere that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("tastemill.shared.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tastemill-")
        spark.conf.set("tastemill.shared.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/tastemill/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files, which would else stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def settled(df: DataFrame, label: str, made: list[str] | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: its lineage ends there.

    The path is added to ``made``, for whoever can discard the table later.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    schema = df.schema
    with shuffles_removed(spark):
        df.write.parquet(path)
    if made is not None:
        made.append(path)
    return spark.read.schema(schema).parquet(path)


def written_bytes(df: DataFrame) -> int:
    """Bytes of the files of a table that was just read, by their listing; very many for what is no table of files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def discard(spark: SparkSession, path: str) -> None:
    """Remove a path below the shared folder; a missing one is no error."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def unused(names: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, with underscores in front of those that are taken (in any case of letters)."""
    taken = {n.lower() for n in names}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def bounded(keys: DataFrame) -> DataFrame:
    """``keys`` to be broadcast if their counted bytes are at most ``BROADCAST_BYTES``, else as they are."""
    wide = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in keys.columns), F.lit(0))
    size = keys.agg(F.sum(wide.cast("long"))).first()[0] or 0
    return F.broadcast(keys) if size <= BROADCAST_BYTES else keys


def text_mark(docs: DataFrame) -> Column:
    """With the id, what tells a row's text from others."""
    return F.xxhash64(docs["text"])


def matching(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, text) is or isn't (``how``: left_semi, left_anti) among ``keys`` (id, mark), all columns unchanged.

    Few keys are broadcast, so that no text is shuffled.
    """
    keys = bounded(keys)
    return docs.join(keys, docs["doc_id"].eqNullSafe(keys["id"]) & (text_mark(docs) == keys["mark"]), how)
