from __future__ import annotations

import pyarrow as pa

from tastemill.llm.graph import components
from tastemill.llm.storage import ARROW_BYTES, ARROW_ROWS, settled, small_batches

ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def _sizes(df):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "b"])

    return df.coalesce(1).mapInArrow(run, "n long, b long").collect()


def test_batches_are_bounded_in_rows_and_bytes(spark):
    own = spark.newSession()
    own.conf.set(ROWS, "10000")
    small_batches(own)
    short = _sizes(own.range(5000).selectExpr("cast(id as string) AS t"))
    assert sum(r.n for r in short) == 5000 and max(r.n for r in short) == ARROW_ROWS
    long_ = _sizes(own.range(1200).selectExpr("repeat('x', 20000) AS t"))
    assert sum(r.n for r in long_) == 1200 and max(r.b for r in long_) < ARROW_BYTES + 40_000


def test_a_sessions_own_bound_stays(spark):
    own = spark.newSession()
    own.conf.set(ROWS, "500")
    before = own.conf.get(BYTES)
    small_batches(own)
    assert own.conf.get(ROWS) == "500" and own.conf.get(BYTES) == before


def _shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in (found.apply(k) for k in range(found.size())) if f.getName().endswith(".data")}


def test_tables_that_are_written_leave_no_shuffle_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = _shuffle_files(spark), spark.conf.get(name)
    counted = settled(spark.range(5000).selectExpr("id % 1000 AS k").groupBy("k").count(), "counted")
    found = components(spark.range(100).selectExpr("id AS a", "id + 1 AS b")).groupBy("component").count()
    assert not _shuffle_files(spark) - before
    assert counted.count() == 1000 and [tuple(r) for r in found.collect()] == [(0, 101)] and spark.conf.get(name) == was
