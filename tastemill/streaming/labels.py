"""Labels that arrive as a stream: incremental class counts, and labels from player states."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.config import RankSettings
from tastemill.operators import bayes, ranking
from tastemill.plans.ranking import Corpus

def fold_labels(labels: DataFrame, pairs: DataFrame, key: str, root: str, available_now: bool = True):
    """Start the query that keeps class counts of a label stream (key, s) below ``root``.

    Each batch writes generation batch + 1 from generation batch and its own
    labels; a batch that runs again overwrites its own generation, so labels count
    once.  The generation before is kept for such a batch, older ones go.
    """
    kinds = f"ngram {pairs.schema['ngram'].dataType.simpleString()}, cp long, cn long"

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        s = pairs.join(batch.select(key, "s"), key)
        new = s.groupBy("ngram").agg(F.sum((F.col("s") > 0).cast("long")).alias("cp"), F.sum((F.col("s") <= 0).cast("long")).alias("cn"))
        if number:
            new = new.unionByName(spark.read.schema(kinds).parquet(f"{root}/counts/gen={number}"))
        new.groupBy("ngram").agg(F.sum("cp").alias("cp"), F.sum("cn").alias("cn")).write.mode("overwrite").parquet(f"{root}/counts/gen={number + 1}")
        _remove(spark, f"{root}/counts/gen={number - 1}")

    return _started(labels, fold, root, available_now)


def _started(labels: DataFrame, fold, root: str, available_now: bool):
    writer = labels.writeStream.foreachBatch(fold).option("checkpointLocation", f"{root}/progress")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def counts(spark: SparkSession, root: str) -> DataFrame:
    """ngram, cp, cn of the newest generation."""
    gens = spark.read.option("basePath", f"{root}/counts").parquet(f"{root}/counts/gen=*")
    last = gens.agg(F.max("gen")).first()[0]
    return gens.where(F.col("gen") == last).drop("gen")


class Build:
    """The label loop: each batch of labels takes its files from the candidates, trains on them and ranks the rest.

    The corpus, its frequent set and the labels at the start stay as they are; a
    label that comes in trains on its file's frequent n-grams, where one at the
    start trained on all of its n-grams.  Labels are kept per batch below
    ``root``, so a batch that runs again counts once; the model and the number of
    files per directory follow from them.  A label of a file that is no candidate,
    or that has one already, changes nothing.
    """

    def __init__(self, data: Corpus, settings: RankSettings, now: int, root: str, key: str = "doc_id"):
        self.data, self.settings, self.now, self.root, self.key = data, settings, now, root, key
        spark = data.candidates.sparkSession
        kept, start = f"{root}/kept", f"{root}/start"
        data.scored_pairs().write.mode("overwrite").parquet(kept)
        bayes.train_counts(data.labelled_pairs, data.labelled, key).write.mode("overwrite").parquet(start)
        self.kept, self.start = spark.read.parquet(kept), spark.read.parquet(start)

    def labelled(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """key, s of all batches, or of those before one."""
        kind = self.data.candidates.schema[self.key].dataType.simpleString()
        empty = spark.createDataFrame([], f"{self.key} {kind}, s int, batch long")
        try:
            found = spark.read.schema(f"{self.key} {kind}, s int").option("basePath", f"{self.root}/labels").parquet(f"{self.root}/labels/batch=*")
        except AnalysisException:  # no batch yet
            found = empty
        found = found.select(self.key, "s", F.col("batch").cast("long").alias("batch"))
        return (found if before is None else found.where(F.col("batch") < before)).select(self.key, "s")

    def fold(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select(self.key, F.col("s").cast("int").alias("s")).join(self.data.candidates.select(self.key), self.key, "left_semi")
        new = new.join(self.labelled(spark, number).select(self.key), self.key, "left_anti").dropDuplicates([self.key])
        new.write.mode("overwrite").parquet(f"{self.root}/labels/batch={number}")
        pick = ranking.next_pick(self.ranked(spark), self.settings.selection_p, number)
        pick.select(self.key, "path", "score").write.mode("overwrite").parquet(f"{self.root}/picks/batch={number}")

    def ranked(self, spark: SparkSession) -> DataFrame:
        """The remaining candidates with their scores, by the model of all labels so far."""
        done = self.labelled(spark)
        more = bayes.train_counts(self.kept, done, self.key)
        model = self.start.unionByName(more).groupBy("ngram").agg(F.sum("cp").alias("cp"), F.sum("cn").alias("cn"))
        sums = bayes.totals(model, self.data.labelled.select("s").unionByName(done.select("s")))
        left = self.data.candidates.join(done.select(self.key), self.key, "left_anti")
        named = ranking.scorers(self.settings, self.now)
        rows = ranking.with_dir_count(left).select(self.key, "path", "size", *(s.column().alias(s.name) for s in named))
        rows = rows.join(bayes.score(left, self.kept, model, sums, self.key), self.key)
        return ranking.ranked(rows, [*(s.name for s in named), "naive_bayes"])

    def picks(self, spark: SparkSession) -> DataFrame:
        """batch, key, path, score: the file to judge next after each batch; none once all are judged."""
        return spark.read.option("basePath", f"{self.root}/picks").parquet(f"{self.root}/picks/batch=*")

    def begin(self, labels: DataFrame, available_now: bool = True):
        """Start the query over a label stream (key, s)."""
        return _started(labels, self.fold, self.root, available_now)


WAITING, POLLING = "waiting", "polling"


def step(state: str, left: int, status: str | None, file: str | None, wanted: str) -> tuple[str, int, str | None]:
    """The next state, polls left, and a label where one is decided.

    Waiting, a status with the wanted file starts polling, any other answer uses
    up one poll, and without polls the label is Skipped.  Polling, stopped is
    Positive, paused Negative, and no answer Skipped.
    """
    if state == WAITING:
        if status is not None and file == wanted:
            return POLLING, left, None
        left -= 1
        return (WAITING, left, None) if left > 0 else (WAITING, 0, "Skipped")
    if status is None:
        return POLLING, left, "Skipped"
    return POLLING, left, {"stopped": "Positive", "paused": "Negative"}.get(status)


def status_labels(statuses: DataFrame, attempts: int = 600) -> DataFrame:
    """session, label from player answers (session, seq, status, file, wanted), as they stream in; a session's first label ends it."""

    def run(key, frames, state):
        now, left, done = state.get if state.exists else (WAITING, attempts, False)
        out = []
        for frame in frames:
            for r in frame.sort_values("seq").itertuples():
                if done:
                    break
                status = None if pd.isna(r.status) else r.status
                now, left, label = step(now, left, status, r.file, r.wanted)
                if label:
                    out.append((key[0], label))
                    done = True
        state.update((now, left, done))
        yield pd.DataFrame(out, columns=["session", "label"])

    return statuses.groupBy("session").applyInPandasWithState(
        run, "session string, label string", "state string, left int, done boolean", "append", "NoTimeout"
    )
