"""Naive Bayes over n-grams: counts, totals, influence and score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def train_counts(pairs: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """ngram, cp, cn: rows of each class that have the n-gram; a label s of 0 counts as negative, repeated labels all count."""
    s = pairs.join(labels.select(key, "s"), key)
    return s.groupBy("ngram").agg(
        F.sum((F.col("s") > 0).cast("long")).alias("cp"), F.sum((F.col("s") <= 0).cast("long")).alias("cn")
    )


def totals(model: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: labelled rows p and n, n-gram totals tp and tn, vocabulary size v."""
    docs = labels.agg(F.coalesce(F.sum((F.col("s") > 0).cast("long")), F.lit(0)).alias("p"), F.coalesce(F.sum((F.col("s") <= 0).cast("long")), F.lit(0)).alias("n"))
    grams = model.agg(F.coalesce(F.sum("cp"), F.lit(0)).alias("tp"), F.coalesce(F.sum("cn"), F.lit(0)).alias("tn"), F.count("*").alias("v"))
    return docs.crossJoin(grams)


def influence(model: DataFrame, sums: DataFrame) -> DataFrame:
    """ngram, influence: log-probability of the positive class less that of the negative one."""
    x = model.crossJoin(F.broadcast(sums))
    value = F.ln((1 + F.col("cp")) / (F.col("tp") + F.col("v"))) - F.ln((1 + F.col("cn")) / (F.col("tn") + F.col("v")))
    return x.select("ngram", value.alias("influence"))


def score(entries: DataFrame, pairs: DataFrame, model: DataFrame, sums: DataFrame, key: str) -> DataFrame:
    """key, naive_bayes for every entry, also those without an n-gram.

    With a row's g n-grams the score is ln((1+p)/(1+n)) plus the n-grams' count
    terms plus g ln((tn+v)/(tp+v)): one join, one aggregation.
    """
    terms = pairs.join(model, "ngram", "left").select(
        key, (F.ln(1.0 + F.coalesce("cp", F.lit(0))) - F.ln(1.0 + F.coalesce("cn", F.lit(0)))).alias("term")
    )
    rows = terms.groupBy(key).agg(F.sum("term").alias("terms"), F.count("*").alias("g"))
    x = entries.select(key).join(rows, key, "left").crossJoin(F.broadcast(sums))
    each = F.when(F.col("v") > 0, F.ln((F.col("tn") + F.col("v")) / (F.col("tp") + F.col("v")))).otherwise(0.0)
    value = F.ln((1 + F.col("p")) / (1 + F.col("n"))) + F.coalesce("terms", F.lit(0.0)) + F.coalesce("g", F.lit(0)) * each
    return x.select(key, F.when(F.col("v") > 0, value).otherwise(F.ln((1 + F.col("p")) / (1 + F.col("n")))).alias("naive_bayes"))
