"""The whole ranking: candidates, n-grams, frequent set, Naive Bayes, scorers, normalized sum."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.config import RankSettings
from tastemill.functions.paths import excluded, extension, normalize_text
from tastemill.operators import bayes, bpe, ngrams, ranking


@dataclass
class Corpus:
    """Candidates and labelled rows with n-grams as (key, ngram)."""

    candidates: DataFrame
    labelled: DataFrame
    candidate_pairs: DataFrame
    labelled_pairs: DataFrame
    tokenizer: bpe.Tokenizer | None = None

    def frequent(self) -> DataFrame:
        return ngrams.frequent(self.candidate_pairs.unionByName(self.labelled_pairs))

    def scored_pairs(self) -> DataFrame:
        return ngrams.keep_frequent(self.candidate_pairs, self.frequent())


def candidates(files: DataFrame, labels: DataFrame, settings: RankSettings, key: str = "doc_id") -> DataFrame:
    """Files with a wanted extension that no glob excludes, without labelled ones unless they are to be included."""
    x = files.where(extension(F.col("path")).isin(list(settings.extensions)))
    if settings.exclude:
        x = x.where(~excluded(F.col("path"), settings.exclude))
    on = "path" if "path" in labels.columns else key
    return x if settings.include_classified else x.join(labels.select(on), on, "left_anti")


def corpus(files: DataFrame, labels: DataFrame, settings: RankSettings = RankSettings(), key: str = "doc_id", byte_pairs: bool = False, features: str | None = None) -> Corpus:
    """Tokens are words and the separators between them, or byte pairs trained on the corpus.

    ``labels`` has key and s; with a path of its own, a label trains whether or
    not its file is among ``files``, and its key must be unique.
    """
    own = candidates(files, labels, settings, key).withColumn("text", normalize_text(F.col("path")))
    extra = [features] if features else []
    known = labels.select(key, "path", "s", *extra) if "path" in labels.columns else files.join(labels.select(key, "s"), key)
    known = known.withColumn("text", normalize_text(F.col("path")))
    tokenizer, special = None, ngrams.SPECIAL
    if byte_pairs:
        tokenizer = bpe.train(own.select("text").unionByName(known.select("text")))
        own, known = (bpe.tokenize(x, tokenizer) for x in (own, known))
        if features:  # their ids are longs
            own, known = (x.withColumn("tokens", F.col("tokens").cast("array<long>")) for x in (own, known))
        special = tuple(range(len(bpe.SPECIAL)))
    else:
        own, known = (x.withColumn("tokens", ngrams.word_tokens(F.col("text"))) for x in (own, known))
    media = F.col(features) if features else None
    shape = F.col("tokens"), settings.windows, settings.combinations, media, settings.features.combinations, special
    grams = [ngrams.pairs(x, key, *shape) for x in (own, known)]
    return Corpus(own.drop("tokens"), known.drop("tokens"), *grams, tokenizer)


def naive_bayes(data: Corpus, key: str = "doc_id") -> DataFrame:
    model = bayes.train_counts(data.labelled_pairs, data.labelled, key)
    return bayes.score(data.candidates, data.scored_pairs(), model, bayes.totals(model, data.labelled), key)


def rank(data: Corpus, settings: RankSettings, now: int, key: str = "doc_id") -> DataFrame:
    """Candidates with their normalized scores, one column per scorer, and the sum as score."""
    rows = ranking.with_dir_count(data.candidates)
    named = ranking.scorers(settings, now)
    rows = rows.select(key, "path", "size", *(s.column().alias(s.name) for s in named)).join(naive_bayes(data, key), key)
    return ranking.ranked(rows, [*(s.name for s in named), "naive_bayes"])
