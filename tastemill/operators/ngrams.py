"""Token sequences and their n-grams; a key is the array of tokens itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemill.functions.media import once

ROOT, EOL = "<ROOT>", "<EOL>"
SPECIAL = (ROOT, EOL, " ", "/")


def char_tokens(text: Column) -> Column:
    """<ROOT>, the code points, <EOL>."""
    return F.concat(F.array(F.lit(ROOT)), F.filter(F.split(text, ""), lambda c: c != ""), F.array(F.lit(EOL)))


def word_tokens(text: Column) -> Column:
    """<ROOT>, words and the spaces and slashes between them, <EOL>."""
    return F.concat(F.array(F.lit(ROOT)), F.regexp_extract_all(text, F.lit(r"([ /]|[^ /]+)"), F.lit(1)), F.array(F.lit(EOL)))


def windows(tokens: Column, most: int) -> Column:
    """Every contiguous run of 1 to ``most`` tokens, each once."""
    return F.array_distinct(once(tokens, lambda t: _windows(t, most)))


def _windows(tokens: Column, most: int) -> Column:
    if most < 1:
        return F.filter(F.array(tokens), lambda _: F.lit(False))
    runs = F.transform(
        F.sequence(F.lit(1), F.lit(most)),
        lambda n: F.when(
            F.size(tokens) >= n,
            F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.slice(tokens, i, n)),
        ),
    )
    return F.flatten(F.array_compact(runs))


def combinations(tokens: Column, most: int, special=SPECIAL) -> Column:
    """Every choice of 1 to ``most`` positions among tokens that are not special, tokens sorted, each once."""
    return F.array_distinct(once(F.filter(tokens, lambda t: ~t.isin(list(special))), lambda t: _combinations(t, most)))


def _combinations(plain: Column, most: int) -> Column:
    if most < 1:
        return F.filter(F.array(plain), lambda _: F.lit(False))
    if most > 2:
        return _many(plain, most)
    out = F.transform(plain, lambda t: F.array(t))
    if most == 2:
        pairs = F.transform(plain, lambda x, i: F.transform(F.slice(plain, i + 2, F.size(plain)), lambda y: F.array_sort(F.array(x, y))))
        out = F.concat(out, F.flatten(pairs))
    return out


def _many(plain: Column, most: int) -> Column:
    """Three and more positions: choices grow by one position a round, as (last position, tokens)."""
    level = F.transform(plain, lambda t, i: F.struct(i.cast("int").alias("at"), F.array(t).alias("key")))
    rounds = [level]
    for _ in range(most - 1):
        level = F.flatten(
            F.transform(
                level,
                lambda c: F.transform(
                    F.slice(F.transform(plain, lambda t, i: F.struct(i.cast("int").alias("i"), t.alias("t"))), c["at"] + 2, F.size(plain)),
                    lambda x: F.struct(x["i"].alias("at"), F.concat(c["key"], F.array(x["t"])).alias("key")),
                ),
            )
        )
        rounds.append(level)
    return F.transform(F.concat(*rounds), lambda c: F.array_sort(c["key"]))


def build(tokens: Column, most_window: int, most_combined: int, features: Column | None = None, features_combined: int = 0, special=SPECIAL) -> Column:
    """All n-grams of a row; path tokens and feature tokens are not combined with each other."""
    return F.array_distinct(_all(tokens, most_window, most_combined, features, features_combined, special))


def _all(tokens: Column, most_window: int, most_combined: int, features: Column | None, features_combined: int, special) -> Column:
    """The same, with repeats."""
    plain = F.filter(tokens, lambda t: ~t.isin(list(special)))
    parts = [once(tokens, lambda t: _windows(t, most_window)), once(plain, lambda t: _combinations(t, most_combined))]
    if features is not None and features_combined > 0:
        own = F.filter(features, lambda t: ~t.isin(list(special)))
        parts.append(once(own, lambda t: _combinations(t, features_combined)))
    return F.concat(*parts)


def pairs(rows: DataFrame, key: str, tokens: Column, most_window: int, most_combined: int, features: Column | None = None, features_combined: int = 0, special=SPECIAL) -> DataFrame:
    """(key, ngram) of each row, distinct within the row; ``key`` tells rows apart.

    Rows are dealt by key first, so that repeats go by an aggregation in place and
    not by comparing each n-gram of a row with all others.
    """
    every = rows.repartition(key).select(key, F.explode(_all(tokens, most_window, most_combined, features, features_combined, special)).alias("ngram"))
    return every.groupBy(key, "ngram").agg(F.lit(1).alias("one")).drop("one")


def exploded(rows: DataFrame, key: str, ngrams: str = "ngrams") -> DataFrame:
    """(key, ngram) of each row, distinct within the row."""
    return rows.select(key, F.explode(F.array_distinct(F.col(ngrams))).alias("ngram"))


def doc_freq(pairs: DataFrame) -> DataFrame:
    """ngram, df over rows as they are: a row that occurs twice counts twice."""
    return pairs.groupBy("ngram").agg(F.count("*").alias("df"))


def frequent(pairs: DataFrame) -> DataFrame:
    return doc_freq(pairs).where("df > 1").select("ngram")


def keep_frequent(pairs: DataFrame, of: DataFrame) -> DataFrame:
    return pairs.join(of, "ngram", "left_semi")


def shown(ngram: Column) -> Column:
    """An n-gram as text, for results."""
    return F.array_join(ngram.cast(T.ArrayType(T.StringType())), "|")
