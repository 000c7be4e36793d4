"""Functions for SQL statements of a session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Each as SQL itself, so that it becomes part of the plan and runs compiled.
_DEFINED = (
    r"""normalize_path(p STRING) RETURNS STRING RETURN
        trim(regexp_replace(regexp_replace(replace(lower(p), chr(39), ''), r'[^\p{IsAlphabetic}\p{N}/]+', ' '), ' ?/[ /]*', '/'))""",
    """geometric_bucket(v DOUBLE, base DOUBLE) RETURNS BIGINT RETURN
        CASE WHEN v >= 1 AND NOT isnan(v) AND v < double('infinity') THEN floor(ln(v) / ln(base)) END""",
    """log_score(v DOUBLE, offset BIGINT, base DOUBLE) RETURNS DOUBLE RETURN
        (CASE WHEN base > 0 THEN 1 ELSE -1 END) * ln(greatest(v + offset, 1D)) / ln(abs(base))""",
)


def register(spark: SparkSession) -> None:
    """normalize_path(p), geometric_bucket(v, base) and log_score(v, offset, base) for the session's SQL."""
    for text in _DEFINED:
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION " + text)


def register_tokenizer(spark: SparkSession, tokenizer) -> None:
    """token_ids(text) and token_strings(text) of a trained byte-pair tokenizer."""
    from tastemill.operators.bpe import Applied

    shared = spark.sparkContext.broadcast(tokenizer)

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        applied = Applied(shared.value)
        for part in texts:
            yield part.map(lambda t: applied.text(t or ""))

    @F.pandas_udf("array<string>")
    def strings(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        applied, names = Applied(shared.value), shared.value.vocabulary
        for part in texts:
            yield part.map(lambda t: [names[i] for i in applied.text(t or "")])

    spark.udf.register("token_ids", ids)
    spark.udf.register("token_strings", strings)
