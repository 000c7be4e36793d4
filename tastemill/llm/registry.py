"""Queries and oracle statements of the subpackage, for the entry module."""

from __future__ import annotations

from . import (
    bpe_codec,
    contamination_index,
    digest_tree,
    html_differencing,
    licence_classifier,
    parity_join,
    pii_spans,
    toxicity_pu,
    url_model,
    warc_zstd,
)

MODULES = (
    toxicity_pu,
    html_differencing,
    pii_spans,
    warc_zstd,
    licence_classifier,
    contamination_index,
    bpe_codec,
    url_model,
    parity_join,
    digest_tree,
)


def queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
