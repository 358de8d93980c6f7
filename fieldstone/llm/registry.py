"""The queries of this subpackage, one for each operator."""

from __future__ import annotations

from . import (
    centroid_clustering,
    context_tree_lm,
    decontamination,
    filter_audit,
    language_id,
    line_dedup,
    quality_classifier,
    secret_scan,
    simhash_dedup,
    source_mixing,
    token_counts,
    toxicity,
    vector_search,
)

MODULES = (
    token_counts, context_tree_lm, source_mixing, vector_search, language_id, quality_classifier, decontamination, simhash_dedup, secret_scan, toxicity, filter_audit, centroid_clustering,
    line_dedup,
)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
