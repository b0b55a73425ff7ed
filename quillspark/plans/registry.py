"""Registered queries of the engine's own operators and their SQL."""

from __future__ import annotations

from functools import wraps

from quillspark.shipping import ship_code

from . import queries_corpus, queries_metrics, queries_models, queries_retrieval, queries_rules, queries_service, queries_sources

_MODULES = (queries_retrieval, queries_corpus, queries_metrics, queries_rules, queries_service, queries_sources, queries_models)


def _shipped(f):
    @wraps(f)
    def run(spark, sf_dir):
        ship_code(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict:
    return {k: _shipped(f) for m in _MODULES for k, (f, _) in m.FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, (_, s) in m.FOUND.items() if s}
