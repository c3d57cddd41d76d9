"""All registered queries: ``queries()`` and ``oracle_sql()`` for the driver."""

from __future__ import annotations

from functools import wraps

from kwhrecon.plans import queries_t1, queries_t2, queries_t3
from kwhrecon.session import prepare


def _all() -> dict:
    return queries_t1.Q | queries_t2.Q | queries_t3.Q


def _prepared(query):
    @wraps(query)
    def run(spark, sf_dir):
        prepare(spark)
        return query(spark, sf_dir)
    return run


def queries() -> dict:
    return {k: _prepared(v[0]) for k, v in _all().items()}


def oracle_sql() -> dict:
    return {k: v[1] for k, v in _all().items() if v[1] is not None}
