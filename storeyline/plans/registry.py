"""All queries of the plan-geometry engine, with their oracle SQL."""

from __future__ import annotations

from storeyline.plans import fixtures, kernels, recognition


def queries() -> dict:
    return {**kernels.QUERIES, **fixtures.QUERIES, **recognition.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**kernels.ORACLE_SQL, **fixtures.ORACLE_SQL, **recognition.ORACLE_SQL}
