"""All queries over the driver's tables, gathered from the modules of this folder."""

from __future__ import annotations

from collections.abc import Callable

from folioscope.plans import benchmark_plans, digest_plans, geometry_plans, ingest_plans, quality_plans, report_plans, review_plans, revision_plans, store_plans, stream_plans

MODULES = (benchmark_plans, quality_plans, geometry_plans, revision_plans, store_plans, digest_plans, ingest_plans, review_plans, report_plans, stream_plans)


def queries() -> dict[str, Callable]:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
