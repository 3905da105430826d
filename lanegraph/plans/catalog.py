"""Named plans over a dataset folder, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lanegraph.plans import audits, feeds, graphs, more, routes, scalars, spatial, travel

Plan = Callable[[SparkSession, str], DataFrame]

#: name: (plan, SQL or None where SQL cannot express it)
_PLANS: dict[str, tuple[Plan, str | None]] = scalars.PLANS | spatial.PLANS | routes.PLANS | graphs.PLANS | travel.PLANS | more.PLANS | audits.PLANS | feeds.PLANS


def queries() -> dict[str, Plan]:
    return {name: plan for name, (plan, _) in _PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _PLANS.items() if sql}
