"""Queries of the library and their SQL oracles, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labelscope.plans import agreements, audit_more, audits, feeds, intakes, more, ranks, safety, tables  # noqa: F401  they register their queries
from labelscope.plans.binding import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
