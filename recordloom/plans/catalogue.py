"""All queries of the library outside the optional subpackages, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordloom.plans import catalogues, cleaning, extra, feeds, linking, more, prep, quality, reports, review, scalars, versions

MODULES = [quality, scalars, review, linking, reports, feeds, prep, more, extra, catalogues, cleaning, versions]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
