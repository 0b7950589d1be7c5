"""Every registered query over the driver's tables, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilspark.plans import boards, catalog, feedback, formats, histories, relations, scalars, screening, services, stored, streams, values

MODULES = (screening, relations, feedback, formats, boards, values, histories, scalars, services, stored, streams)
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which users hold a listed address, and why."""
    return screening.screen_all(spark, sf_dir)
