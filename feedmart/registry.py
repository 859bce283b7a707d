"""The source registry as a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import lexicons as L

DDL = "ord int, name string, label string, priority int, expected_min int, min_healthy int, degrade_on_failure boolean, allow_last_good boolean, critical boolean"


def registry_df(spark: SparkSession, sources: list[tuple] | None = None) -> DataFrame:
    """One row per source in order; a dimension of fixed size, so joins may broadcast it."""
    return spark.createDataFrame([(i, *s) for i, s in enumerate(L.SOURCES if sources is None else sources)], DDL)
