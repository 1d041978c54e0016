"""Filters with the fallbacks that plan pipelines ask for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_JSON_CHARS = 100_000
MIN_WALLS = 4


def allow_list(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows with an allowed value; an empty list, or one that matches no row, keeps all."""
    if not allowed:
        return df
    kept = df.where(F.col(column).isin(list(allowed)))
    return df if kept.isEmpty() else kept


def json_fits(column: str | Column, most: int = MAX_JSON_CHARS) -> Column:
    return F.length(column) <= most


def existing_files(df: DataFrame, files: DataFrame, column: str) -> DataFrame:
    """Rows whose path is in a listing with a column `path`."""
    return df.join(files.select(F.col("path").alias(column)).distinct(), column, "left_semi")
