"""Gapless numbering in key order without a single task."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keys of the sample that range bounds come from, a part.
SAMPLED = 8


def bounds(df: DataFrame, key: str, parts: int) -> list:
    """Keys that cut df into about even ranges: quantiles of a hash sample of SAMPLED keys a part."""
    stride = max(1, df.count() // (SAMPLED * parts))
    sample = df.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(stride)) == 0)).select(key).distinct()
    marks = sorted(r[0] for r in sample.collect())  # SAMPLED keys a part
    return sorted({marks[k * len(marks) // parts] for k in range(1, parts)}) if marks else []


def _ranged(df: DataFrame, key: str, parts: int) -> DataFrame:
    edges = bounds(df, key, parts)

    @F.pandas_udf("int")
    def part(keys: pd.Series) -> pd.Series:
        return pd.Series([0 if pd.isna(k) else bisect_right(edges, k) for k in keys], dtype="int32")

    return df.withColumn("_part", part(F.col(key)))


def gapless(df: DataFrame, key: str, name: str, parts: int | None = None) -> DataFrame:
    """Number rows from 0 in order of a unique key of any orderable type (null first): ranks within ranges of the key, plus
    the counts before. The ranges follow the data; bounds reach the tasks as a list, whatever their number."""
    parts = parts or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = _ranged(df, key, parts)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))  # `parts` rows at most
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return ranged.withColumn("_rank", rank).join(F.broadcast(counts), "_part").withColumn(name, F.col("_before") + F.col("_rank")).drop("_part", "_n", "_before", "_rank")


def within(df: DataFrame, group: str, key: str, name: str, size: str | None = None, parts: int | None = None) -> DataFrame:
    """Number the rows of each group (null is one) from 0 in order of a key that is unique in it, and give the group's size.
    A group is ranked range by range of the key, so one that holds most rows is no single task's work."""
    parts = parts or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = _ranged(df, key, parts)
    every = Window.partitionBy("_group")
    before = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(F.col(group).alias("_group"), "_part").agg(F.count(F.lit(1)).alias("_n"))  # `parts` rows a group at most
    counts = counts.select("_group", F.col("_part").alias("_range"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(every).alias("_size"))
    rank = F.row_number().over(Window.partitionBy(group, "_part").orderBy(key)) - 1
    both = ranged.withColumn("_rank", rank).join(counts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_range")))
    numbered = both.withColumn(name, F.col("_before") + F.col("_rank"))
    return (numbered.withColumn(size, F.col("_size")) if size else numbered).drop("_part", "_rank", "_group", "_range", "_before", "_size")
