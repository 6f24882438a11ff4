"""Ordered per-group calculations that stay parallel when one group is huge.

A window over (group) alone sends a hot group to a single task. Here the order axis is cut into
slices, each (group, slice) is numbered on its own, and the per-slice totals - one short row per
slice - supply the offset. The results equal those of the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_numbers(df: DataFrame, group: list[str], order: list[Column], slice_by: Column, name: str = "rn", descending: bool = False) -> DataFrame:
    """row_number over (group) by ``order``; ``slice_by`` must be monotone in that order."""
    sliced = df.withColumn("_slice", slice_by)
    local = F.row_number().over(Window.partitionBy(*group, "_slice").orderBy(*order))
    counts = sliced.groupBy(*group, "_slice").agg(F.count("*").alias("_n"))
    along = F.desc("_slice") if descending else F.asc("_slice")
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy(along).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    joined = sliced.withColumn("_local", local).join(offsets, [*group, "_slice"])
    return joined.withColumn(name, (F.col("_local") + F.col("_before")).cast("long")).drop("_slice", "_local", "_before")


def first_per_group(df: DataFrame, group: list[str], order: list[Column], k: int = 1, slices: int = 64, name: str = "rank") -> DataFrame:
    """First k rows of each group: k per hashed slice first, then k of those few."""
    cells = F.pmod(F.xxhash64(*df.columns), F.lit(slices))
    local = df.withColumn("_cell", cells)
    local = local.withColumn("_rn", F.row_number().over(Window.partitionBy(*group, "_cell").orderBy(*order))).filter(F.col("_rn") <= k)
    final = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return local.drop("_rn", "_cell").withColumn(name, final).filter(F.col(name) <= k)
