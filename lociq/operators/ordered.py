"""Global order and running aggregates by range partitions.

Rows are dealt by range of (keys, order), sorted within each range and written with the range's number and their place in it.
What a range adds up to is one row for each range and key; running over these few rows gives what stands before each range.
So no window runs over all rows, nor over all rows of a key: a key that holds most rows lies in many ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.scratch import keep

COMBINE = {"sum": F.sum, "min": F.min, "max": F.max}


def in_order(rows: DataFrame, keys: list[str], order: list[str | Column], name: str = "ordered") -> DataFrame:
    """rows with _range and _at, which grow in the order of (keys, order); written."""
    by = [*keys, *order]
    laid = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return keep(laid, name).withColumn("_range", F.shiftright("_at", 33))


def before_ranges(laid: DataFrame, keys: list[str], totals: dict[str, tuple[str, Column]], reverse: bool = False) -> DataFrame:
    """laid with each total (name: how to combine, aggregate of a range) over the ranges of the same keys before a row's own; null before the first.

    reverse: over the ranges after it.
    """
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    each = laid.groupBy(F.col("_range").alias("_r"), *own).agg(*[value.alias(name) for name, (_, value) in totals.items()])
    earlier = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy(F.desc("_r") if reverse else "_r").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = each.select("_r", *[f"_k{i}" for i in range(len(keys))], *[COMBINE[how](name).over(earlier).alias(name) for name, (how, _) in totals.items()])
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return laid.join(F.broadcast(offsets), same).drop("_r", *[f"_k{i}" for i in range(len(keys))])  # a row a range and key: laid is not shuffled to meet them


def placed(laid: DataFrame, keys: list[str], name: str = "_n") -> DataFrame:
    """laid with each row's place, from 1, among the rows of its keys."""
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    each = laid.groupBy(F.col("_range").alias("_r"), *own).agg(F.count("*").alias("_c"), F.min("_at").alias("_lo"))
    earlier = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.withColumn("_lo", F.coalesce(F.sum("_c").over(earlier), F.lit(0)) - F.col("_lo") + 1).drop("_c")
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return laid.join(F.broadcast(offsets), same).withColumn(name, F.col("_at") + F.col("_lo")).drop("_r", "_lo", *[f"_k{i}" for i in range(len(keys))])


def running(laid: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """laid with running sums up to and with each row: those within its range, and those of the ranges before."""
    within = Window.partitionBy("_range", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    met = before_ranges(laid, keys, {f"_b_{name}": ("sum", F.sum(value)) for name, value in sums.items()})
    for name, value in sums.items():
        met = met.withColumn(name, F.sum(value).over(within) + F.coalesce(F.col(f"_b_{name}"), F.lit(0)))
    return met.drop(*[f"_b_{name}" for name in sums])


def tidy(laid: DataFrame) -> DataFrame:
    return laid.drop("_at", "_range")
