"""Places in a global order, without a window over all rows or over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociq.llm.session import keep


def ranked(rows: DataFrame, order: list[str], group: str | None = None, label: str = "ranked") -> DataFrame:
    """rows with `rank`, the place from 0 in `order` within the group, and `total`, the group's rows.

    Range partitions of (group, order) are numbered row by row and written; each partition's count of each group
    gives what stands before it. A group that holds most rows lies in many partitions; the table of counts has a
    row for each partition and one more for each group. Nulls come first. Rows alike in `order` may take each other's places.
    """
    by = [*([group] if group else []), *order]
    laid = keep(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), label)
    part = F.shiftright("_at", 33)
    own = F.col(group) if group else F.lit(0)
    counts = laid.groupBy(part.alias("_p"), own.alias("_g")).agg(F.count("*").alias("_n"), F.min("_at").alias("_lo"))
    each = Window.partitionBy("_g")  # a row for each partition that holds some of the group
    before = F.coalesce(F.sum("_n").over(each.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = keep(counts.select("_p", "_g", "_lo", before.alias("_b"), F.sum("_n").over(each).alias("total")), f"{label}-counts")
    met = laid.join(offsets, (part == offsets["_p"]) & own.eqNullSafe(offsets["_g"]))
    return met.withColumn("rank", F.col("_at") - F.col("_lo") + F.col("_b")).drop("_at", "_p", "_g", "_lo", "_b")
