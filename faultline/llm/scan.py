"""Ranks in sorted order without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

#: monotonically_increasing_id holds the partition above this bit and the row's place below it.
PLACE_BITS = 33


def ranked(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds `rank`, from 0 without gaps inside each group by `order` (nulls first), and `group_rows`.

    Rows are dealt by ranges of (group, order), so that a group of any size spreads over many tasks, and numbered inside their
    range; what a group has in the ranges before is a sum over one row per range. Rows equal in group and order share one
    range: the caller counts copies first. The table is written before it is used twice, so that a lost executor cannot
    number anew what others have read."""
    keys = [*group, *order]
    rows = checkpoint(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("mid", F.monotonically_increasing_id()))
    rows = rows.withColumn("range", F.shiftright("mid", PLACE_BITS))
    inside = rows.groupBy("range", *group).agg(F.min("mid").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(*group)
    sizes = inside.select(*[F.col(c).alias(f"g_{c}") for c in group], F.col("range").alias("g_range"), "first",
                          (F.sum("n").over(whole.orderBy("range")) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("group_rows"))
    same = rows["range"] == F.col("g_range")
    for c in group:
        same = same & rows[c].eqNullSafe(F.col(f"g_{c}"))
    return rows.join(sizes, same).select(*df.columns, (F.col("before") + F.col("mid") - F.col("first")).alias("rank"), "group_rows")


def running(df: DataFrame, at: str, values: dict[str, Column], block: int = 1 << 16) -> DataFrame:
    """Adds, per name, the sum of its values up to and with the row, by the dense position `at` (from 0). Blocks of positions
    are summed by themselves; one row per block carries the sums on."""
    rows = df.withColumns({"block": F.floor(F.col(at) / block), **{f"v_{k}": v for k, v in values.items()}})
    inside = Window.partitionBy("block").orderBy(at)
    sums = rows.groupBy("block").agg(*[F.sum(f"v_{k}").alias(f"s_{k}") for k in values])
    # One row per 65,536 positions meets here, a number that a single task takes at any size of the table.
    over = Window.partitionBy(F.lit(0)).orderBy("block")
    carried = sums.select("block", *[(F.sum(f"s_{k}").over(over) - F.col(f"s_{k}")).alias(f"c_{k}") for k in values])
    return rows.withColumns({f"i_{k}": F.sum(f"v_{k}").over(inside) for k in values}).join(carried, "block").select(
        *df.columns, *[(F.col(f"i_{k}") + F.col(f"c_{k}")).alias(k) for k in values])
