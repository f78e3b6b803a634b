"""Row positions and running sums that never put a whole group, or the whole table, in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions.names import col
from strideframe.storage import materialise


def default_ranges(df: DataFrame) -> int:
    """Order ranges of a running sum: four per shuffle partition, so a range is a fraction of a task.

    The driver holds one number per range; there is no ceiling, as ranges would then grow with the data."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, 4 * partitions)


def _order_ranges(orders: DataFrame, ranges: int) -> Bucketizer:
    """Cut the order axis at its approximate quantiles; the driver gets ``ranges`` numbers."""
    steps = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(orders.approxQuantile("_order", steps, 1 / (4 * ranges)))) or [0.0]
    inner = [c for c in cuts if abs(c) != float("inf")] or [0.0]
    return Bucketizer(splits=[-float("inf"), *inner, float("inf")], inputCol="_order", outputCol="_range")


def running_sum(
    df: DataFrame,
    order: Column,
    out: str,
    weight: Column | None = None,
    group: Sequence[str] = (),
    ties: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``weight`` (1 by default) over the rows up to and including each row.

    ``order`` is numeric and without NULLs; ``ties`` make it total. The order axis is cut at its
    approximate quantiles, taken over all groups together. A (group, range) cell then holds at most
    about 1/``ranges`` of the table even when one group is a third of it, and the running sum is the
    sum inside the cell plus the totals of the group's earlier cells, of which there are at most
    ``ranges``. The cut points only decide where work runs: any cut gives the same result.
    """
    group = list(group)
    weight = F.lit(1) if weight is None else weight
    # the double only chooses the range (a cast keeps the order); rows are sorted by what was given
    keyed = df.withColumn("_order", order.cast("double")).withColumn("_sort", order).withColumn("_weight", weight)
    keyed = _order_ranges(keyed.select("_order"), ranges or default_ranges(df)).transform(keyed)

    cell = [*group, "_range"]
    earlier = Window.partitionBy(*[col(g) for g in group]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        keyed.groupBy(*[col(c) for c in cell])
        .agg(F.sum("_weight").alias("_cell_sum"))
        .withColumn("_before", F.coalesce(F.sum("_cell_sum").over(earlier), F.lit(0)))
        .select(*[col(c).alias(f"_cell_{i}") for i, c in enumerate(cell)], "_before")
    )
    inside = (
        Window.partitionBy(*[col(c) for c in cell])
        .orderBy("_sort", *[col(t) for t in ties])
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    same = F.lit(True)
    for i, c in enumerate(cell):
        same = same & col(c).eqNullSafe(F.col(f"_cell_{i}"))  # a NULL group is a group
    summed = keyed.withColumn("_inside", F.sum("_weight").over(inside)).join(cells, same)
    return summed.select(*[col(c) for c in df.columns], (F.col("_before") + F.col("_inside")).alias(out))


def row_position(
    df: DataFrame,
    order: Column,
    out: str,
    group: Sequence[str] = (),
    ties: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Zero-based position of each row in its group: the frame number of unnumbered samples."""
    counted = running_sum(df, order, "_count", None, group, ties, ranges)
    return counted.withColumn(out, F.col("_count") - 1).drop("_count")


def sorted_index(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Zero-based index of each row in the order of any sort keys, strings included.

    The sorted table is checkpointed, so its partitions are fixed; a row's index is its place in
    its partition plus the sizes of the partitions before. Meant for file-level tables.
    """
    placed = materialise(df.orderBy(*order)).withColumn("_mid", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_mid", 33)).withColumn(
        "_place", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    )
    # One row per partition of the sorted table: a number the session sets, not the data.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_size"))
        .withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .select("_part", "_start")
    )
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(out, F.col("_start") + F.col("_place"))
        .select(*[col(c) for c in df.columns], out)
    )
