"""Running sums over the ordered rows of groups that may be larger than a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rounds import settled


def with_running_sums(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """``rows`` with, for each (name, column) of ``sums``, the sum of the column over the rows before it in its group.

    Rows are dealt by ranges of (group, order) and summed within each range; what stands in earlier ranges comes from one row for each
    group and range. So a group of any size is spread over tasks. ``order`` must tell the rows of a group apart; null numbers count as 0.
    """
    key = [*group, *order]
    placed = settled(rows.repartitionByRange(*key).withColumn("__range", F.spark_partition_id()))
    within = Window.partitionBy(*group, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    ranges = placed.groupBy(*group, "__range").agg(*(F.sum(c).alias(f"__{name}") for name, c in sums.items())).withColumns({f"__{name}": F.coalesce(F.sum(f"__{name}").over(earlier), none) for name in sums})
    ranges = ranges.select(*(F.col(c).alias(f"__{c}") for c in (*group, "__range")), *(f"__{name}" for name in sums))
    local = placed.withColumns({name: F.coalesce(F.sum(c).over(within), none) for name, c in sums.items()})
    met = local["__range"] == ranges["____range"]
    for c in group:
        met &= local[c].eqNullSafe(ranges[f"__{c}"])
    return local.join(ranges, met).select(*rows.columns, *((F.col(name) + F.col(f"__{name}")).alias(name) for name in sums))
