"""Running totals over a global order without a single-task window.

The rows are range-partitioned by the order and written with their partition
number, so that the numbering cannot change if a task is run again. Sums per
partition (and group) are small; their running totals are added to a window
that never leaves one range partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.runtime import materialize, shuffle_partitions

PART = "_part"


def range_parts(df: DataFrame, order: list[Column], label: str = "ordered") -> DataFrame:
    """df dealt by ranges of the order, with the range's number in column _part."""
    n = shuffle_partitions(df.sparkSession)
    return materialize(df.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id()), label)


def running_totals(
    parts: DataFrame,
    order: list[Column],
    values: dict[str, Column],
    within: list[str] | None = None,
) -> DataFrame:
    """Add, for each name in values, the sum of its column over all rows up to this one.

    parts comes from range_parts() with an order that starts with the columns
    in within; totals start again for each of their values (nulls are equal).
    """
    within = within or []
    keyed = parts.withColumns({f"_v_{name}": value for name, value in values.items()})
    sums = keyed.groupBy(PART, *within).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    before = Window.partitionBy(*within).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col(PART).alias("_p"),
        *[F.col(w).alias(f"_w_{w}") for w in within],
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values],
    )
    on = keyed[PART] == starts["_p"]
    for w in within:
        on = on & keyed[w].eqNullSafe(starts[f"_w_{w}"])
    joined = keyed.join(starts, on)
    upto = Window.partitionBy(PART, *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = joined.withColumns({n: F.sum(f"_v_{n}").over(upto) + F.col(f"_o_{n}") for n in values})
    return totals.select(*parts.columns, *values)
