"""Running sums, row numbers and offsets over a whole table, without a window that one task has to hold.

Rows are laid out in ranges of their order; each range is summed by itself, the sums of earlier ranges are added. An order is
a list of columns, all rows of a range compare by all of them, so that ties in the first columns can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakforge.sources.scratch import written


def laid_out(df: DataFrame, *order: Column | str, ranges: int | None = None) -> DataFrame:
    """df in ranges of the order, the number of its range as _range; kept, so that ranges don't change between uses."""
    ranges = ranges or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def running(df: DataFrame, by: list[str], order: list[Column | str], ranges: int | None = None, **values: Column | str) -> DataFrame:
    """df with, for each value, its sum over this row and those before it within `by`, and as <name>_total over all of `by`.

    Nulls count 0. Rows that agree in all of the order take any order among each other.
    """
    whole = laid_out(df.withColumns({f"_{n}": F.coalesce(F.expr(c) if isinstance(c, str) else c, F.lit(0)) for n, c in values.items()}), *[F.col(c) for c in by], *order, ranges=ranges)
    parts = whole.groupBy(*by, "_range").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in values])  # a row for each range and key
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(c).alias(f"_key{i}") for i, c in enumerate(by)]
    parts = parts.select(*keys, F.col("_range").alias("_at"), *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}_before") for n in values], *[F.sum(f"_{n}").over(group).alias(f"{n}_total") for n in values])
    within = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = whole.withColumns({f"_{n}_own": F.sum(f"_{n}").over(within) for n in values})
    same = F.col("_range") == F.col("_at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_key{i}"))
    out = own.join(parts, same).withColumns({n: F.col(f"_{n}_before") + F.col(f"_{n}_own") for n in values})
    return out.select(*df.columns, *values, *[f"{n}_total" for n in values])


def numbered(df: DataFrame, order: list[Column | str], name: str = "row", ranges: int | None = None) -> DataFrame:
    """df with the number of each row in the order, from 0, the same for every partitioning if the order is total."""
    return running(df, [], order, ranges, **{name: F.lit(1).cast("long")}).drop(f"{name}_total").withColumn(name, F.col(name) - 1)
