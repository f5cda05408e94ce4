"""Shuffled batches of a fixed size, and batches padded to rectangles with masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakforge.operators.ordered import numbered


def shuffle_key(seed: int, *ids: Column) -> Column:
    """A pseudo-random text from a seed and ids, the same wherever it is computed; null ids count as `null`."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(i.cast("string"), F.lit("null")) for i in ids]))


def shuffled_batches(df: DataFrame, ids: list[str], size: int, seed: int, first: list[Column] | None = None) -> DataFrame:
    """df with row (its place in the shuffled order) and batch; all batches but the last have `size` rows.

    The order follows from seed and ids alone, for every partitioning; another seed is another epoch. `first` comes before the shuffle
    in the order, as a class of lengths, so that batches pad little. ids should tell all rows apart.
    """
    order = [*(first or []), shuffle_key(seed, *[F.col(c) for c in ids]), *ids]
    return numbered(df, order).withColumn("batch", F.floor(F.col("row") / size))


def padded(df: DataFrame, values: str, batch: str = "batch", pad: Column | None = None) -> DataFrame:
    """df with the arrays of `values` padded to the longest of their batch, width, and mask: true where the value is no padding.

    A null array is an empty one. A value that equals the padding is masked too, as it can't be told apart.
    """
    pad = F.lit(0) if pad is None else pad
    kind = df.schema[values].dataType.elementType
    own = F.coalesce(values, F.array().cast(df.schema[values].dataType))
    wide = df.withColumn(values, own).withColumn("width", F.max(F.size(values)).over(Window.partitionBy(batch)))
    fill = F.array_repeat(pad.cast(kind), F.col("width") - F.size(values))
    wide = wide.withColumn(values, F.concat(values, fill))
    return wide.withColumn("mask", F.transform(values, lambda x: ~x.eqNullSafe(pad.cast(kind))))


def merge_batches(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts, fields by name. Parts whose fields or types differ are an error, not widened or filled."""
    if not parts:
        raise ValueError("no batches to merge")
    kinds = [{f.name: f.dataType.simpleString() for f in p.schema} for p in parts]
    for i, k in enumerate(kinds):
        if k != kinds[0]:
            odd = sorted(n for n in kinds[0].keys() | k.keys() if kinds[0].get(n) != k.get(n))
            raise TypeError(f"batch {i} differs in {', '.join(odd)}")
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return merged
