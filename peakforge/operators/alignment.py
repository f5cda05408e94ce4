"""Tables of results side by side: by key, by common items, predictions by truth, and strategies in their own order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def align(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Full outer alignment of any number of tables on key: <name>_<column> of each, and in_<name>; null keys meet too.

    One shuffle for all tables, as rows are stacked and grouped, instead of a join for each. A key should be unique in a table;
    of repeated rows the largest counts.
    """
    stacked, out = None, []
    for name, df in tables.items():
        columns = [c for c in df.columns if c != key]
        row = F.struct(F.lit(1).alias("_"), *[F.col(f"`{c}`") for c in columns])
        one = df.select(F.col(f"`{key}`").alias(key), row.alias(f"_{name}"))
        stacked = one if stacked is None else stacked.unionByName(one, allowMissingColumns=True)
        out += [F.col(f"_{name}.`{c}`").alias(f"{name}_{c}") for c in columns] + [F.col(f"_{name}").isNotNull().alias(f"in_{name}")]
    return stacked.groupBy(key).agg(*[F.max(f"_{n}").alias(f"_{n}") for n in tables]).select(key, *out)


def common_items(items: DataFrame, folder: str, item: str, folders: list[str] | None = None) -> DataFrame:
    """The items that every folder has (of those named, if any are): an intersection by counting, in one shuffle of distinct pairs.

    Folders that hold nothing aren't there and don't count; null folders and items are none.
    """
    pairs = items.select(F.col(folder).alias("f"), F.col(item).alias(item)).where("f is not null").dropna(subset=[item])
    if folders is not None:
        pairs = pairs.where(F.col("f").isin(folders))
    pairs = pairs.distinct()
    n = pairs.agg(F.count_distinct("f")).first()[0]
    return pairs.groupBy(item).agg(F.count("*").alias("n")).where(F.col("n") == n).select(item)


def with_truth(truth: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """truth and predicted by key, misses of both sides kept: status is `both`, `no prediction` or `no truth`. Null keys meet nothing.

    Other columns must differ in name. Several predictions of one key give a row each.
    """
    t, p = truth.withColumn("_true", F.lit(True)), predicted.withColumn("_given", F.lit(True))
    status = F.when(F.col("_true").isNull(), "no truth").when(F.col("_given").isNull(), "no prediction").otherwise("both")
    return t.join(p, key, "full").withColumn("status", status).drop("_true", "_given")


def merge_counters(counters: list[DataFrame], keys: list[str], count: str = "n") -> DataFrame:
    """One counter from many: the sums of `count` by keys, nested as deep as keys go. Null keys meet, a null count adds nothing.

    Each counter is a table of its own with any repeated keys; all go through one shuffle, combined on the map side.
    """
    stacked = None
    for c in counters:
        rows = c.select(*[F.col(f"`{k}`").alias(k) for k in keys], F.col(f"`{count}`").cast("long").alias(count))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    return stacked.groupBy(*keys).agg(F.coalesce(F.sum(count), F.lit(0).cast("long")).alias(count))


def strategy_rank(name: Column) -> Column:
    """Greedy ones first (-1), beam_N by N, all others last (9999)."""
    second = F.get(F.split(name, "_"), F.lit(1))
    number = F.when(second.rlike("^[0-9]+$"), second.try_cast("long"))
    return F.when(F.contains(F.lower(name), F.lit("greedy")), F.lit(-1).cast("long")).otherwise(F.coalesce(number, F.lit(9999).cast("long")))
