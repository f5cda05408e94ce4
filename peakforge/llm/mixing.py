"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakforge.llm.store import drop, free_name, written

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeated as often as needed.
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
#: Keys are counted in so many ranges; only the range that holds a source's last document is sorted.
RANGES = 4096
SYMBOLS = "#*$%&|<>"


def words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def quality_weight(size: Column, text: str = "text") -> Column:
    """1 for a text without signs of markup or junk, less with every such sign for each word."""
    t = F.coalesce(F.col(text), F.lit(""))
    signs = F.length(t) - F.length(F.translate(t, SYMBOLS, ""))
    return F.lit(1.0) / (F.lit(1.0) + F.lit(10.0) * signs / F.greatest(size, F.lit(1)))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) that only the id and the seed decide, the same in any engine that has md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(2.0**48)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes (source, source_size) with target: share of all sizes by weight, at most `most` times a source's size.

    Sources are filled in the order in which they reach their limit; one level for all others then leaves none above.
    """
    n = len(weights)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(rank - 1, F.lit(n)) + 1).cast("int"))
    s = sizes.select("source", "source_size", weight.alias("w"), rank.alias("k"))
    s = s.withColumn("room", F.col("source_size") * most / F.col("w"))
    order = Window.orderBy("room", "k")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))
    s = s.withColumn("level", (F.sum("source_size").over(all_) * F.lit(float(share)) - full) / F.sum("w").over(after))
    first = F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "k", "level"))).over(all_)
    s = s.withColumn("level", first.getField("level"))
    cap = (F.col("source_size") * most).cast("double")
    return s.select("source", "source_size", F.least(cap, F.coalesce(F.col("level") * F.col("w"), cap)).alias("target"))


def _range(key: Column) -> Column:
    """RANGES ranges of keys in ascending order; keys of any quality spread over many of them."""
    return F.floor(key / (key + 1) * RANGES)


def plan(docs: DataFrame, seed: int = 0, **options) -> tuple[DataFrame, DataFrame, Column, Column]:
    """(one row per document, one row per source, size, key): what decides how often each document is taken.

    A source row has source, source_size, target, epochs, last_range and last (key, doc_id, size).
    """
    size = words()
    key = -F.log(uniform(F.col("doc_id"), seed)) / quality_weight(size)
    narrow = docs.select("doc_id", "source", size.alias("size"), key.alias("key"))
    narrow = written(narrow.withColumn("part", _range(F.col("key"))), "mix")
    by = Window.partitionBy("source")
    sums = narrow.groupBy("source", "part").agg(F.sum("size").alias("size"))
    goal = targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), **options)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
    goal = written(goal.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), "goals")
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    run = sums.withColumn("before", F.sum("size").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    edge = run.alias("a").join(goal.alias("b"), same).where((F.col("before") < F.col("budget")) & (F.col("before") + F.col("a.size") >= F.col("budget"))).select("a.source", F.col("part"), "before", "budget")
    same = same & (F.col("a.part") == F.col("b.part"))
    near = narrow.alias("a").join(edge.alias("b"), same).groupBy("a.source", "a.part", "key", "doc_id", "a.size", "before", "budget").agg((F.count("*") * F.col("a.size")).alias("all"))
    upto = F.sum("all").over(by.orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    taken = near.withColumn("upto", F.col("before") + upto).where(F.col("upto") - F.col("all") / 2 <= F.col("budget"))
    last = taken.groupBy("source").agg(F.max(F.struct("key", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "size")).alias("last"))
    edge = edge.select("source", F.col("part").alias("last_part"))
    out = goal.alias("a").join(edge.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.*", "last_part")
    out = out.alias("a").join(last.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.source", "source_size", "target", "epochs", "last_part", "last")
    out = written(out, "plan")
    drop(goal)
    return narrow, out, size, key


def _times(size: Column, key: Column, part: Column) -> Column:
    own = F.struct(key.alias("key"), F.coalesce(F.col("d.doc_id"), F.lit(-(2**63))).alias("doc_id"), size.alias("size"))
    extra = (part < F.col("p.last_part")) | ((part == F.col("p.last_part")) & (own <= F.col("p.last")))
    return (F.col("p.epochs") + F.coalesce(extra.cast("int"), F.lit(0))).cast("int")


def mix_sources(docs: DataFrame, seed: int = 0, **options) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, size, source_size, target, taken, times.

    size is the number of words (null text: 0). Every document of a source is taken in as many complete epochs as fit
    its target; the rest goes to the documents with the smallest Efraimidis-Spirakis keys -ln(u) / quality, u from a
    hash of doc_id and seed, until their sizes reach the rest of the target; the document that crosses it is taken if
    that comes nearer. taken = size * times. Null is a source of its own, after all others. Rows with the same
    source, doc_id and size are taken together. A source without words has target 0. Reruns agree.

    A source is never gathered: sizes are summed over RANGES key ranges, and only the one range in which the budget
    ends is sorted. The verdict is then a limit for each source, so no text is shuffled.
    """
    narrow, goals, _, _ = plan(docs, seed, **options)
    d = narrow.alias("d")
    joined = d.join(goals.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    times = _times(F.col("d.size"), F.col("d.key"), F.col("d.part"))
    return joined.select("d.doc_id", "d.size", "source_size", "target", (F.col("d.size") * times).cast("long").alias("taken"), times.alias("times"))


def mixed(docs: DataFrame, seed: int = 0, **options) -> DataFrame:
    """The rows of docs, each as often as mix_sources takes it, all columns unchanged."""
    narrow, goals, size, key = plan(docs, seed, **options)
    drop(narrow)
    own = free_name(docs)
    col = lambda c: F.col(f"d.{own}.{c}")
    d = docs.withColumn(own, F.struct(size.alias("size"), key.alias("key"))).alias("d")
    joined = d.join(goals.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    times = _times(col("size"), col("key"), _range(col("key")))
    rows = joined.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))).alias(own))
    return rows.drop(own)
