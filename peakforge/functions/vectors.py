"""Array functions of the contrastive stage and the encoders."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def log_softmax(a: Column) -> Column:
    top = F.array_max(a)
    return F.transform(a, lambda x: x - top - F.log(F.aggregate(a, F.lit(0.0), lambda s, y: s + F.exp(y - top))))


def wavelengths(n: int, low: float = 0.001, high: float = 10000.0) -> list[float]:
    if low <= 0 or high <= 0:
        raise ValueError("wavelengths must be greater than 0")
    return [low / (2 * math.pi) * (high / low) ** (i / (n - 1)) for i in range(n)]


def float_encoding(x: Column, size: int, low: float = 0.001, high: float = 10000.0) -> Column:
    """Sines, then cosines, of x over geometric wavelengths."""
    half = math.ceil(size / 2)
    return F.array(*[F.sin(x / t) for t in wavelengths(half, low, high)], *[F.cos(x / t) for t in wavelengths(size - half, low, high)])


def positional_encoding(x: Column, position: Column, size: int, low: float = 1.0, high: float = 10000.0) -> Column:
    """x, the vector at a position of a sequence, plus the encoding of that position."""
    return F.zip_with(x, float_encoding(position.cast("double"), size, low, high), lambda a, b: a.cast("double") + b)


def rotate(a: Column, angles: Column) -> Column:
    """Rotary embedding in the half-split layout."""
    half = (F.size(a) / 2).cast("int")
    x, y = F.slice(a, F.lit(1), half), F.slice(a, half + 1, half)
    left = F.zip_with(F.zip_with(x, y, lambda p, q: F.struct(p.alias("p"), q.alias("q"))), angles, lambda s, t: s["p"] * F.cos(t) - s["q"] * F.sin(t))
    right = F.zip_with(F.zip_with(x, y, lambda p, q: F.struct(p.alias("p"), q.alias("q"))), angles, lambda s, t: s["q"] * F.cos(t) + s["p"] * F.sin(t))
    return F.concat(left, right)


def learning_rate(step: Column, warmup: int, steps: int, cycles: int = 1, decay: float = 5.0) -> Column:
    """Factor on the peak rate: linear warm-up, then cosine cycles whose peaks fall by decay."""
    cycle = max(1, steps - warmup) / max(1, cycles)
    after = (step - warmup).cast("double") / cycle
    return F.when(step < warmup, step / float(max(1, warmup))).otherwise(F.greatest(F.lit(0.0), F.pow(F.lit(decay), -F.floor(after)) * 0.5 * (1 + F.cos(math.pi * (after - F.floor(after))))))


def warmup_steps(value: float, total: int) -> int:
    return int(value * total) if isinstance(value, float) and value < 1 else int(value)


def attention_pool(rows: DataFrame, by: str) -> DataFrame:
    """(by, dim, v): of rows (by, score, vector), the mean of vectors weighted with the softmax of scores in each group; a null score counts as masked out."""
    weight = F.exp(F.col("score") - F.max("score").over(Window.partitionBy(by)))
    parts = rows.where("score is not null").select(by, weight.alias("w"), F.posexplode("vector").alias("dim", "x"))
    return parts.groupBy(by, "dim").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("v"))
