"""Whitening of embeddings onto their first principal components.

Entries become integers, floor(256 c). The fit list is each distinct integer vector once. Its rows are centred exactly before anything
is multiplied: with S = n q + r per dimension, x - S/n is the integer x - q less the fraction r/n, so one rounding remains.
RowMatrix.computeGramianMatrix of these rows, divided by n, is the covariance; eigh runs on the driver over d x d numbers; the
components are broadcast and applied in mapInPandas.

Left out: null vectors, vectors with null, NaN or infinite entries or with entries of 2^53 or more in size (floor(256 c) then may exceed
what is added here in longs), and vectors of another length than most have (the longer of equally frequent ones; empty ones always).
Repeated rows are returned each, null ids too; ids and vectors are all that is read. Equal eigenvalues have any basis of their space.
A component without variance can't be whitened: whitened is null there, explained 0 and identity_error is over the others (null if there
are none). An empty table, or one of broken rows, gives no rows. deviation is null where it exceeds a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakforge.llm.store import drop, written

SCALE, LARGEST = 256, float(1 << 53)


def whole_vectors(df: DataFrame, vector: str, scale: int, largest: float = LARGEST) -> DataFrame:
    """(vec_id, x): vectors without broken entries as floor(scale * entry), of the length that most have."""
    sound = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < largest)
    entries = F.col(vector).cast("array<double>")
    x = F.transform(entries, lambda c: F.floor(scale * c).cast("long"))
    return df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(F.forall(entries, sound)).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def main_length(rows: DataFrame) -> int:
    """The length most vectors have, 0 without any."""
    top = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).agg(F.max_by("d", F.struct("n", "d"))).first()
    return top[0] or 0


def _gramian(rows: DataFrame, vector: Column) -> np.ndarray:
    """Sum of the outer products of a column of double arrays."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(vector).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def _projection(axes: np.ndarray, scales: np.ndarray, means: tuple[np.ndarray, np.ndarray], n: int) -> Callable[[np.ndarray], tuple[np.ndarray, list]]:
    """From integer rows to their whitened components and the sum of (n x - S)^2."""
    q, r = means

    def project(x: np.ndarray) -> tuple[np.ndarray, list]:
        shifted = x - q
        with np.errstate(divide="ignore", invalid="ignore"):
            white = (shifted.astype(float) - r / n) @ axes / scales
        most = n * (int(np.abs(shifted).max(initial=0)) + 1)
        if x.shape[1] * most * most < 1 << 63:
            return white, (np.square(n * shifted - r).sum(axis=1)).tolist()
        sums = (sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, r, strict=True)) for row in shifted)
        return white, [s if s < 1 << 63 else None for s in sums]

    return project


def whiten(df: DataFrame, vector: str = "embedding", components: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each sound row and the first components."""
    spark = df.sparkSession
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole_vectors(df, vector, SCALE)
    d = main_length(rows)
    if not d:
        return spark.createDataFrame([], out)
    rows = rows.where(F.size("x") == d)
    fit = written(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "fit", hashes=True)
    n = fit.count()
    sums = dict(fit.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(18,0)"))).collect())  # d rows
    whole, rest = zip(*(divmod(int(sums[i]), n) for i in range(d)), strict=True)
    means = np.array(whole, np.int64), np.array(rest, np.int64)

    listed = lambda values: F.array(*[F.lit(v) for v in values])
    shifted = F.zip_with("x", listed(means[0].tolist()), lambda a, b: a - b)
    centred = F.zip_with(shifted, listed([int(r) / n for r in rest]), lambda a, f: a.cast("double") - f)
    covariance = _gramian(fit, centred) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    k = min(components, d)
    trace = float(np.trace(covariance))
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    flat = values <= trace * d * np.finfo(float).eps  # no variance but rounding
    values = np.where(flat, 0.0, values)
    explained = (values / trace if trace > 0 else np.zeros(k)).tolist()
    shared = spark.sparkContext.broadcast((axes, np.sqrt(values), means, n))

    def whitened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        project = _projection(*shared.value)
        for b in batches:
            if len(b):
                white, deviation = project(np.stack(b["x"].to_numpy()).astype(np.int64))
                yield pd.DataFrame({"key": b["key"], "deviation": pd.array(deviation, "Int64"), "white": list(white)})

    apply = lambda t, key: t.select(key.cast("string").alias("key"), "x").mapInPandas(whitened, "key string, deviation long, white array<double>")
    kept = [i for i in range(k) if not flat[i]]
    error = None
    if kept:
        white = apply(fit, F.lit(None)).select(F.array(*[F.col("white")[i] for i in kept]).alias("w"))
        mean = white.agg(*[F.avg(F.col("w")[i]) for i in range(len(kept))]).first()
        centred = F.zip_with("w", listed(list(mean)), lambda a, b: a - b)
        error = float(np.abs(_gramian(white, centred) / n - np.eye(len(kept))).max())
    drop(fit)

    each = apply(rows, F.col("vec_id")).select(F.col("key").cast("long").alias("vec_id"), "deviation", F.posexplode("white").alias("i", "w"))
    sound = F.when(listed([not f for f in flat.tolist()])[F.col("i")], F.col("w"))
    return each.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", sound.alias("whitened"),
        listed(explained)[F.col("i")].alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
