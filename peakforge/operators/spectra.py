"""Cleaning, ranking and augmenting spectra held as arrays of peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakforge.functions import constants as K
from peakforge.functions.binding import let

#: A spectrum of which nothing is left.
DUMMY = "array(named_struct('mz', 0D, 'intensity', 1D))"


def collect_peaks(peaks: DataFrame) -> DataFrame:
    """(spectrum_id, peaks) from rows (spectrum_id, mz, intensity), peaks by m/z."""
    return peaks.groupBy("spectrum_id").agg(F.sort_array(F.collect_list(F.struct("mz", "intensity"))).alias("peaks"))


def in_range(peaks: Column, low: float, high: float) -> Column:
    return F.filter(peaks, lambda p: p["mz"].between(low, high))


def without_precursor(peaks: Column, precursor_mz: Column, charge: Column, tolerance: float = 2.0) -> Column:
    """Drop peaks within tolerance of the precursor at its charge and any lower one."""
    mass = (precursor_mz - F.lit(K.PROTON)) * charge
    places = F.when(charge > 0, F.transform(F.sequence(F.lit(1), F.greatest(charge.cast("int"), F.lit(1))), lambda k: mass / k + F.lit(K.PROTON))).otherwise(F.array().cast("array<double>"))
    return let(places, lambda at: F.filter(peaks, lambda p: ~F.exists(at, lambda x: F.abs(p["mz"] - x) <= tolerance)))


def highest(peaks: Column) -> Column:
    return F.array_max(F.transform(peaks, lambda p: p["intensity"]))


def strongest(peaks: Column, least: float, n: int) -> Column:
    """Peaks above `least` of the highest, at most n of them (by intensity, then m/z), back in m/z order."""
    some = let(highest(peaks), lambda top: F.filter(peaks, lambda p: p["intensity"] > least * top))
    order = F.sort_array(F.transform(some, lambda p: F.struct((-p["intensity"]).alias("i"), p["mz"].alias("mz"))))
    return F.sort_array(F.transform(F.slice(order, 1, n), lambda p: F.struct(p["mz"].alias("mz"), (-p["i"]).alias("intensity"))))


def root_scale(peaks: Column) -> Column:
    return let(highest(peaks), lambda top: F.transform(peaks, lambda p: F.struct(p["mz"].alias("mz"), (F.sqrt(p["intensity"]) / F.sqrt(top)).alias("intensity"))))


def or_dummy(peaks: Column) -> Column:
    return F.when(F.size(peaks) > 0, peaks).otherwise(F.expr(DUMMY))


def clean(spectra: DataFrame, low: float = 50.0, high: float = 2500.0, tolerance: float = 2.0, least: float = 0.01, n: int = 150) -> DataFrame:
    """spectra (spectrum_id, precursor_mz, charge, peaks) with peaks cleaned, row by row, in a batch or a stream.

    Steps are bound to names, so that each is computed once.
    """
    steps = (
        lambda x: without_precursor(x, F.col("precursor_mz"), F.col("charge"), tolerance),
        lambda x: strongest(x, least, n),
        root_scale,
        or_dummy,
    )
    peaks = in_range(F.col("peaks"), low, high)
    for step in steps:
        peaks = let(peaks, step)
    return spectra.withColumn("peaks", peaks)


def uniform(seed: int, name: str, *keys: Column) -> Column:
    """A number in [0, 1) for a seed, a purpose and keys: 48 bits of a hash, so draws of different purposes or keys are independent, and any engine with MD5 draws the same."""
    text = F.concat_ws(":", F.lit(f"{seed}:{name}"), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def augment(peaks: DataFrame, removal: float = 0.2, threshold: float = 0.3, perturb: float = 0.15, probability: float = 1.0, seed: int = 0, dummy: bool = False) -> DataFrame:
    """Rows (spectrum_id, pos, mz, intensity): a share of the weak peaks removed, the rest perturbed, maximum back at 1; augmented says for which spectra.

    A spectrum is augmented with the given probability, drawn once for each; others stay as they are. Of n weak peaks floor(removal * n) go,
    chosen by the hash of each. With dummy the draws are made but every spectrum is returned as it came.
    """
    from pyspark.sql import Window

    by = Window.partitionBy("spectrum_id")
    chosen = uniform(seed, "gate", F.col("spectrum_id")) < probability
    drawn = peaks.withColumns({"augmented": chosen, "weak": F.col("intensity") < threshold, "u": uniform(seed, "remove", F.col("spectrum_id"), F.col("pos"))})
    if dummy:
        return drawn.select("spectrum_id", "pos", "mz", "intensity", "augmented")
    k = F.row_number().over(Window.partitionBy("spectrum_id", "weak").orderBy("u", "pos"))
    ranked = drawn.withColumns({"k": k, "n": F.sum(F.col("weak").cast("int")).over(by)})
    left = ranked.where(~(F.col("augmented") & F.col("weak") & (F.col("k") <= F.floor(F.col("n") * removal))))
    factor = 1 - perturb * 2 * (uniform(seed, "shift", F.col("spectrum_id"), F.col("pos")) - 0.5)
    moved = left.withColumn("moved", F.when(F.col("augmented"), F.col("intensity") * factor).otherwise(F.col("intensity")))
    final = F.when(F.col("augmented"), F.col("moved") / F.max("moved").over(by)).otherwise(F.col("moved"))
    return moved.withColumn("intensity", final).select("spectrum_id", "pos", "mz", "intensity", "augmented")
