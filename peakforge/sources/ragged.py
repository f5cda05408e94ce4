"""The flat store: all peaks one after another by position, and an index with start and length for each spectrum.

A spectrum's peaks are a slice of positions. The table is sorted by position, in small row groups, so a slice is read by ranges that
the Parquet scan compares with the row groups' statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakforge.operators.ordered import running

#: Up to so many spectra are read by ranges in the scan's filter; more of them are joined.
RANGES = 256


def offsets(counts: DataFrame) -> DataFrame:
    """(spectrum_id, n_peaks, start) from (spectrum_id, n_peaks): where each spectrum begins in the order of ids."""
    whole = running(counts.select("spectrum_id", "n_peaks"), [], ["spectrum_id"], end="n_peaks")
    return whole.select("spectrum_id", "n_peaks", (F.col("end") - F.col("n_peaks")).alias("start"))


def write_ragged(spectra: DataFrame, path: str, row_group: int = 16 << 20) -> None:
    """Write `path`/index and `path`/peaks from (spectrum_id, peaks array of mz and intensity); ids are unique, null peaks none."""
    n = F.greatest(F.size("peaks"), F.lit(0)).cast("long")
    index = offsets(spectra.select("spectrum_id", n.alias("n_peaks")))
    index.repartitionByRange("spectrum_id").sortWithinPartitions("spectrum_id").write.parquet(f"{path}/index")
    index = spectra.sparkSession.read.parquet(f"{path}/index")
    flat = spectra.join(index, "spectrum_id").select("start", F.posexplode("peaks").alias("k", "p")).select((F.col("start") + F.col("k")).alias("position"), "p.mz", "p.intensity")
    flat.repartitionByRange("position").sortWithinPartitions("position").write.option("parquet.block.size", row_group).parquet(f"{path}/peaks")


def slices(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """(spectrum_id, pos, mz, intensity) of some spectra, RANGES at most: their slices as ranges in the scan's filter."""
    assert len(ids) <= RANGES
    index = spark.read.parquet(f"{path}/index")
    found = index.where(F.col("spectrum_id").isin(ids) & (F.col("n_peaks") > 0)).collect()  # a row for each id
    peaks = spark.read.parquet(f"{path}/peaks")
    at = F.col("position")
    wanted = F.lit(False)
    for r in found:
        wanted = wanted | ((at >= r.start) & (at < r.start + r.n_peaks))
    rows = spark.createDataFrame([(r.spectrum_id, r.start, r.start + r.n_peaks) for r in found], "spectrum_id long, start long, end long")
    return peaks.where(wanted).join(F.broadcast(rows), (at >= F.col("start")) & (at < F.col("end"))).select("spectrum_id", (at - F.col("start")).alias("pos"), "mz", "intensity")


def lookup(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """(spectrum_id, pos, mz, intensity) of the spectra in ids (spectrum_id), any number of them; ids that aren't there have no rows."""
    few = [r[0] for r in ids.select("spectrum_id").where("spectrum_id is not null").distinct().limit(RANGES + 1).collect()]
    if len(few) <= RANGES:
        return slices(spark, path, few)
    index = spark.read.parquet(f"{path}/index").where("n_peaks > 0").join(ids.select("spectrum_id").distinct(), "spectrum_id")
    places = index.select("spectrum_id", "start", F.explode(F.sequence("start", F.col("start") + F.col("n_peaks") - 1)).alias("position"))
    return spark.read.parquet(f"{path}/peaks").join(places, "position").select("spectrum_id", (F.col("position") - F.col("start")).alias("pos"), "mz", "intensity")
