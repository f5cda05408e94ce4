"""MGF text: a scan with declared columns, and a writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VALID_CHARGE = tuple(range(1, 11))


def read_mgf(spark: SparkSession, path: str, ms_level: int = 2, valid_charge: tuple[int, ...] | None = VALID_CHARGE, recursive: bool = False) -> DataFrame:
    """source_path, title, precursor_mz, charge, annotation, peaks, status of each spectrum below path.

    Files are split between END IONS lines, so one large file is read by many tasks. A spectrum whose peaks can't be
    parsed has status `corrupt` and no peaks; a charge outside valid_charge drops it (a missing one is 0). At MS level
    1 there is no precursor and no charge filter. The label stays with its spectrum.
    """
    reader = spark.read.option("lineSep", "\nEND IONS").option("recursiveFileLookup", str(recursive).lower())
    if recursive:
        reader = reader.option("pathGlobFilter", "*.mgf")
    raw = reader.text(path).select(F.col("_metadata.file_path").alias("source_path"), F.regexp_replace("value", "\r", "").alias("v")).where(F.col("v").contains("BEGIN IONS"))
    field = lambda name: F.nullif(F.trim(F.regexp_extract("v", rf"(?m)^{name}=(.*)$", 1)), F.lit(""))
    rows = F.filter(F.split("v", "\n"), lambda x: x.rlike(r"^\s*[-+.0-9]"))
    number = lambda x, i: F.get(F.split(F.trim(x), r"\s+"), F.lit(i)).try_cast("double")
    peaks = F.transform(rows, lambda x: F.struct(number(x, 0).alias("mz"), number(x, 1).alias("intensity")))
    broken = F.exists(peaks, lambda p: p["mz"].isNull() | p["intensity"].isNull())
    mz, charge = F.split(field("PEPMASS"), r"\s+")[0].try_cast("double"), F.coalesce(F.regexp_extract(field("CHARGE"), r"(\d+)", 1).try_cast("short"), F.lit(0).cast("short"))
    if ms_level == 1:
        mz, charge = F.lit(None).cast("double"), F.lit(0).cast("short")
    df = raw.select("source_path", field("TITLE").alias("title"), mz.alias("precursor_mz"), charge.alias("charge"), field("SEQ").alias("annotation"), F.when(~broken, peaks).alias("peaks"), F.when(broken, "corrupt").otherwise("ok").alias("status"))
    return df if ms_level == 1 or valid_charge is None else df.where(F.col("charge").isin(*valid_charge))


def mgf_text(spectra: DataFrame) -> DataFrame:
    """spectrum_id and value, the MGF text of each of spectra (spectrum_id, title, precursor_mz, charge, peaks[, annotation])."""
    peaks = F.array_join(F.transform("peaks", lambda p: F.concat_ws(" ", F.format_string("%.6f", p["mz"]), F.format_string("%.6f", p["intensity"]))), "\n")
    seq = [F.concat(F.lit("SEQ="), F.col("annotation"))] if "annotation" in spectra.columns else []
    head = [F.concat(F.lit("TITLE="), F.col("title")), F.concat(F.lit("PEPMASS="), F.format_string("%.6f", "precursor_mz")), F.concat(F.lit("CHARGE="), F.col("charge").cast("string"), F.lit("+")), *seq]
    return spectra.select("spectrum_id", F.concat_ws("\n", F.lit("BEGIN IONS"), *head, F.nullif(peaks, F.lit("")), F.lit("END IONS")).alias("value"))


def write_mgf(spectra: DataFrame, path: str) -> None:
    mgf_text(spectra).select("value").write.option("lineSep", "\n\n").text(path)
