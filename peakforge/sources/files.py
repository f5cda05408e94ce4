"""Other files: the peak store, predictions, FASTA."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREDICTIONS = "pred_mz double, pred_peptide string, pred_score double, direction string, fwd_score double, fwd_peptide string, rev_score double, rev_peptide string, precursor_mz double, charge int, gt_peptide string"


def write_store(spectra: DataFrame, path: str, row_group: int = 16 << 20) -> None:
    """Spectra as Parquet with arrays of peaks, clustered by charge and precursor m/z, so that row groups can be passed over by both."""
    order = ["charge", "precursor_mz"]
    spectra.repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.size", row_group).parquet(path)


def read_store(spark: SparkSession, path: str, charges: tuple[int, ...] | None = None, mz: tuple[float, float] | None = None) -> DataFrame:
    """Spectra of a store, by charge and by precursor m/z (both ends included) if asked."""
    df = spark.read.parquet(path)
    df = df.where(F.col("charge").isin(*charges)) if charges else df
    return df.where(F.col("precursor_mz").between(*mz)) if mz else df


def read_predictions(spark: SparkSession, path: str, schema: str = PREDICTIONS) -> DataFrame:
    """A CSV or TSV of predictions; empty strings stay empty and NA stays a text."""
    df = spark.read.schema(schema).option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").csv(path)
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def write_predictions(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.option("header", True).option("sep", sep).csv(path)


def read_fasta(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """(name, sequence) of each record; a record begins at a > that begins a line, so one within a header is part of it. n: at most so many.

    Files are split at records and read by many tasks. Lines of a sequence are joined without their white space.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "\\A>", "").alias("value")).where(F.trim("value") != "")
    lines = F.split("value", "\n")
    df = rows.select(F.trim(F.replace(lines[0], F.lit("\r"), F.lit(""))).alias("name"), F.regexp_replace(F.array_join(F.slice(lines, 2, F.size(lines)), ""), r"\s", "").alias("sequence"))
    return df.limit(n) if n else df


def write_fasta(df: DataFrame, path: str, width: int = 60) -> None:
    """Records of df (name, sequence), sequences in lines of so many letters."""
    wrapped = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    df.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), wrapped)).write.text(path)
