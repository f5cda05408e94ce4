"""Spectra as a stream: cleaning works row by row, so a stream of spectra runs through the same plan in append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from peakforge.operators.spectra import clean


def clean_stream(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """Cleaned spectra from Parquet files that arrive below path."""
    return clean(spark.readStream.schema(schema).parquet(path), **options)
