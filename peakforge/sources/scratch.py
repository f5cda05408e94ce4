"""Tables written to the folder that driver and executors share, to cut lineage or to be read back in another layout."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only where that is unset in local mode, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp()
    return f"{base.rstrip('/')}/peakforge-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table", **options) -> DataFrame:
    """df, computed once and kept as Parquet: what follows doesn't repeat it, and a lost executor costs nothing that lies before."""
    path = f"{scratch(df.sparkSession)}/{name}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
