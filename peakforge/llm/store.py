"""Written tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset in local mode, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        return re.sub("^file:/+", "file:///", whole).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="peakforge-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/peakforge/{uuid.uuid4().hex}/{name}"


#: Bytes of an Arrow batch of texts. JVM and worker each hold two or more at a time, so Spark's own limit costs hundreds of MB.
ARROW_BYTES = 8 << 20
_ARROW_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def narrow_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run meanwhile send batches of ARROW_BYTES to Python, unless the session has set a limit of its own."""
    if spark.conf.get(_ARROW_LIMIT, None) is not None:
        yield
        return
    spark.conf.set(_ARROW_LIMIT, ARROW_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(_ARROW_LIMIT)


def written(df: DataFrame, name: str, codec: str = "snappy", hashes: bool = False) -> DataFrame:
    """df, computed once and kept as Parquet in the shared folder: a lost executor costs no recomputation of what lies before.

    hashes says that most values are, so that no dictionary of them is tried.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).option("parquet.enable.dictionary", str(not hashes).lower()).parquet(path)
    collect(spark)
    return spark.read.schema(df.schema).parquet(path)


def collect(spark: SparkSession) -> None:
    """Let go of shuffles and broadcasts of finished plans: Spark removes their files once the driver has collected the plans."""
    spark._jvm.System.gc()


#: Bytes of Parquet up to which a written table may be broadcast.
BROADCAST = 8 << 20


def small(df: DataFrame, most: int = BROADCAST) -> DataFrame:
    """A table made by written(), marked for a broadcast if its files take at most so many bytes; beyond that Spark shuffles it."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f.rpartition("/")[0])
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength() <= most:
            return F.broadcast(df)
    return df


def free_name(df: DataFrame) -> str:
    """A column name that df does not have, nor any that begins with it."""
    name = "_own"
    while any(c.lower().startswith(name) for c in df.columns):
        name += "_"
    return name


def drop(df: DataFrame) -> None:
    """Delete a table made by written(), once nothing reads it any more."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f.rpartition("/")[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
