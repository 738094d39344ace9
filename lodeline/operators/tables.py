"""Intermediate tables and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.errors import ConfigError

#: Rows of a side that is broadcast at most; what is larger is joined by a shuffle.
BROADCAST_ROWS = 500_000


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset a temporary one, but only in local mode: no other machine sees it."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigError("spark.checkpoint.dir must name a folder that all executors share")
        if not (base := _OWN.get(spark.sparkContext.applicationId)):
            base = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="lodeline-")
    return f"{base}/lodeline/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a table in the shared folder, which goes when the driver ends, or sooner by ``forget``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def forget(df: DataFrame) -> None:
    """Removes the table that ``materialise`` wrote for this very DataFrame, if it did; nothing may read it any more."""
    if path := df.__dict__.get("_table"):
        spark = df.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has so many rows or fewer; it stops counting beyond."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it is small."""
    return F.broadcast(df) if at_most(df, rows) else df
