"""Incremental work: what changed since the last snapshot, by content hash."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Version of the snapshot's layout; another one is not read.
SNAPSHOT_VERSION = 1


def content_hash(content: Column) -> Column:
    """SHA-256 of a string or binary, lower-case hex."""
    return F.sha2(content.cast("binary"), 256)


def diff(current: DataFrame, previous: DataFrame, key: str, digest: str = "hash") -> DataFrame:
    """(key, state): ``hit`` (same hash), ``changed``, ``new`` or ``removed``."""
    now = current.select(F.col(key), F.col(digest).alias("__now"))
    then = previous.select(F.col(key), F.col(digest).alias("__then"))
    state = F.when(F.col("__then").isNull(), "new").when(F.col("__now").isNull(), "removed").when(F.col("__now") == F.col("__then"), "hit").otherwise("changed")
    return now.join(then, key, "full_outer").select(key, state.alias("state"))


def split(current: DataFrame, previous: DataFrame, key: str, digest: str = "hash") -> tuple[DataFrame, DataFrame]:
    """(hits, misses): hits are ``previous`` rows that still hold, misses the ``current`` rows to work on anew."""
    keys = [key, digest]
    hits = previous.join(current.select(*keys), keys, "left_semi")
    return hits, current.join(previous.select(*keys), keys, "left_anti")


def write_snapshot(df: DataFrame, path: str, engine: str = "1") -> None:
    """A new snapshot beside the old one; a pointer-like folder name with the time, so a reader never sees half of it."""
    stamped = df.withColumn("cache_version", F.lit(SNAPSHOT_VERSION)).withColumn("engine_version", F.lit(engine)).withColumn("created_at", F.unix_timestamp())
    stamped.write.parquet(f"{path}/at={time.time_ns():020d}")


def read_snapshot(spark: SparkSession, path: str, engine: str = "1") -> DataFrame | None:
    """The latest whole snapshot; None where there is none or its version or the engine's major version differs."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(conf)
    if not fs.exists(top):
        return None
    whole = [str(s.getPath()) for s in fs.listStatus(top) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    if not whole:
        return None
    df = spark.read.parquet(max(whole))
    head = df.select("cache_version", "engine_version").first()
    if head is not None and (head["cache_version"] != SNAPSHOT_VERSION or not compatible(head["engine_version"], engine)):
        return None
    return df.drop("cache_version", "engine_version", "created_at")


def compatible(a: str, b: str) -> bool:
    """Same major version."""
    return a.partition(".")[0] == b.partition(".")[0]
