"""Re-analysis as files change: change events arrive as files, the latest of each path counts.

A file source doesn't deliver a file again that was edited in place, so edits come as events
(path, content, ts, deleted) in new files of a folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeline.functions import paths
from lodeline.operators.liveness import last_writer
from lodeline.operators.tables import materialise, shared_folder
from lodeline.plans import detectors
from lodeline.rust.facts import extract

EVENTS = "path string, content string, ts timestamp, deleted boolean"


def latest(events: DataFrame) -> DataFrame:
    """The last event of each path, without deleted ones."""
    rows = events.select("path", "content", "ts", F.coalesce("deleted", F.lit(False)).alias("deleted"))
    return last_writer(rows, ["path"], ["ts", "content"]).where("not deleted")


def diagnostics(events: DataFrame) -> DataFrame:
    """(file, severity, line, column, end_line, end_column, message) of the latest state: dead modules are warnings, files
    that can't be parsed errors. Both are of whole files, so they stand at the first character, counted from 0."""
    files = latest(events).select("path", paths.stem(F.col("path")).alias("stem"), "content")
    facts = extract(files)
    roots = files.select(paths.root_name(F.col("path")).alias("id")).where("id is not null")
    dead = detectors.dead_modules(files, facts, roots).dead
    errors = facts.where("fact = 'error'").select("file", F.lit("error").alias("severity"), F.concat(F.lit("parse error: "), "path").alias("message"))
    place = {c: F.lit(0) for c in ("line", "column", "end_line")} | {"end_column": F.lit(1)}
    told = dead.select("file", F.lit("warning").alias("severity"), F.concat(F.lit("dead module: "), "name").alias("message")).unionByName(errors)
    return told.select("file", "severity", *(v.alias(k) for k, v in place.items()), "message")


def watch(spark: SparkSession, folder: str, checkpoint: str, each: Callable[[DataFrame, int], None], analyse: Callable[[DataFrame], DataFrame] = diagnostics, schema: str = EVENTS, **trigger) -> StreamingQuery:
    """Starts a query that, for each batch of new event files (JSON lines), analyses all that has arrived.

    ``each`` gets the result and the batch's number. State is the folder itself: a restarted query needs nothing else.
    """

    def batch(_: DataFrame, number: int) -> None:
        each(analyse(spark.read.schema(schema).json(folder)), number)

    stream = spark.readStream.schema(schema).json(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def replay(spark: SparkSession, events: DataFrame, analyse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Streams a table of events through ``foreachBatch`` once, and returns what the analysis of its last batch found."""
    folder = materialise(events).inputFiles()
    source = spark.readStream.schema(events.schema).parquet(folder[0].rpartition("/")[0])
    found: list[DataFrame] = []
    checkpoint = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    query = source.writeStream.foreachBatch(lambda df, _: found.append(materialise(analyse(df)))).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query.start().awaitTermination()
    return found[-1] if found else analyse(events.limit(0))
