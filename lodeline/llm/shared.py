"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.operators.shipping import ship
from lodeline.operators.tables import forget, materialise, shared_folder

__all__ = ["WORD", "forget", "held_out", "in_training", "labelled_rows", "labelled_sample", "labels_per_row", "map_arrow", "materialise", "once", "place_among", "session", "shared_folder", "ship", "split_points", "texts"]

#: ASCII blanks; ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of an Arrow batch; a batch holds whole texts, so it must stay small.
BATCH_ROWS, BATCH_BYTES = 512, 2 << 20


def session(df: DataFrame) -> SparkSession:
    """The session, with this package on its executors. Where Spark's own bound of 64 MB for an Arrow batch stands, it is
    lowered to BATCH_BYTES; a bound that the user has set is kept."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(_BOUND) in ("64MB", "67108864b", str(64 << 20)):
        spark.conf.set(_BOUND, f"{BATCH_BYTES}b")
    return spark


_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has BATCH_ROWS rows and about BATCH_BYTES at most, or one row."""
    for batch in batches:
        rows = min(BATCH_ROWS, max(1, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_arrow(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """``df`` batch by batch through ``each``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield each(batch)

    return df.mapInArrow(run, schema)


#: Stretches that a key is cut into at most, and sampled keys for each.
STRETCHES, SAMPLED = 131_072, 4


def split_points(keys: DataFrame, rows: int, per: int) -> list[tuple]:
    """Sorted, different rows of ``keys`` (bigint columns; ``rows`` rows) that cut it into stretches of about ``per`` rows.

    They are quantiles of a sample, SAMPLED keys for each of STRETCHES stretches at most, so that neither stray nor
    crowded keys make a stretch larger than the keys' own repeats do.
    """
    count = min(STRETCHES, rows // per)
    if count < 2:
        return []
    share = min(1.0, count * SAMPLED / rows)
    sample = keys if share == 1.0 else keys.sample(fraction=share, seed=5)
    found = sorted(tuple(r) for r in sample.dropna().collect())
    return sorted({found[len(found) * i // count] for i in range(1, count)}) if found else []


def place_among(keys: list[Column], points: list[tuple]) -> Column:
    """How many of the sorted points are at most the key: a binary search in literals. Of a null key that compares with none it is 0."""
    if not points:
        return F.lit(0)
    parts = [F.split(F.lit(",".join(map(str, part))), ",").cast("array<bigint>") for part in zip(*points, strict=True)]  # folded to literals

    def reached(at: Column) -> Column:
        out = F.lit(True)
        for key, part in reversed(list(zip(keys, parts, strict=True))):
            out = (F.get(part, at) < key) | ((F.get(part, at) == key) & out)
        return out

    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(points).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(reached(at + step - 1), at + step).otherwise(at))


def in_training(doc_id: Column) -> Column:
    """Rows from which labels may be learnt: all but the held-out quarter."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(~in_training(doc_id), F.lit(False))


def _training_labels(labels: DataFrame, target: str) -> DataFrame:
    """(doc_id, label) of the training rows. Null labels are left out; of a doc_id with several labels the largest counts."""
    return (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(target).cast("int").alias("label"))
        .where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & in_training(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )


def labels_per_row(labels: DataFrame, target: str, per_class: int) -> tuple[float, float]:
    """How many training labels each row of ``labelled_rows`` stands for, by label: 1 up to ``per_class`` of them.

    Weighted so, the sample has the classes' own ratio at every size.
    """
    counts = {r["label"]: r["count"] for r in _training_labels(labels, target).where("label in (0, 1)").groupBy("label").count().collect()}
    return tuple(max(1.0, counts.get(x, 0) / per_class) for x in (0, 1))


def labelled_rows(docs: DataFrame, labels: DataFrame, target: str, per_class: int) -> DataFrame:
    """(rank, text, label): at most ``per_class`` training texts of either label, chosen by a hash of doc_id, so the same ones in each run.

    The choice is made among the labels, which are narrow; only the chosen ids, a bounded number, are joined
    with the texts. Rows with a null label or text are left out. Of a doc_id with several labels the largest counts.
    """
    known = _training_labels(labels, target).withColumn("rank", F.md5(F.col("doc_id").cast("string").cast("binary")))
    chosen = [known.where(F.col("label") == x).orderBy("rank").limit(per_class) for x in (0, 1)]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * per_class rows at most
    return (
        docs.select("doc_id", "text")
        .where(F.col("text").isNotNull())
        .join(picked, "doc_id")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.first("label").alias("label"), F.first("rank").alias("rank"))
        .select("rank", "text", "label")
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, per_class: int, per_row: tuple[float, float]) -> list[tuple[bytes, int]]:
    """The texts and labels of ``labelled_rows``, in the order of their rank, stretched by ``per_row`` so that a class
    cut by the bound, whose ranks are all low, is spread over the whole sample."""
    rows = labelled_rows(docs, labels, target, per_class).collect()
    place = lambda r: (int(r["rank"][:13], 16) * per_row[r["label"]], r["rank"])
    return [(r["text"].encode("utf-8", "surrogatepass"), r["label"]) for r in sorted(rows, key=place)]


_ON_WORKER: dict = {}


def once(key, make: Callable):
    """What ``make`` returns, made once in each Python worker."""
    if key not in _ON_WORKER:
        if len(_ON_WORKER) > 8:
            _ON_WORKER.clear()
        _ON_WORKER[key] = make()
    return _ON_WORKER[key]
