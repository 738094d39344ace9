"""The corpus pipeline: documents through five stages of ``lodeline.llm``, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the
columns of ``documents``, the last adds ``copies``. An empty table goes through every stage as an empty table, and
further columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeline.llm import decontaminate, minhash, mixing, pii, toxicity
from lodeline.llm.shared import forget, materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score is 0.3 or more.

    Learnt from the labelled training rows among ``docs``; with none of them nothing can be called toxic and every row
    stays. Null and empty texts stay, as do rows without a doc_id if their text is clean; rows that repeat are judged alike.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the least doc_id.

    Texts without words (null, empty, blank) are like no other and stay. Of rows that repeat a doc_id one stays; rows
    without a doc_id stay.
    """
    return minhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold benchmark passages in a twentieth of their words or more.

    Null and empty texts stay; rows that repeat are judged alike; an empty benchmark removes nothing.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data masked in the text and n_chars counted anew where it was. A null text stays null."""
    return pii.mask_personal_data(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``copies``, how often.

    The null source is a source. Texts without words are taken with their source but add nothing; rows that repeat
    doc_id and size are taken alike.
    """
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
