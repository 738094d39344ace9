"""Mixing sources to target weights by Pareto order sampling.

A document of a source whose target is r times its size is taken floor(r) times for certain. What is left of
the target is a sample without replacement, in which a document is included with a probability that grows with the
number of binary digits of its size, so that fragments are taken less often than whole articles; in a source the
probabilities are scaled to an expected size of what is left, and those that would pass 1 are certain. Documents are
ranked by the odds of a random number over the odds of their inclusion, and taken in that order up to the size that
is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.llm.shared import WORD, materialise

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A source's target is at most so many times its size.
MOST_COPIES = 3
#: Bins of the Pareto rank in each source; only the bin in which the sample ends is sorted.
BINS = 4096
#: Sources whose table is broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) of rows (source, size).

    All sizes together are shared by weight; no source gets more than ``most`` times its size and the excess is
    shared anew by weight until none is above. That fixpoint has one level t with target = min(most * size,
    weight * t): sorted by cap over weight, t is where the capped sources' sum and the others' weights meet.
    The table has a row for each source; only it is sorted in one task.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    rank = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int"))
    ranked = sums.withColumn("weight", weight.cast("double")).withColumn("cap", (F.col("source_size") * most).cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    capped = ranked.withColumn("level", level).withColumn("free", F.col("weight") * F.col("level") <= F.col("cap"))
    share = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"]
    return capped.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.coalesce(share, F.lit(0.0))).alias("target"))


def _uniform(key: Column, seed: str) -> Column:
    """In (0, 1), from the first 52 bits of a digest, so reruns agree and SQL can follow it."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + 0.5) / F.lit(float(2**52))


def _size_class(size: Column) -> Column:
    """Binary digits of a size, 1 for 0: what a document's inclusion is in proportion to."""
    return F.length(F.bin(size)).cast("bigint")


def _inclusion_levels(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with ``level``: a document of size class k is included with probability min(1, k * level), so that the
    expected size is what is left of the source's target.

    Classes are capped from the largest on: the level is that of the fewest capped classes at which no other passes
    1. There are at most 63 rows for each source.
    """
    classes = sized.groupBy(F.col("source").alias("c"), _size_class(F.col("size")).alias("k")).agg(F.sum("size").alias("in_class"))
    largest_first = Window.partitionBy("c").orderBy(F.desc("k"))
    capped = F.coalesce(F.sum("in_class").over(largest_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    free = F.sum(F.col("k") * F.col("in_class")).over(largest_first.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = (
        classes.join(plan.where("ratio > floor(ratio)"), F.col("c").eqNullSafe(F.col("s")))
        .select("c", "k", "left", capped.alias("capped"), free.alias("free"))
        .where("free > 0")
        .withColumn("level", (F.col("left") - F.col("capped")) / F.col("free"))
        .where("level * k <= 1")
        .groupBy("c")
        .agg(F.max_by("level", "k").alias("level"))
    )
    return plan.join(levels, F.col("s").eqNullSafe(F.col("c")), "left").drop("c")


def _decided(docs: DataFrame, weights: tuple, most: int, seed: str, carry: bool) -> DataFrame:
    """With ``carry`` row (a struct of all columns of ``docs``); doc_id, source, size, source_size, target, copies, taken."""
    narrow = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = materialise(narrow)  # all statistics come from this table
    whole = docs.select(F.struct("*").alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size")) if carry else sized
    few = sized.select("source").distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    side = F.broadcast if few else (lambda df: df)
    targets = source_targets(sized, weights, most).select(
        F.col("source").alias("s"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0).alias("ratio"),
    )
    whole_copies = F.floor("ratio").cast("bigint")
    targets = targets.withColumn("whole", whole_copies).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = materialise(_inclusion_levels(sized, targets))  # a row for each source
    u = _uniform(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("size").cast("string")), seed)
    inclusion = F.least(F.lit(1.0), _size_class(F.col("size")) * F.col("level"))
    # Random odds over inclusion odds.
    pareto = (u / (1 - u)) * ((1 - inclusion) / inclusion)

    def rank(rows: DataFrame) -> DataFrame:
        return (
            rows.join(side(plan), F.col("source").eqNullSafe(F.col("s")))
            .withColumn("q", F.when(F.col("level").isNotNull(), pareto))
            .withColumn("bin", F.when(F.col("q").isNotNull(), F.least(F.floor(F.col("q") / (1 + F.col("q")) * BINS), F.lit(BINS - 1)).cast("int")))
            .drop("s", "ratio")
        )

    ranked = rank(sized)
    # Sizes by source and bin are pre-aggregated: a source with a third of all rows has BINS rows here.
    bins = ranked.where("bin is not null").groupBy("source", "bin").agg(F.sum("size").alias("in_bin"), F.first("left").alias("left"))
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        bins.withColumn("below", F.coalesce(F.sum("in_bin").over(run), F.lit(0)))
        .where((F.col("below") < F.col("left")) & (F.col("below") + F.col("in_bin") >= F.col("left")))
        .select(F.col("source").alias("s"), F.col("bin").alias("cut"), "below")
    )
    # Only the documents of the bin in which the sample ends, 1 in BINS, are put in order.
    order = Window.partitionBy("source").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("below") + F.sum("size").over(order)
    last = (
        ranked.join(side(cut), F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("cut")))
        .withColumn("upto", upto)
        .where((F.col("upto") <= F.col("left")) | ((F.col("upto") - F.col("size") < F.col("left")) & (F.col("upto") - F.col("left") <= F.col("size") / 2)))
        .groupBy("source")
        .agg(F.max(F.struct("q", "doc_id", "size")).alias("last"))
        .withColumnRenamed("source", "l")
    )
    ends = cut.join(last, F.col("s").eqNullSafe(F.col("l")), "left").select("s", "cut", "last")
    inside = (F.col("bin") == F.col("cut")) & F.coalesce(F.struct("q", "doc_id", "size") <= F.col("last"), F.lit(False))
    extra = F.col("bin").isNotNull() & (F.col("cut").isNull() | (F.col("bin") < F.col("cut")) | inside)
    copies = F.col("whole") + F.when(extra, 1).otherwise(0)
    decided = rank(whole).join(side(ends), F.col("source").eqNullSafe(F.col("s")), "left")
    return decided.select(*(["row"] if carry else []), "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES, seed: str = "mix") -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    A null text has size 0 and takes nothing. The null source is a source like any other, after all named ones.
    Ties of the rank go by doc_id, then size; rows that repeat both are taken alike. An empty table gives an
    empty result; other columns are not read. Each source's taken words miss its target by half a document at most.
    """
    return _decided(docs, weights, most, seed, carry=False)


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES, seed: str = "mix") -> DataFrame:
    """``docs``, all its columns, of the documents that the mix takes, with ``copies``, how often it takes them.

    A column of that name gives way. Texts of no words are taken with their source but add nothing.
    """
    decided = _decided(docs, weights, most, seed, carry=True).where("copies > 0")
    return decided.select("row.*", "copies") if "copies" not in docs.columns else decided.select(*(F.col(f"row.`{c}`") for c in docs.columns if c != "copies"), "copies")
