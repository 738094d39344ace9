"""Liveness: what is declared and not used, by one key, several keys, or any of several keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dead(declared: DataFrame, used: DataFrame, on: dict[str, str] | list[str]) -> DataFrame:
    """Rows of ``declared`` that ``used`` has no match for. ``on``: key columns, as names or declared name to used name.

    A null key matches nothing, so such a row is dead.
    """
    pairs = on if isinstance(on, dict) else {k: k for k in on}
    keys = used.select(*(F.col(u).alias(f"__used_{i}") for i, u in enumerate(pairs.values()))).distinct()
    match = [declared[d] == F.col(f"__used_{i}") for i, d in enumerate(pairs)]
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    return declared.join(keys, condition, "left_anti")


def union_keys(*used: tuple[DataFrame, str], to: str = "key") -> DataFrame:
    """(``to``): the different values of one column of each of several tables; nulls are left out."""
    parts = [df.select(F.col(c).alias(to)) for df, c in used]
    return reduce(DataFrame.union, parts).where(F.col(to).isNotNull()).distinct()


def dead_by_all(declared: DataFrame, evidence: list[tuple[DataFrame, dict[str, str] | list[str]]], required: Column | None = None) -> DataFrame:
    """Rows that are alive by none of several (used, on), nor by ``required``: one anti join after the other."""
    out = declared if required is None else declared.where(~F.coalesce(required, F.lit(False)))
    for used, on in evidence:
        out = dead(out, used, on)
    return out


def with_dead_flag(declared: DataFrame, dead_keys: DataFrame, on: list[str], to: str = "dead") -> DataFrame:
    """``declared`` with a boolean column that says whether its key is among ``dead_keys``."""
    marks = dead_keys.select(*on).distinct().withColumn("__dead", F.lit(True))
    return declared.join(marks, on, "left").withColumn(to, F.coalesce("__dead", F.lit(False))).drop("__dead")


def stats(flagged: DataFrame, by: list[str] | None = None, flag: str = "dead", **more: Column) -> DataFrame:
    """declared, dead and live, with further conditional counts, in all or by group, in one pass."""
    is_dead = F.col(flag)
    counts = [F.count(F.lit(1)).alias("declared"), F.count_if(is_dead).alias("dead"), F.count_if(~is_dead).alias("live")]
    counts += [F.count_if(c).alias(name) for name, c in more.items()]
    return (flagged.groupBy(*by) if by else flagged).agg(*counts)


def fully_dead_groups(flagged: DataFrame, by: list[str], flag: str = "dead") -> DataFrame:
    """Groups all of whose members are dead, with their size as ``members``."""
    return flagged.groupBy(*by).agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col(flag)).alias("__dead")).where("members = __dead").drop("__dead")


def dead_percentage(total: Column, gone: Column) -> Column:
    """Percent, 0 where there is nothing."""
    return F.when(total == 0, F.lit(0.0)).otherwise(gone * 100.0 / total)


def last_writer(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """One row for each key: that with the largest ``by``. Pre-aggregated, so a hot key costs no sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("__row"))
    return best.select(*keys, *(F.col(f"__row.`{c}`").alias(c) for c in rest))


def mask_after_flag(rows: DataFrame, group: list[str], order: list[str], flag: str, to: str = "reason") -> DataFrame:
    """Rows of ordered groups that a flagged row makes unreachable, with why.

    ``NonFinalWildcard``: flagged, yet not the last of its group. ``MaskedByWildcard``: not flagged and after a
    flagged row. Of flagged rows none is masked. ``order`` must tell the rows of a group apart.
    """
    ordered = Window.partitionBy(*group).orderBy(*order)
    earlier = F.coalesce(F.max(F.col(flag)).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    last = F.lead(F.lit(1)).over(ordered).isNull()
    reason = F.when(F.col(flag) & ~last, "NonFinalWildcard").when(~F.col(flag) & earlier, "MaskedByWildcard")
    return rows.withColumn(to, reason).where(F.col(to).isNotNull())


def sessions(rows: DataFrame, partition: list[str], order: list[str], starts: Column, to: str = "session") -> DataFrame:
    """Numbers the stretches of each ordered partition; ``starts`` says that a row begins one."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return rows.withColumn(to, F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
