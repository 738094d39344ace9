"""Name resolution: calls by bare name, by path suffix, and through imports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.operators.tables import materialise


#: Paths of a block, about; a block of callers and one of callees meet in one row.
BLOCK = 4096
#: Pairs of paths from which such a row is dealt to any task before they are written out.
MANY = 100_000
#: Callees that come for each caller before the next ones do; a multiple of 8, as Parquet packs keys by eight.
RUN = 256
#: Edges from such rows that a task writes out, about, so that a file's dictionaries hold all of its paths.
EDGES = 32_000_000


def _tasks(called: DataFrame, callers: DataFrame, callees: DataFrame) -> int:
    """Tasks that write out rows of many pairs, 0 if there are none: by the sum over calls of the file's callers times the name's callees, which bounds their edges."""
    froms = callers.dropna().groupBy("file").agg(F.count(F.lit(1)).cast("double").alias("froms"))
    tos = callees.dropna().groupBy("name").agg(F.count(F.lit(1)).cast("double").alias("tos"))
    most = froms.agg(F.max("froms").alias("froms")).crossJoin(tos.agg(F.max("tos").alias("tos"))).first()
    if (most["froms"] or 0) * (most["tos"] or 0) < MANY:
        return 0
    pairs = called.join(froms, "file").join(tos, "name").select((F.col("froms") * F.col("tos")).alias("pairs")).where(F.col("pairs") >= MANY)
    edges = pairs.agg(F.sum("pairs")).first()[0]
    return max(2 * called.sparkSession.sparkContext.defaultParallelism, math.ceil(edges / EDGES)) if edges else 0


def _classes(rows: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Values that have the same keys are one class. (class, <value>s, <value>_block): a class's values in blocks; (class, <key>): its keys. A value is in one class."""
    of = rows.dropna().groupBy(value).agg(F.array_sort(F.collect_set(key)).alias("class"))
    sizes = of.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("blocks"))
    blocks = of.join(sizes, "class").groupBy("class", F.expr(f"pmod(xxhash64({value}), blocks)").alias("block")).agg(F.array_sort(F.collect_list(value)).alias(f"{value}s"))
    return blocks.select("class", f"{value}s", F.xxhash64("class", "block").alias(f"{value}_block")), sizes.select("class", F.explode("class").alias(key))


def name_edges(declared: DataFrame, calls: DataFrame, self_edges: bool = False, callers: DataFrame | None = None) -> DataFrame:
    """(src, dst) from every declaration of a file to all declarations of each name the file calls.

    ``declared``: (file, name, path); ``calls``: (file, name); ``callers``: (file, path) of those whose edges are
    wanted, else all declared ones. There may be far more edges than rows, so no edge is ever shuffled: paths of the
    same files are one class of callers, paths of the same names one of callees; classes are paired once, and as a
    path is in one class of a kind, what a pair's members write out is distinct. Null paths make no edge.

    What is written takes some bits an edge: a caller is the same for a run of callees, the next callers repeat that
    run while it is near enough for a file's compression, and a task has few enough paths for a file's dictionaries.
    """
    callers = (declared if callers is None else callers).select("file", F.col("path").alias("src"))
    callees = declared.select("name", F.col("path").alias("dst"))
    sources, files = _classes(callers, "file", "src")
    targets, names = _classes(callees, "name", "dst")
    called = calls.select("file", "name").distinct()
    pairs = files.withColumnRenamed("class", "by").join(called, "file").join(names.withColumnRenamed("class", "of"), "name").select("by", "of").distinct()
    rows = pairs.join(targets.withColumnRenamed("class", "of"), "of").join(sources.withColumnRenamed("class", "by"), "by")
    if tasks := _tasks(called, callers, callees):
        many = F.size("srcs").cast("long") * F.size("dsts") >= MANY
        # Large rows are few, so they are dealt evenly, those of the same callees together; small ones are written out where they are.
        rows = rows.where(~many).unionByName(rows.where(many).repartitionByRange(tasks, "dst_block", "src_block"))
    starts = F.sequence(F.lit(1), F.size("dsts"), F.lit(RUN))
    rows = rows.select("srcs", F.explode(F.transform(starts, lambda i: F.slice("dsts", i, RUN))).alias("dsts"))
    # Generated code would hold all that a row writes out at once; sorting by a function isn't compiled, so callers come one by one.
    edges = rows.select(F.explode(F.array_sort("srcs")).alias("src"), "dsts").select("src", F.explode("dsts").alias("dst"))
    return edges if self_edges else edges.where("src <> dst")


def suffixes(path: Column, separator: str) -> Column:
    """All suffixes of a path, by whole segments, the longest first."""
    parts = F.split(path, separator, -1)
    join = "::" if separator == "::" else separator.replace("\\", "")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), join))


def suffix_index(paths: DataFrame, column: str, separator: str) -> DataFrame:
    """(suffix, <column>): each path under all of its suffixes."""
    return paths.select(F.explode(suffixes(F.col(column), separator)).alias("suffix"), F.col(column)).distinct()


def _ends_in(whole: DataFrame, a: str, ends: DataFrame, b: str) -> DataFrame:
    """Pairs (a, b) in which the string ``a`` ends in the string ``b``: by equality, on the endings of ``a`` that are as long as some ``b``.

    The lengths are collected; there are as many as the longest ``b`` has characters, at most.
    """
    lengths = sorted(r[0] for r in ends.select(F.length(b)).distinct().collect())
    if not lengths:
        return whole.select(a).limit(0).withColumn(b, F.lit(None).cast("string"))
    fitting = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(a))
    endings = whole.select(a, F.explode(F.transform(fitting, lambda n: F.substr(F.col(a), F.length(a) - n + 1, n))).alias("__end"))
    return endings.join(ends, F.col("__end") == F.col(b)).select(a, b)


def suffix_matches(keys: DataFrame, key: str, paths: DataFrame, path: str, separator: str, both_ways: bool = True) -> DataFrame:
    """(key, path, how) for each key the paths that end in it.

    ``exact``: the key is a suffix by whole segments. For keys that have none, ``fallback``: the path ends in the key
    as a string or, with ``both_ways``, the key in the path. The empty string ends every string. All are joins by
    equality, so no task compares all with all.
    """
    known = paths.select(F.col(path).alias("path")).where("path is not null").distinct()
    asked = keys.select(F.col(key).alias("key")).where("key is not null").distinct()
    index = suffix_index(known, "path", separator)
    exact = asked.join(index, asked["key"] == index["suffix"]).select("key", "path", F.lit("exact").alias("how"))
    missed = materialise(asked.join(exact.select("key"), "key", "left_anti"))
    met = _ends_in(known, "path", missed, "key").select("key", "path")
    if both_ways:
        met = met.union(_ends_in(missed, "key", known, "path").select("key", "path")).distinct()
    return exact.unionByName(met.select("key", "path", F.lit("fallback").alias("how")))


def segments_to_path(segments: Column) -> Column:
    return F.when(F.size(segments) == 0, F.lit("crate")).otherwise(F.array_join(segments, "::"))


def resolve_calls(calls: DataFrame, imports: DataFrame, externals: tuple[str, ...] = ("std", "core", "alloc")) -> DataFrame:
    """``calls`` (file, call, context: the file's module segments) with resolved and via_import.

    By the call's first segment: ``crate`` is the root; ``self`` the file's module; each ``super`` its parent; an
    external crate stays; an imported name (``imports``: file, local_name, segments) is replaced by what it means;
    a name alone stays; any other path is below the file's module. Of several imports of one name in a file the least path counts.
    """
    parts = F.split("call", "::")
    used = imports.groupBy("file", F.col("local_name").alias("__local")).agg(F.min("segments").alias("__means"))
    rows = calls.withColumn("__parts", parts).withColumn("__first", F.get("__parts", F.lit(0)))
    rows = rows.join(used, (rows["file"] == used["file"]) & (rows["__first"] == used["__local"]), "left").drop(used["file"])
    rest = F.slice("__parts", 2, F.greatest(F.size("__parts") - 1, F.lit(0)))
    supers = F.size("__parts") - F.size(F.filter("__parts", lambda p: p != "super"))
    above = F.slice("context", 1, F.greatest(F.size("context") - supers, F.lit(0)))
    first = F.col("__first")
    resolved = (
        F.when(first == "crate", rest)
        .when(first == "self", F.concat("context", rest))
        .when(first == "super", F.concat(above, F.filter("__parts", lambda p: p != "super")))
        .when(first.isin(*externals), F.col("__parts"))
        .when(F.col("__means").isNotNull(), F.concat("__means", rest))
        .when(F.size("__parts") == 1, F.col("__parts"))
        .otherwise(F.concat("context", "__parts"))
    )
    return rows.withColumn("resolved", segments_to_path(resolved)).withColumn("via_import", F.col("__means").isNotNull() & ~first.isin("crate", "self", "super", *externals)).drop("__parts", "__first", "__local", "__means")


def prefixed(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """``columns`` as ``group::column``, so that groups can't meet."""
    for c in columns:
        df = df.withColumn(c, F.concat(F.col(group), F.lit("::"), F.col(c)))
    return df


