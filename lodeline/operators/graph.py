"""Directed graphs as ``edges(src, dst)`` and ``nodes(id)``: reachability, levels, depths, degrees, ids."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeline.operators.shipping import ship
from lodeline.operators.tables import at_most, materialise, small_side

#: Edges that one Python worker searches; larger graphs are searched by joins, round by round.
LOCAL_EDGES = 2_000_000
#: Hops of the distributed search between two tables on disk, and tables before they are made one.
HOPS_PER_ROUND, TABLES = 3, 64
#: Rows that one task numbers; more are numbered by range.
LOCAL_IDS = 200_000


def build_edges(refs: DataFrame, nodes: DataFrame, src: str, ref: str, node: str, self_edges: bool = True) -> DataFrame:
    """Edges (src, dst) from references to known nodes, each once. ``self_edges``: keep those from a node to itself."""
    known = nodes.select(F.col(node).alias("dst")).where("dst is not null").distinct()
    edges = refs.select(F.col(src).alias("src"), F.col(ref).alias("dst")).join(known, "dst", "left_semi").select("src", "dst").distinct()
    return edges if self_edges else edges.where("src <> dst")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def valid_roots(roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """The roots (id) that are nodes (id), each once."""
    return roots.select("id").join(nodes.select("id"), "id", "left_semi").distinct()


def _search(src: np.ndarray, dst: np.ndarray, start: np.ndarray, count: int, limit: int | None) -> np.ndarray:
    """Levels of 0..count-1 from the start, -1 where it isn't reached."""
    order = np.argsort(src, kind="stable")
    heads = dst[order]
    first = np.searchsorted(src[order], np.arange(count + 1))
    level = np.full(count, -1, np.int64)
    front, depth = np.unique(start), 0
    level[front] = 0
    while len(front) and (limit is None or depth < limit):
        depth += 1
        sizes = first[front + 1] - first[front]
        at = np.repeat(first[front] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        front = np.unique(heads[at])
        front = front[level[front] < 0]
        level[front] = depth
    return level


def _local(edges: DataFrame, roots: DataFrame, limit: int | None) -> DataFrame:
    kind = roots.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not (parts := [f for f in frames if len(f)]):
            return
        rows = pd.concat(parts, ignore_index=True)
        is_root = rows["root"].to_numpy(dtype=bool)
        codes, ids = pd.factorize(pd.concat([rows["src"][~is_root], rows["dst"]], ignore_index=True))
        n = int((~is_root).sum())
        ends = codes[n:]
        level = _search(codes[:n], ends[~is_root], ends[is_root], len(ids), limit)
        got = np.flatnonzero(level >= 0)
        yield pd.DataFrame({"id": ids[got], "level": level[got]})

    ship(edges.sparkSession)
    # A root's src is its id as well, so that no null turns whole numbers into floats.
    rows = edges.select("src", "dst", F.lit(False).alias("root")).unionByName(roots.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(True).alias("root")))
    # Not coalesced, which would pull the work before into the one task as well.
    return rows.where("src is not null and dst is not null").repartition(1).mapInPandas(run, f"id {kind}, level bigint")


def _distributed(edges: DataFrame, roots: DataFrame, limit: int | None) -> DataFrame:
    """Rounds of hops; each round's new nodes are a table of their own, so what is reached is never written again.

    A lost executor costs a round. The front is the last hop of the last table.
    """
    # Found once; each round reads them again and, while the front is small, joins without moving them.
    edges = materialise(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    tables = [materialise(roots.select("id", F.lit(0).cast("bigint").alias("level")).where("id is not null").distinct())]
    front, depth = tables[0], 0
    while limit is None or depth < limit:
        new, reached = [], reduce(DataFrame.unionByName, tables).select("id")
        for _ in range(min(HOPS_PER_ROUND, limit - depth) if limit is not None else HOPS_PER_ROUND):
            depth += 1
            step = front.join(edges, front["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
            front = step.join(reached, "id", "left_anti").withColumn("level", F.lit(depth).cast("bigint"))
            reached = reached.union(front.select("id"))
            new.append(front)
        tables.append(materialise(reduce(DataFrame.unionByName, new)))
        front = tables[-1].where(F.col("level") == depth)
        if front.isEmpty():
            break
        if len(tables) > TABLES:
            tables = [materialise(reduce(DataFrame.unionByName, tables))]
    return reduce(DataFrame.unionByName, tables)


def reach(edges: DataFrame, roots: DataFrame, mode: str = "auto", max_level: int | None = None) -> DataFrame:
    """(id, level): all that the roots (id) reach, with the fewest hops from any of them; the roots have level 0.

    Cycles, self edges, repeated edges and roots without edges are fine; null ids are left out. ``mode``:
    ``local`` searches in one Python worker, ``distributed`` by joins, ``auto`` by the numbers of edges and roots.
    """
    if mode not in ("auto", "local", "distributed"):
        raise ValueError(f"unknown mode: {mode}")
    local = mode == "local" or (mode == "auto" and at_most(edges, LOCAL_EDGES) and at_most(roots, LOCAL_EDGES))
    return (_local if local else _distributed)(edges, roots, max_level)


def dead_nodes(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """Rows of ``nodes`` (id, ...) whose id isn't in ``reached`` (id)."""
    return nodes.join(reached.select("id"), "id", "left_anti")


def levels_by_source(edges: DataFrame, roots: DataFrame, max_level: int | None = None, mode: str = "auto") -> DataFrame:
    """(source, id, level): a search of its own from each root, spread over tasks by root.

    A graph beyond LOCAL_EDGES is searched by joins on (source, id).
    """
    kind = roots.schema["id"].dataType.simpleString()
    roots = roots.select("id").where("id is not null").distinct()
    if mode == "distributed" or (mode == "auto" and not at_most(edges, LOCAL_EDGES)):
        edges = materialise(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
        seen = front = materialise(roots.select(F.col("id").alias("source"), "id", F.lit(0).cast("bigint").alias("level")))
        depth = 0
        while max_level is None or depth < max_level:
            depth += 1
            step = front.join(edges, front["id"] == edges["src"]).select("source", F.col("dst").alias("id")).distinct()
            front = materialise(step.join(seen.select("source", "id"), ["source", "id"], "left_anti").withColumn("level", F.lit(depth).cast("bigint")))
            if front.isEmpty():
                break
            seen = materialise(seen.unionByName(front))
        return seen
    pairs = edges.select("src", "dst").where("src is not null and dst is not null").toPandas()  # LOCAL_EDGES rows at most
    codes, ids = pd.factorize(pd.concat([pairs["src"], pairs["dst"]], ignore_index=True))
    shared = roots.sparkSession.sparkContext.broadcast((codes[: len(pairs)], codes[len(pairs) :], ids))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        src, dst, names = shared.value
        place = {x: i for i, x in enumerate(names)}
        for frame in frames:
            for root in frame["id"]:
                if root not in place:
                    yield pd.DataFrame({"source": [root], "id": [root], "level": [0]})
                    continue
                level = _search(src, dst, np.array([place[root]]), len(names), max_level)
                got = np.flatnonzero(level >= 0)
                yield pd.DataFrame({"source": [root] * len(got), "id": names[got], "level": level[got]})

    ship(roots.sparkSession)
    return roots.mapInPandas(run, f"source {kind}, id {kind}, level bigint")


def depth_by_source(edges: DataFrame, roots: DataFrame, max_level: int | None = None) -> DataFrame:
    """(source, depth): the largest level that each root's own search comes to."""
    return levels_by_source(edges, roots, max_level).groupBy("source").agg(F.max("level").alias("depth"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree), naught where a node has no edge."""
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return nodes.select("id").join(into, "id", "left").join(out, "id", "left").select("id", zero("in_degree"), zero("out_degree"))


def reference_counts(refs: DataFrame, ref: str = "ref") -> DataFrame:
    """(id, references): how often each name is referred to, known or not."""
    return refs.groupBy(F.col(ref).alias("id")).agg(F.count(F.lit(1)).alias("references"))


def neighbour_liveness(nodes: DataFrame, edges: DataFrame, dead: DataFrame) -> DataFrame:
    """(id, deps, dead_deps, dependents, dead_dependents) of every node."""
    flags = dead.select("id", F.lit(1).cast("bigint").alias("d"))
    out = edges.join(flags.withColumnRenamed("id", "dst"), "dst", "left").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deps"), F.count("d").alias("dead_deps"))
    into = edges.join(flags.withColumnRenamed("id", "src"), "src", "left").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("dependents"), F.count("d").alias("dead_dependents"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return nodes.select("id").join(out, "id", "left").join(into, "id", "left").select("id", *map(zero, ("deps", "dead_deps", "dependents", "dead_dependents")))


def callers(edges: DataFrame) -> DataFrame:
    """(id, callers, first_caller) of every node that has one."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("callers"), F.min("src").alias("first_caller"))


def numeric_ids(nodes: DataFrame, key: str = "id", to: str = "number") -> DataFrame:
    """``nodes`` with 0-based numbers in the order of ``key``, which is unique.

    Beyond LOCAL_IDS rows they are sorted by range into a table; its parts are numbered apart and moved up by
    the sizes of those before, of which there are as many as parts.
    """
    if at_most(nodes, LOCAL_IDS):
        return nodes.withColumn(to, (F.row_number().over(Window.orderBy(key)) - 1).cast("bigint"))
    parts = materialise(nodes.repartitionByRange(F.col(key)).withColumn("__part", F.spark_partition_id()))
    sizes = sorted((r["__part"], r["count"]) for r in parts.groupBy("__part").count().collect())
    starts = np.r_[0, np.cumsum([n for _, n in sizes])[:-1]].tolist()
    offsets = nodes.sparkSession.createDataFrame([(p, int(s)) for (p, _), s in zip(sizes, starts, strict=True)], "__part int, __start bigint")
    number = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1 + F.col("__start")
    return parts.join(F.broadcast(offsets), "__part").withColumn(to, number.cast("bigint")).drop("__part", "__start")


def numeric_edges(edges: DataFrame, numbered: DataFrame, key: str = "id", number: str = "number") -> DataFrame:
    """(src, dst) as numbers; edges with an end that has none are left out."""
    side = small_side(numbered.select(key, number))
    a = side.select(F.col(key).alias("src"), F.col(number).alias("a"))
    b = side.select(F.col(key).alias("dst"), F.col(number).alias("b"))
    return edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def graph_stats(nodes: DataFrame, edges: DataFrame, reached: DataFrame) -> DataFrame:
    """One row: nodes, edges, reachable, dead."""
    flagged = nodes.select("id").join(reached.select("id", F.lit(1).alias("r")), "id", "left")
    counts = flagged.agg(F.count(F.lit(1)).alias("nodes"), F.count("r").alias("reachable"))
    return counts.crossJoin(edges.agg(F.count(F.lit(1)).alias("edges"))).select("nodes", "edges", "reachable", (F.col("nodes") - F.col("reachable")).alias("dead"))
