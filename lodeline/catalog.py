"""Queries of the operators over the relational test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeline import rust_catalog
from lodeline.functions import paths
from lodeline.operators import graph, liveness, resolve, snapshot
from lodeline.plans import detectors
from lodeline.rust_catalog import parsed
from lodeline.sinks import export
from lodeline.streaming import reanalyze

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(rust_catalog.QUERIES)
SQL: dict[str, str] = dict(rust_catalog.SQL)


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TIES = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def part_edges(spark: SparkSession, sf_dir: str, rule: str = "l_quantity >= 48") -> DataFrame:
    """Parts that follow each other in an order, from lines of 48 pieces or more: with all lines every part is reached and none is dead.

    The queries named ``_whole`` that only build, count, number or print edges take those of all lines.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *_TIES)
    w = Window.partitionBy("l_orderkey").orderBy(*_TIES)
    pairs = lines.withColumn("dst", F.lead("l_partkey").over(w)).where(f"{rule} and dst is not null and dst <> l_partkey")
    return pairs.select(F.col("l_partkey").alias("src"), "dst").distinct()


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("id", F.col("p_partkey"))


def part_roots(nodes: DataFrame, below: int = 3) -> DataFrame:
    return graph.valid_roots(nodes.where(F.col("id") < below).select("id"), nodes)


_EDGES = """edges AS (SELECT DISTINCT l_partkey AS src, nxt AS dst FROM (
  SELECT l_partkey, l_quantity, lead(l_partkey) OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS nxt FROM lineitem)
  WHERE nxt IS NOT NULL AND nxt <> l_partkey AND l_quantity >= 48)"""
_ALL_EDGES = """edges AS (SELECT DISTINCT l_partkey AS src, nxt AS dst FROM (
  SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS nxt FROM lineitem)
  WHERE nxt IS NOT NULL AND nxt <> l_partkey)"""
_REACH = f"WITH RECURSIVE {_EDGES}, reach(n) AS (SELECT p_partkey FROM part WHERE p_partkey < 3 UNION SELECT dst FROM edges JOIN reach ON src = n)"
_DEAD = f"{_REACH}, dead AS (SELECT p_partkey AS n FROM part WHERE p_partkey NOT IN (SELECT n FROM reach))"


@query(f"WITH {_EDGES} SELECT src, dst FROM edges")
def module_edges(spark, sf_dir):
    return graph.build_edges(part_edges(spark, sf_dir), part_nodes(spark, sf_dir), "src", "dst", "id")


@query(f"WITH {_ALL_EDGES} SELECT src, dst FROM edges")
def module_edges_whole(spark, sf_dir):
    return graph.build_edges(part_edges(spark, sf_dir, "true"), part_nodes(spark, sf_dir), "src", "dst", "id")


@query(f"{_REACH} SELECT n AS id FROM reach")
def reachable_nodes(spark, sf_dir):
    nodes = part_nodes(spark, sf_dir)
    return graph.reach(part_edges(spark, sf_dir), part_roots(nodes)).select("id")


@query(f"{_REACH} SELECT n AS id FROM reach")
def reachable_nodes_distributed(spark, sf_dir):
    nodes = part_nodes(spark, sf_dir)
    return graph.reach(part_edges(spark, sf_dir), part_roots(nodes), mode="distributed").select("id")


@query(f"{_DEAD} SELECT n AS p_partkey FROM dead")
def dead_nodes(spark, sf_dir):
    nodes = part_nodes(spark, sf_dir)
    return graph.dead_nodes(nodes, graph.reach(part_edges(spark, sf_dir), part_roots(nodes))).select("p_partkey")


@query(f"WITH RECURSIVE {_EDGES}, reach(n) AS (SELECT 0::BIGINT UNION SELECT dst FROM edges JOIN reach ON src = n) SELECT n AS id FROM reach")
def single_root_reach(spark, sf_dir):
    return graph.reach(part_edges(spark, sf_dir), part_roots(part_nodes(spark, sf_dir), 1)).select("id")


@query(f"WITH RECURSIVE {_EDGES}, lv(n, d) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey < 3 UNION SELECT dst, d + 1 FROM edges JOIN lv ON src = n WHERE d < 6) SELECT n AS id, CAST(min(d) AS BIGINT) AS level FROM lv GROUP BY n")
def bfs_levels(spark, sf_dir):
    return graph.reach(part_edges(spark, sf_dir), part_roots(part_nodes(spark, sf_dir)), max_level=6)


@query(f"WITH RECURSIVE {_EDGES}, lv(s, n, d) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_partkey < 3 UNION SELECT s, dst, d + 1 FROM edges JOIN lv ON src = n WHERE d < 8) SELECT s AS source, CAST(max(d) AS BIGINT) AS depth FROM (SELECT s, n, min(d) AS d FROM lv GROUP BY s, n) GROUP BY s")
def max_depth_by_source(spark, sf_dir):
    return graph.depth_by_source(part_edges(spark, sf_dir), part_roots(part_nodes(spark, sf_dir)), max_level=8)


@query(None)
def bfs_levels_whole(spark, sf_dir):
    """All levels; ``bfs_levels`` stops at 6, as its SQL must to end on cycles."""
    return graph.reach(part_edges(spark, sf_dir), part_roots(part_nodes(spark, sf_dir)))


@query(None)
def max_depth_by_source_whole(spark, sf_dir):
    """The depth of each root's whole search; ``max_depth_by_source`` stops at 8, as its SQL must to end on cycles."""
    return graph.depth_by_source(part_edges(spark, sf_dir), part_roots(part_nodes(spark, sf_dir)))


@query(f"{_DEAD} SELECT (SELECT count(*) FROM part) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM reach) AS reachable, (SELECT count(*) FROM dead) AS dead")
def graph_stats(spark, sf_dir):
    nodes, edges = part_nodes(spark, sf_dir), part_edges(spark, sf_dir)
    return graph.graph_stats(nodes, edges, graph.reach(edges, part_roots(nodes)))


@query(f"WITH {_EDGES}, i AS (SELECT dst AS n, count(*) AS c FROM edges GROUP BY dst), o AS (SELECT src AS n, count(*) AS c FROM edges GROUP BY src) SELECT p_partkey AS id, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree FROM part LEFT JOIN i ON i.n = p_partkey LEFT JOIN o ON o.n = p_partkey")
def degrees(spark, sf_dir):
    return graph.degrees(part_nodes(spark, sf_dir), part_edges(spark, sf_dir))


@query(f"WITH {_ALL_EDGES}, i AS (SELECT dst AS n, count(*) AS c FROM edges GROUP BY dst), o AS (SELECT src AS n, count(*) AS c FROM edges GROUP BY src) SELECT p_partkey AS id, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree FROM part LEFT JOIN i ON i.n = p_partkey LEFT JOIN o ON o.n = p_partkey")
def degrees_whole(spark, sf_dir):
    return graph.degrees(part_nodes(spark, sf_dir), part_edges(spark, sf_dir, "true"))


@query(f"""{_DEAD}, o AS (SELECT src AS n, count(*) AS c, count(dead.n) AS x FROM edges LEFT JOIN dead ON dead.n = dst GROUP BY src),
i AS (SELECT dst AS n, count(*) AS c, count(dead.n) AS x FROM edges LEFT JOIN dead ON dead.n = src GROUP BY dst)
SELECT p_partkey AS id, coalesce(o.c, 0) AS deps, coalesce(o.x, 0) AS dead_deps, coalesce(i.c, 0) AS dependents, coalesce(i.x, 0) AS dead_dependents
FROM part LEFT JOIN o ON o.n = p_partkey LEFT JOIN i ON i.n = p_partkey""")
def neighbor_liveness(spark, sf_dir):
    nodes, edges = part_nodes(spark, sf_dir), part_edges(spark, sf_dir)
    return graph.neighbour_liveness(nodes, edges, graph.dead_nodes(nodes, graph.reach(edges, part_roots(nodes))))


@query(f"WITH {_EDGES} SELECT dst AS id, count(*) AS callers, min(src) AS first_caller FROM edges GROUP BY dst")
def reverse_adjacency(spark, sf_dir):
    return graph.callers(part_edges(spark, sf_dir))


@query(f"WITH {_ALL_EDGES} SELECT dst AS id, count(*) AS callers, min(src) AS first_caller FROM edges GROUP BY dst")
def reverse_adjacency_whole(spark, sf_dir):
    return graph.callers(part_edges(spark, sf_dir, "true"))


@query("SELECT user_id AS id, count(*) AS \"references\" FROM events GROUP BY user_id")
def inbound_counts(spark, sf_dir):
    return graph.reference_counts(table(spark, sf_dir, "events"), "user_id")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS number FROM part")
def numeric_ids(spark, sf_dir):
    return graph.numeric_ids(part_nodes(spark, sf_dir), "p_partkey").select("p_partkey", "number")


_NUMBERED = "ids AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS number FROM part)"


@query(f"WITH {_EDGES}, {_NUMBERED} SELECT a.number AS src, b.number AS dst FROM edges JOIN ids a ON a.p_partkey = src JOIN ids b ON b.p_partkey = dst")
def edges_numeric(spark, sf_dir):
    numbered = graph.numeric_ids(part_nodes(spark, sf_dir))
    return graph.numeric_edges(part_edges(spark, sf_dir), numbered)


@query(f"WITH {_ALL_EDGES}, {_NUMBERED} SELECT a.number AS src, b.number AS dst FROM edges JOIN ids a ON a.p_partkey = src JOIN ids b ON b.p_partkey = dst")
def edges_numeric_whole(spark, sf_dir):
    return graph.numeric_edges(part_edges(spark, sf_dir, "true"), graph.numeric_ids(part_nodes(spark, sf_dir)))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unused_declared(spark, sf_dir):
    return liveness.dead(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), {"o_orderkey": "l_orderkey"}).select("o_orderkey")


@query("SELECT lang, count(*) AS declared, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS dead, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS live FROM documents GROUP BY lang")
def unused_docs_by_vis(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    return liveness.stats(liveness.with_dead_flag(docs, liveness.dead(docs, labels, ["doc_id"]), ["doc_id"]), ["lang"])


@query("SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N'")
def unused_two_key(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    returned = lines.where("l_returnflag = 'A'").select("l_partkey", "l_suppkey").distinct()
    return liveness.dead(returned, lines.where("l_returnflag = 'N'"), ["l_partkey", "l_suppkey"])


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.05)")
def alive_by_any(spark, sf_dir):
    lines, on = table(spark, sf_dir, "lineitem"), {"o_orderkey": "l_orderkey"}
    evidence = [(lines.where("l_returnflag = 'A'"), on), (lines.where("l_discount >= 0.05"), on)]
    return liveness.dead_by_all(table(spark, sf_dir, "orders"), evidence, F.col("o_orderpriority") == "1-URGENT").select("o_orderkey")


def _flagged_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return liveness.with_dead_flag(orders, liveness.dead(orders, table(spark, sf_dir, "lineitem"), {"o_orderkey": "l_orderkey"}), ["o_orderkey"])


@query("SELECT o_custkey, o_orderpriority, count(*) AS members FROM orders GROUP BY ALL HAVING count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem)) = 0")
def fully_dead_groups(spark, sf_dir):
    return liveness.fully_dead_groups(_flagged_orders(spark, sf_dir), ["o_custkey", "o_orderpriority"])


@query("""WITH f AS (SELECT *, o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AS dead FROM orders)
SELECT o_orderpriority, count(*) AS declared, count(*) FILTER (dead) AS dead, count(*) FILTER (NOT dead) AS live, count(*) FILTER (dead AND o_custkey % 2 = 0) AS dead_even,
       CAST(round(count(*) FILTER (dead) * 100.0 / count(*), 6) AS DOUBLE) AS dead_percentage FROM f GROUP BY o_orderpriority""")
def kind_stats(spark, sf_dir):
    counted = liveness.stats(_flagged_orders(spark, sf_dir), ["o_orderpriority"], dead_even=F.col("dead") & (F.col("o_custkey") % 2 == 0))
    return counted.withColumn("dead_percentage", F.round(liveness.dead_percentage(F.col("declared"), F.col("dead")), 6))


@query("""WITH f AS (SELECT *, event_type = 'error' AND value > 60 AS flag FROM events),
w AS (SELECT *, coalesce(bool_or(flag) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS prior,
             lead(1) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL AS last FROM f)
SELECT event_id, CASE WHEN flag THEN 'NonFinalWildcard' ELSE 'MaskedByWildcard' END AS reason FROM w WHERE (flag AND NOT last) OR (NOT flag AND prior)""")
def masked_after_flag(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("flag", F.expr("event_type = 'error' and value > 60"))
    return liveness.mask_after_flag(events, ["user_id"], ["ts", "event_id"], "flag").select("event_id", "reason")


@query("""WITH f AS (SELECT user_id, event_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> event_type, true) AS starts, ts FROM events)
SELECT event_id, CAST(sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM f""")
def ordered_sessions(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = events.withColumn("starts", F.coalesce(F.lag("event_type").over(w) != F.col("event_type"), F.lit(True)))
    return liveness.sessions(events, ["user_id"], ["ts", "event_id"], F.col("starts")).select("event_id", "session")


@query("""WITH callers AS (SELECT DISTINCT p_brand, p_partkey FROM part WHERE p_size <= 2), calls AS (SELECT DISTINCT p_brand, p_name FROM part WHERE p_size >= 48)
SELECT DISTINCT c.p_partkey AS src, t.p_partkey AS dst FROM callers c JOIN calls USING (p_brand) JOIN part t ON t.p_name = calls.p_name WHERE c.p_partkey <> t.p_partkey""")
def name_call_edges(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_name").alias("name"), F.col("p_partkey").alias("path"), "p_size")
    calls = parts.where("p_size >= 48").select("file", "name")
    return resolve.name_edges(parts, calls, callers=parts.where("p_size <= 2"))


@query("""SELECT DISTINCT 'o' || a.o_orderkey AS src, 'p' || p_partkey AS dst FROM orders a JOIN orders b USING (o_custkey) JOIN lineitem ON l_orderkey = b.o_orderkey JOIN part ON p_partkey = l_partkey""")
def name_call_edges_whole(spark, sf_dir):
    """A file for each customer declares the customer's orders and calls all parts of their lines by key; every part and every call takes part.

    ``name_call_edges`` keeps small callers and large parts' calls only: 64 names over 25 files give too many edges for more.
    """
    orders, lines, parts = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    named = lambda letter, key: F.concat(F.lit(letter), key)
    declared = orders.select(named("c", "o_custkey").alias("file"), named("o", "o_orderkey").alias("name"), named("o", "o_orderkey").alias("path"))
    declared = declared.unionByName(parts.select(named("p", "p_partkey").alias("file"), named("p", "p_partkey").alias("name"), named("p", "p_partkey").alias("path")))
    calls = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(named("c", "o_custkey").alias("file"), named("p", "l_partkey").alias("name"))
    return resolve.name_edges(declared, calls)


_HOSTS = "hosts AS (SELECT DISTINCT split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages)"
_SUFFIX = "idx AS (SELECT DISTINCT host, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') AS suffix FROM hosts, unnest(range(1, len(string_split(host, '.')) + 1)) AS t(i))"


def _hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/]*)", 1).alias("host")).distinct()


@query(f"WITH {_HOSTS}, {_SUFFIX} SELECT suffix, count(*) AS hosts FROM idx GROUP BY suffix")
def suffix_index(spark, sf_dir):
    return resolve.suffix_index(_hosts(spark, sf_dir), "host", r"\.").groupBy("suffix").agg(F.count(F.lit(1)).alias("hosts"))


@query(f"""WITH {_HOSTS}, {_SUFFIX}, keys AS (SELECT unnest(['example.com', 'example.org', 'ample.net', 'nope.zz']) AS k),
ex AS (SELECT k AS key, host AS path FROM keys JOIN idx ON suffix = k)
SELECT key, path, 'exact' AS how FROM ex UNION ALL
SELECT k, host, 'fallback' FROM keys, hosts WHERE k NOT IN (SELECT key FROM ex) AND (ends_with(host, k) OR ends_with(k, host))""")
def suffix_resolve(spark, sf_dir):
    keys = spark.createDataFrame([("example.com",), ("example.org",), ("ample.net",), ("nope.zz",)], "k string")
    return resolve.suffix_matches(keys, "k", _hosts(spark, sf_dir), "host", r"\.")


@query("""WITH i AS (SELECT * FROM (VALUES ('red', 'paint::colours::red'), ('blue', 'paint::colours::blue'), ('large', 'size::big')) AS t(local, means)),
c AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS f, replace(p_name, ' ', '::') AS call, p_type FROM part)
SELECT p_partkey, CASE WHEN means IS NOT NULL THEN means || substr(call, length(f) + 1) WHEN strpos(call, '::') = 0 THEN call ELSE lower(p_type) || '::' || call END AS resolved, means IS NOT NULL AS via_import
FROM c LEFT JOIN i ON local = f""")
def import_resolve(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.lit("f").alias("file"), F.replace("p_name", F.lit(" "), F.lit("::")).alias("call"), F.array(F.lower("p_type")).alias("context"))
    known = [("f", "red", ["paint", "colours", "red"]), ("f", "blue", ["paint", "colours", "blue"]), ("f", "large", ["size", "big"])]
    imports = spark.createDataFrame(known, "file string, local_name string, segments array<string>")
    return resolve.resolve_calls(parts, imports).select("p_partkey", "resolved", "via_import")


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', ''), '\.html$', '') AS path FROM pages)
SELECT page_id, regexp_extract(path, '([^/]*)$', 1) AS stem, CAST(len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS INT) AS depth,
       array_to_string(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), '::') AS parent FROM p""")
def path_segments(spark, sf_dir):
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://", ""), r"\.html$", "")
    pages = table(spark, sf_dir, "pages").select("page_id", clean.alias("path"))
    return pages.select("page_id", F.regexp_extract("path", "([^/]*)$", 1).alias("stem"), paths.depth(F.col("path")).alias("depth"), F.array_join(paths.parent(F.split("path", "/")), "::").alias("parent"))


@query("SELECT p_name, max(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def stem_collision_dedup(spark, sf_dir):
    return liveness.last_writer(table(spark, sf_dir, "part").select("p_name", "p_partkey"), ["p_name"], ["p_partkey"])


@query(f"""WITH RECURSIVE keep AS (SELECT * FROM part WHERE NOT contains(p_name, 'red')), {_EDGES},
reach(n) AS (SELECT p_partkey FROM keep WHERE p_partkey < 3 UNION SELECT dst FROM edges JOIN reach ON src = n JOIN keep ON dst = p_partkey)
SELECT p_partkey FROM keep WHERE p_partkey NOT IN (SELECT n FROM reach)""")
def ignore_filter(spark, sf_dir):
    nodes = part_nodes(spark, sf_dir).where(~paths.contains_any(F.col("p_name"), ["red"]))
    edges = graph.build_edges(part_edges(spark, sf_dir), nodes, "src", "dst", "id")
    return graph.dead_nodes(nodes, graph.reach(edges, part_roots(nodes))).select("p_partkey")


@query(f"{_DEAD} SELECT p_partkey FROM dead JOIN part ON n = p_partkey WHERE NOT contains(p_name, 'red')")
def post_ignore(spark, sf_dir):
    nodes = part_nodes(spark, sf_dir)
    dead = graph.dead_nodes(nodes, graph.reach(part_edges(spark, sf_dir), part_roots(nodes)))
    return dead.where(~paths.matches_any(F.col("p_name"), ["red"])).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE NOT (starts_with(p_name, 'red') OR ends_with(p_name, 'bolt') OR contains(p_name, 'steel'))")
def ignore_patterns(spark, sf_dir):
    return table(spark, sf_dir, "part").where(~paths.matches_any(F.col("p_name"), ["red*", "*bolt", "steel"])).select("p_partkey")


@query("SELECT sha256(text) AS hash, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(snapshot.content_hash(F.col("text")).alias("hash"))
    return docs.groupBy("hash").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query("""WITH old AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 2 = 0),
cur AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0)
SELECT coalesce(cur.doc_id, old.doc_id) AS doc_id, CASE WHEN old.h IS NULL THEN 'new' WHEN cur.h IS NULL THEN 'removed' WHEN cur.h = old.h THEN 'hit' ELSE 'changed' END AS state
FROM cur FULL JOIN old ON cur.doc_id = old.doc_id""")
def snapshot_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    edited = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    old = docs.where("doc_id % 2 = 0").select("doc_id", snapshot.content_hash(edited).alias("hash"))
    new = docs.where("doc_id % 7 <> 0").select("doc_id", snapshot.content_hash(F.col("text")).alias("hash"))
    return snapshot.diff(new, old, "doc_id")


@query("""WITH old AS (SELECT doc_id, sha256(CASE WHEN lang = 'fr' THEN text || '!' ELSE text END) AS h FROM documents WHERE source <> 'src0'),
cur AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE source <> 'src1')
SELECT coalesce(cur.doc_id, old.doc_id) AS doc_id, CASE WHEN old.h IS NULL THEN 'new' WHEN cur.h IS NULL THEN 'removed' WHEN cur.h = old.h THEN 'hit' ELSE 'changed' END AS state
FROM cur FULL JOIN old ON cur.doc_id = old.doc_id""")
def snapshot_diff_whole(spark, sf_dir):
    """All documents: one source is new, one is removed, one language was edited; the others are hits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    edited = F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    old = docs.where("source <> 'src0'").select("doc_id", snapshot.content_hash(edited).alias("hash"))
    new = docs.where("source <> 'src1'").select("doc_id", snapshot.content_hash(F.col("text")).alias("hash"))
    return snapshot.diff(new, old, "doc_id")


@query(f"""WITH RECURSIVE {_EDGES}, typed AS (SELECT a.p_type || '::' || src AS src, b.p_type || '::' || dst AS dst FROM edges JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_type = b.p_type),
reach(n) AS (SELECT p_type || '::' || p_partkey FROM part WHERE p_partkey < 60 UNION SELECT dst FROM typed JOIN reach ON src = n)
SELECT p_type, count(*) AS declared, count(*) FILTER (p_type || '::' || p_partkey NOT IN (SELECT n FROM reach)) AS dead, count(*) FILTER (p_type || '::' || p_partkey IN (SELECT n FROM reach)) AS live FROM part GROUP BY p_type""")
def cross_group_prefix(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select("p_type", "p_partkey", F.col("p_partkey").cast("string").alias("id"))
    kinds = nodes.select("id", "p_type")
    refs = part_edges(spark, sf_dir).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    refs = refs.join(kinds.withColumnRenamed("id", "src"), "src")
    nodes, refs = resolve.prefixed(nodes, "p_type", ["id"]), resolve.prefixed(refs, "p_type", ["src", "dst"])
    edges = graph.build_edges(refs, nodes, "src", "dst", "id")
    dead = graph.dead_nodes(nodes, graph.reach(edges, nodes.where("p_partkey < 60").select("id")))
    return liveness.stats(liveness.with_dead_flag(nodes, dead, ["id"]), ["p_type"])


@query("SELECT p_partkey FROM part WHERE p_name = 'red widget' OR p_size % 5 = 1 OR contains(p_type, 'ECON')")
def entry_points(spark, sf_dir):
    """The call graph's entries: main, exactly pub, or a path with ``test``."""
    name = F.when(F.col("p_name") == "red widget", "main").otherwise(F.col("p_name"))
    path = F.concat(F.when(F.col("p_type").contains("ECON"), "my_tests::").otherwise("src::"), "p_brand")
    seen = F.element_at(F.array(*map(F.lit, paths.VISIBILITY)), (F.col("p_size") + 4) % 5 + 1)
    return table(spark, sf_dir, "part").where(paths.is_call_entry(name, path, seen)).select("p_partkey")


@query("""WITH v AS (SELECT p_partkey, ['pub', 'pub(crate)', 'pub(super)', 'pub(restricted)', 'private', 'odd'][p_partkey % 6 + 1] AS s FROM part),
n AS (SELECT p_partkey, CASE s WHEN 'pub' THEN 'Public' WHEN 'pub(crate)' THEN 'PubCrate' WHEN 'pub(super)' THEN 'PubSuper' WHEN 'pub(restricted)' THEN 'PubIn' ELSE 'Private' END AS visibility FROM v)
SELECT p_partkey, visibility, visibility IN ('Public', 'PubIn') AS external, visibility IN ('PubCrate', 'PubSuper') AS internal FROM n""")
def visibility_case(spark, sf_dir):
    spelled = F.element_at(F.array(*map(F.lit, [*paths.VISIBILITY, "odd"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    named = table(spark, sf_dir, "part").select("p_partkey", paths.visibility_name(spelled).alias("visibility"))
    return named.withColumns({"external": paths.may_be_external(F.col("visibility")), "internal": paths.is_crate_internal(F.col("visibility"))})


@query("SELECT DISTINCT c_nationkey AS key FROM customer UNION SELECT s_nationkey FROM supplier")
def usage_union(spark, sf_dir):
    return liveness.union_keys((table(spark, sf_dir, "customer"), "c_nationkey"), (table(spark, sf_dir, "supplier"), "s_nationkey"))


@query("SELECT DISTINCT p_partkey AS id FROM part JOIN (SELECT l_suppkey AS k FROM lineitem) ON k = p_partkey")
def valid_roots(spark, sf_dir):
    return graph.valid_roots(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id")), part_nodes(spark, sf_dir))


@query("SELECT DISTINCT lower(p_type) AS module FROM part")
def palette_modules(spark, sf_dir):
    at = F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/p"), "p_partkey", F.lit(".rs"))
    return export.clusters_of(table(spark, sf_dir, "part").select(at.alias("path")))


# ---------------------------------------------------------------- sinks and streaming


@query(f"""WITH {_EDGES} SELECT '"' || src || '" -> "' || dst || '";' AS line FROM edges""")
def dot_lines(spark, sf_dir):
    return export.edge_lines(part_edges(spark, sf_dir))


@query(f"""WITH {_ALL_EDGES} SELECT '"' || src || '" -> "' || dst || '";' AS line FROM edges""")
def dot_lines_whole(spark, sf_dir):
    return export.edge_lines(part_edges(spark, sf_dir, "true"))


@query("SELECT '\"' || p_partkey || '\" [label=\"' || p_partkey || '\", style=filled, fillcolor=' || CASE WHEN p_size > 25 THEN 'lightcoral' ELSE 'lightgreen' END || '];' AS line FROM part")
def dot_nodes(spark, sf_dir):
    return export.node_lines(part_nodes(spark, sf_dir).withColumn("dead", F.col("p_size") > 25))


@query(f"{_DEAD}, {_NUMBERED} SELECT number, p_name AS name, p_partkey IN (SELECT n FROM dead) AS dead FROM part JOIN ids USING (p_partkey)")
def viz_nodes(spark, sf_dir):
    nodes = part_nodes(spark, sf_dir)
    return export.viz_nodes(nodes, graph.dead_nodes(nodes, graph.reach(part_edges(spark, sf_dir), part_roots(nodes))), "p_name")


@query("SELECT CASE WHEN length(p_name) > 12 THEN substr(p_name, 1, 9) || '...' ELSE p_name END AS label, count(*) AS parts FROM part GROUP BY 1")
def short_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(paths.short_label(F.col("p_name"), 12).alias("label")).agg(F.count(F.lit(1)).alias("parts"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def stream_reanalyze(spark, sf_dir):
    """The latest event of each user, kept up by ``foreachBatch`` over a stream of the events."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return reanalyze.replay(spark, events, lambda df: liveness.last_writer(df, ["user_id"], ["event_id"])).select("user_id", "event_type", "event_id")


# ---------------------------------------------------------------- the Rust front end, over sources made of the tables


@query(f"{_DEAD} SELECT 'p' || n AS name FROM dead")
def rust_dead_modules(spark, sf_dir):
    """A module for each part that uses the parts after it; the crate declares the first three."""
    uses = part_edges(spark, sf_dir).groupBy("src").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("use p"), "dst", F.lit("::f;")))), "\n").alias("content"))
    parts = part_nodes(spark, sf_dir).select("id").join(uses, F.col("id") == F.col("src"), "left")
    files = parts.select(F.concat(F.lit("src/p"), "id", F.lit(".rs")).alias("path"), F.coalesce("content", F.lit("pub fn f() {}")).alias("content"))
    files = files.unionByName(spark.createDataFrame([("src/main.rs", "mod p0; mod p1; mod p2; fn main() {}")], files.schema))
    files = files.withColumn("stem", paths.stem(F.col("path")))
    roots = files.select(paths.root_name(F.col("path")).alias("id")).where("id is not null")
    return detectors.dead_modules(files, parsed(files), roots).dead.select("name")


@query("SELECT 'K' || o_orderkey AS name FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def rust_dead_constants(spark, sf_dir):
    """A constant for each order, used by each of its lines."""
    declared = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 100).alias("k")).agg(F.array_join(F.collect_list(F.concat(F.lit("const K"), "o_orderkey", F.lit(": u8 = 1;"))), "\n").alias("content"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_orderkey") % 100).alias("k")).distinct()
    used = lines.groupBy("k").agg(F.concat(F.lit("fn f() {"), F.array_join(F.collect_list(F.concat(F.lit("g(K"), "l_orderkey", F.lit(");"))), "\n"), F.lit("}")).alias("content"))
    files = declared.select(F.concat(F.lit("src/d"), "k", F.lit(".rs")).alias("path"), "content").unionByName(used.select(F.concat(F.lit("src/u"), "k", F.lit(".rs")).alias("path"), "content"))
    return detectors.dead_constants(parsed(files)).dead.select("name")


@query("""WITH f AS (SELECT user_id, event_id, event_type = 'error' AND value > 60 AS flag, row_number() OVER w - 1 AS position, count(*) OVER (PARTITION BY user_id) AS n,
  coalesce(bool_or(event_type = 'error' AND value > 60) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS prior
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT 'src/u' || user_id || '.rs' AS file, CAST(position AS INT) AS position, CASE WHEN flag THEN 'NonFinalWildcard' ELSE 'MaskedByWildcard' END AS reason FROM f WHERE (flag AND position < n - 1) OR (NOT flag AND prior)""")
def rust_match_arms(spark, sf_dir):
    """A match for each user whose arms are the user's events, the flagged ones wildcards."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.expr("event_type = 'error' and value > 60").alias("flag"))
    arm = F.when(F.col("flag"), "_ => 0,").otherwise(F.concat(F.lit("E"), "event_id", F.lit(" => 1,")))
    arms = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", arm.alias("arm")))).alias("arms"))
    content = F.concat(F.lit("fn f() { match x {\n"), F.array_join(F.transform("arms", lambda a: a["arm"]), "\n"), F.lit("\n} }"))
    files = arms.select(F.concat(F.lit("src/u"), "user_id", F.lit(".rs")).alias("path"), content.alias("content"))
    return detectors.dead_match_arms(parsed(files)).dead.select("file", "position", "reason")


@query("""SELECT 'f' || p_partkey AS full_path FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 1)""")
def rust_dead_functions(spark, sf_dir):
    """A private function for each part, and a public one, in a file of its own, that calls those of single pieces.

    Only lines of single pieces are calls: every part is on some line, so with all lines as calls no function were dead.
    """
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("src/f"), "p_partkey", F.lit(".rs")).alias("path"), F.concat(F.lit("fn f"), "p_partkey", F.lit("() {}")).alias("content"))
    called = table(spark, sf_dir, "lineitem").where("l_quantity = 1").select("l_partkey").distinct()
    calls = called.select(F.concat(F.lit("src/c"), "l_partkey", F.lit(".rs")).alias("path"), F.concat(F.lit("pub fn c"), "l_partkey", F.lit("() { f"), "l_partkey", F.lit("() }")).alias("content"))
    return detectors.dead_functions(parsed(parts.unionByName(calls))).dead.select("full_path")
