"""Queries of the Rust front end and its detectors over sources that are made of the test tables, each with its SQL.

A source is parsed once: its facts are a table that all views of a query read. Files are dealt to all cores before
they are parsed, since parsing costs far more than their bytes tell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions import paths
from lodeline.operators import snapshot
from lodeline.operators.tables import materialise
from lodeline.plans import detectors
from lodeline.plans.engine import facts_since
from lodeline.rust.facts import extract, spread, view
from lodeline.sinks import fix, report
from lodeline.sources import rust_tree

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parsed(files: DataFrame) -> DataFrame:
    return materialise(extract(spread(files)))


def filled(template: str, **columns) -> F.Column:
    """A string column of a template in which ``@name`` stands for a column."""
    out, rest = [], template
    while "@" in rest:
        text, _, rest = rest.partition("@")
        name = next(n for n in sorted(columns, key=len, reverse=True) if rest.startswith(n))
        out += [F.lit(text), columns[name].cast("string")]
        rest = rest[len(name) :]
    return F.concat(*out, F.lit(rest))


# ---------------------------------------------------------------- views: one file for each part

_SHAPES = """#![doc(hidden)] pub mod a@p; mod b@p; use c@p::d::e; use crate::f@p::g as h@p; pub use i@p::j@p as k@p; pub use l@p::*;
pub fn go@p<'x, T: Bound@p, const N: usize>(v: &'x T) -> [u8; N] { call@p(LIMIT@p); q@p::r@p(); v.m@p(); <S@p as Tr@p>::z@p(); mac@p!(hidden()); w@p }
#[test] fn check@p() {} #[no_mangle] pub(crate) extern fn raw@p() {}
impl S@p { pub fn new@p() -> Self { S@p } fn own@p(&self) {} } trait Tr@p { fn need@p(&self); fn give@p(&self) {} } impl Tr@p for S@p { fn need@p(&self) {} }
pub const LIMIT@p: u8 = 1; static mut CELL@p: u8 = 2; enum E@p { One@p, Two@p(u8) } #[macro_export] macro_rules! mac@p { () => {} }
fn pick@p(e: E@p) -> u8 { match e { E@p::One@p => 1, E@p::Two@p(x) if x > CELL@p => 2, _ => 3 } }"""


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each part that has every kind of item; every fifth is broken."""
    key = F.col("p_partkey")
    text = F.when(key % 5 == 4, F.concat(F.lit("fn ( { "), key.cast("string"))).otherwise(filled(_SHAPES, p=key))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("src/s"), key.cast("string"), F.lit(".rs")).alias("path"), text.alias("content"))


def _rows(name: str, shown: dict[str, str], rows: list[tuple]) -> None:
    """A query of the view ``name``: ``shown`` are its expressions by alias, ``rows`` their values for a part, @ being its key."""
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''").replace("@", "' || p || '") + "'"
    columns = ["file", *shown]
    parts = [f"SELECT 'src/s' || p || '.rs' AS file, {', '.join(f'{lit(v)} AS {c}' for c, v in zip(shown, row, strict=True))} FROM g" for row in rows]

    def run(spark, sf_dir):
        return view(parsed(shapes(spark, sf_dir)), name).select("file", *(F.expr(e).alias(a) for a, e in shown.items())).select(*columns)

    QUERIES[f"rust_{name}"] = run
    SQL[f"rust_{name}"] = "WITH g AS (SELECT CAST(p_partkey AS VARCHAR) AS p FROM part WHERE p_partkey % 5 <> 4) " + " UNION ALL ".join(parts)


_rows("module_refs", {"ref": "ref", "ref_kind": "ref_kind", "visibility": "visibility"}, [("a@", "mod", "pub"), ("b@", "mod", "private"), ("c@", "use", "private"), ("f@", "use", "private"), ("i@", "use", "pub"), ("l@", "use", "pub")])
_rows("module_info", {"doc_hidden": "doc_hidden"}, [(True,)])
_rows("reexports", {"name": "name"}, [("k@",), ("*",)])
_rows("use_imports", {"local_name": "local_name", "path": "array_join(segments, '::')"}, [("e", "c@::d::e"), ("h@", "f@::g"), ("k@", "i@::j@"), ("l@::*", "l@")])
_rows("functions", {c: c for c in ("name", "full_path", "visibility", "is_method", "impl_type", "is_test", "is_no_mangle")}, [
    ("go@", "go@", "pub", False, None, False, False), ("check@", "check@", "private", False, None, True, False), ("raw@", "raw@", "pub(crate)", False, None, False, True),
    ("new@", "S@::new@", "pub", True, "S@", False, False), ("own@", "S@::own@", "private", True, "S@", False, False), ("need@", "S@::need@", "private", True, "S@", False, False), ("pick@", "pick@", "private", False, None, False, False),
])
_rows("call_sites", {c: c for c in ("name", "path", "is_method_call")}, [("call@", None, False), ("r@", "q@::r@", False), ("m@", None, True), ("z@", "Tr@::z@", False)])
_rows("call_usages", {"kind": "kind", "call": "call"}, [("simple", "call@"), ("simple", "r@"), ("qualified", "q@::r@"), ("simple", "v"), ("simple", "m@"), ("simple", "z@"), ("qualified", "Tr@::z@"), ("simple", "w@"), ("simple", "e"), ("simple", "x")])
_rows("trait_methods", {c: c for c in ("trait_name", "method_name", "full_path", "visibility", "is_required")}, [("Tr@", "need@", "Tr@::need@", "private", True), ("Tr@", "give@", "Tr@::give@", "private", False)])
_rows("impl_methods", {c: c for c in ("trait_name", "type_name", "method_name", "full_id")}, [("Tr@", "S@", "need@", "impl Tr@ for S@ :: need@")])
_rows("inherent_methods", {c: c for c in ("type_name", "method_name", "full_id", "visibility", "is_static")}, [("S@", "new@", "S@::new@", "pub", True), ("S@", "own@", "S@::own@", "private", False)])
_rows("method_usages", {c: c for c in ("method_name", "trait_name", "type_name", "usage_kind")}, [("r@", None, "q@", "AssociatedCall"), ("m@", None, None, "MethodCall"), ("z@", "Tr@", "S@", "QualifiedCall")])
_rows("generics_declared", {"name": "name", "kind": "kind", "parent": "parent", "parent_kind": "parent_kind", "bounds": "array_join(bounds, ',')"}, [("'x", "lifetime", "go@", "function", ""), ("T", "type", "go@", "function", "Bound@"), ("N", "const", "go@", "function", "")])
_rows("macros_declared", {"name": "name", "exported": "exported", "module_path": "module_path"}, [("mac@", True, "")])
_rows("macros_used", {"name": "name"}, [("mac@",), ("macro_rules",)])  # a definition is an invocation of macro_rules
_rows("consts_declared", {c: c for c in ("name", "is_static", "is_mutable", "visibility", "module_path", "impl_type")}, [("LIMIT@", False, False, "pub", "", None), ("CELL@", True, True, "private", "", None)])
_rows("variants_declared", {c: c for c in ("enum_name", "variant_name", "full_name", "module_path", "visibility")}, [("E@", "One@", "E@::One@", "", "private"), ("E@", "Two@", "E@::Two@", "", "private")])
_rows("match_arms", {c: c for c in ("position", "total_arms", "pattern", "variant_name", "is_wildcard")}, [(0, 3, "E@::One@", "One@", False), (1, 3, "E@::Two@(..)", "Two@", False), (2, 3, "_", None, True)])


@query("SELECT 'src/s' || p_partkey || '.rs' AS file FROM part WHERE p_partkey % 5 = 4")
def rust_errors(spark, sf_dir):
    """Files that can't be parsed: told, never fatal."""
    return view(parsed(shapes(spark, sf_dir)), "errors").select("file")


# ---------------------------------------------------------------- detectors: liveness by lines of the part

_USED = "u AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity = 1), v AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity = 2)"


def _files(spark: SparkSession, sf_dir: str, declared: str, one: str, two: str) -> DataFrame:
    """A file that declares for each part, and one that uses for each part with a line of one piece, or of two."""
    key = F.col("l_partkey")
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("src/d"), "p_partkey", F.lit(".rs")).alias("path"), filled(declared, p=F.col("p_partkey"), v=F.when(F.col("p_size") % 2 == 0, "pub ").otherwise("")).alias("content"))
    uses = [lines.where(f"l_quantity = {n}").select("l_partkey").distinct().select(F.concat(F.lit(f"src/{f}"), key, F.lit(".rs")).alias("path"), filled(text, p=key).alias("content")) for n, f, text in ((1, "u", one), (2, "v", two))]
    return parts.unionByName(uses[0]).unionByName(uses[1])


def _generics(spark, sf_dir):
    """A type parameter is used where the part has a line of one piece, a lifetime where it has one of two."""
    lines = table(spark, sf_dir, "lineitem")
    mark = lambda n, c: lines.where(f"l_quantity = {n}").select(F.col("l_partkey").alias("p_partkey"), F.lit(True).alias(c)).distinct()
    parts = table(spark, sf_dir, "part").select("p_partkey").join(mark(1, "one"), "p_partkey", "left").join(mark(2, "two"), "p_partkey", "left")
    text = filled("struct S@p<'a, T, const N: usize> { x: @t, y: &@l u8, z: [u8; N] }", p=F.col("p_partkey"), t=F.when(F.col("one"), "T").otherwise("u8"), l=F.when(F.col("two"), "'a").otherwise("'static"))
    return detectors.dead_generics(parsed(parts.select(F.concat(F.lit("src/g"), "p_partkey", F.lit(".rs")).alias("path"), text.alias("content"))))


@query(f"WITH {_USED} SELECT 'S' || p_partkey AS parent, 'T' AS name, 'type' AS kind FROM part WHERE p_partkey NOT IN (SELECT k FROM u) UNION ALL SELECT 'S' || p_partkey, '''a', 'lifetime' FROM part WHERE p_partkey NOT IN (SELECT k FROM v)")
def rust_dead_generics(spark, sf_dir):
    return _generics(spark, sf_dir).dead.select("parent", "name", "kind")


@query(f"WITH {_USED}, n AS (SELECT count(*) AS n, count(*) FILTER (p_partkey NOT IN (SELECT k FROM u)) AS t, count(*) FILTER (p_partkey NOT IN (SELECT k FROM v)) AS l FROM part) SELECT 3 * n AS declared, t + l AS dead, 3 * n - t - l AS live, n AS types, n AS lifetimes, n AS consts, t AS dead_types, l AS dead_lifetimes, 0 AS dead_consts FROM n")
def rust_generic_stats(spark, sf_dir):
    return _generics(spark, sf_dir).stats


def _macros(spark, sf_dir):
    return detectors.dead_macros(parsed(_files(spark, sf_dir, "macro_rules! m@p { () => {} }", "fn f() { m@p!(); }", "m@p! { x }")))


@query(f"WITH {_USED} SELECT 'm' || p_partkey AS name FROM part WHERE p_partkey NOT IN (SELECT k FROM u UNION SELECT k FROM v)")
def rust_dead_macros(spark, sf_dir):
    return _macros(spark, sf_dir).dead.select("name")


@query(f"WITH {_USED}, d AS (SELECT p_partkey NOT IN (SELECT k FROM u UNION SELECT k FROM v) AS dead FROM part) SELECT count(*) AS declared, count(*) FILTER (dead) AS dead, count(*) FILTER (NOT dead) AS live, 0 AS exported_dead FROM d")
def rust_macro_stats(spark, sf_dir):
    return _macros(spark, sf_dir).stats


def _variants(spark, sf_dir):
    return detectors.dead_variants(parsed(_files(spark, sf_dir, "@venum E@p { One@p, Two@p(u8), Gone@p }", "fn f() { g(E@p::One@p) }", "use e::Two@p; fn f(x: u8) { match x { Two@p(y) => y } }")))


@query(f"WITH {_USED} SELECT 'E' || p_partkey || '::One' || p_partkey AS full_name FROM part WHERE p_partkey NOT IN (SELECT k FROM u) UNION ALL SELECT 'E' || p_partkey || '::Two' || p_partkey FROM part WHERE p_partkey NOT IN (SELECT k FROM v) UNION ALL SELECT 'E' || p_partkey || '::Gone' || p_partkey FROM part")
def rust_dead_variants(spark, sf_dir):
    return _variants(spark, sf_dir).dead.select("full_name")


@query(f"WITH {_USED}, d AS (SELECT p_partkey NOT IN (SELECT k FROM u) AS a, p_partkey NOT IN (SELECT k FROM v) AS b FROM part), n AS (SELECT count(*) AS n, count(*) FILTER (a) + count(*) FILTER (b) + count(*) AS dead, count(*) FILTER (a AND b) AS whole FROM d) SELECT 3 * n AS declared, dead, 3 * n - dead AS live, n AS enums, whole AS fully_dead_enums FROM n")
def rust_enum_stats(spark, sf_dir):
    return _variants(spark, sf_dir).stats


def _constants(spark, sf_dir):
    return detectors.dead_constants(parsed(_files(spark, sf_dir, "@vconst K@p: u8 = 1; static Z@p: u8 = 2;", "fn f() -> u8 { K@p }", "fn f() { g[Z@p] }")))


@query(f"WITH {_USED}, d AS (SELECT p_size % 2 = 0 AS pub, p_partkey NOT IN (SELECT k FROM u) AS a, p_partkey NOT IN (SELECT k FROM v) AS b FROM part), n AS (SELECT count(*) AS n, count(*) FILTER (a) AS a, count(*) FILTER (b) AS b, count(*) FILTER (a AND pub) AS p FROM d) SELECT 2 * n AS declared, a + b AS dead, 2 * n - a - b AS live, n AS statics, p AS public_dead FROM n")
def rust_constant_stats(spark, sf_dir):
    return _constants(spark, sf_dir).stats


def _traits(spark, sf_dir):
    declared = "@vtrait T@p { fn need@p(&self); fn give@p(&self) {} } struct S@p; impl T@p for S@p { fn need@p(&self) {} fn give@p(&self) {} } impl S@p { fn own@p(&self) {} pub fn make@p() {} }"
    return detectors.dead_traits(parsed(_files(spark, sf_dir, declared, "fn f(x: u8) { x.give@p(); S@p::make@p(); }", "fn f(x: u8) { x.own@p(); }")))


@query(f"WITH {_USED} SELECT 'T' || p_partkey || '::give' || p_partkey AS full_path FROM part WHERE p_partkey NOT IN (SELECT k FROM u)")
def rust_dead_trait_methods(spark, sf_dir):
    """Required methods are alive, the provided one where it is called."""
    return _traits(spark, sf_dir)["trait"].dead.select("full_path")


@query(f"WITH {_USED} SELECT 'impl T' || p_partkey || ' for S' || p_partkey || ' :: give' || p_partkey AS full_id FROM part WHERE p_partkey NOT IN (SELECT k FROM u)")
def rust_dead_impl_methods(spark, sf_dir):
    """Implementations of required methods are alive, the others where a method of their name is called."""
    return _traits(spark, sf_dir)["impl"].dead.select("full_id")


@query(f"WITH {_USED} SELECT 'S' || p_partkey || '::own' || p_partkey AS full_id FROM part WHERE p_partkey NOT IN (SELECT k FROM v) UNION ALL SELECT 'S' || p_partkey || '::make' || p_partkey FROM part WHERE p_partkey NOT IN (SELECT k FROM u)")
def rust_dead_inherent_methods(spark, sf_dir):
    return _traits(spark, sf_dir)["inherent"].dead.select("full_id")


@query(f"WITH {_USED}, n AS (SELECT count(*) AS n, count(*) FILTER (p_partkey NOT IN (SELECT k FROM u)) AS a FROM part) SELECT 2 * n AS declared, a AS dead, 2 * n - a AS live, n AS required, n AS provided FROM n")
def rust_trait_stats(spark, sf_dir):
    return _traits(spark, sf_dir)["trait"].stats


def _functions(spark, sf_dir):
    return detectors.dead_functions(parsed(_files(spark, sf_dir, "@vfn f@p() {} mod m@p { fn t@p() {} }", "pub fn c@p() { f@p() }", "fn d@p() { t@p() }")))


@query(f"WITH {_USED}, p AS (SELECT p_size % 2 = 0 AS pub, p_partkey IN (SELECT k FROM u) AS one FROM part), n AS (SELECT 2 * count(*) + (SELECT count(*) FROM u) + (SELECT count(*) FROM v) AS n, count(*) FILTER (NOT pub AND NOT one) + count(*) + (SELECT count(*) FROM v) AS dead FROM p) SELECT n AS declared, dead, n - dead AS live, 0 AS public_dead, dead AS private_dead FROM n")
def rust_function_stats(spark, sf_dir):
    """``f`` lives if it is public or called by the public caller, ``t`` only if a living function called it: none does."""
    return _functions(spark, sf_dir).stats


@query("""WITH f AS (SELECT user_id, event_id, event_type = 'error' AND value > 60 AS flag, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n,
  coalesce(bool_or(event_type = 'error' AND value > 60) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS prior FROM events)
SELECT count(*) AS arms, count(DISTINCT user_id) AS matches, count(*) FILTER (flag) AS wildcards, count(*) FILTER ((flag AND i < n) OR (NOT flag AND prior)) AS dead, count(*) FILTER (NOT flag AND prior) AS masked, count(*) FILTER (flag AND i < n) AS non_final FROM f""")
def rust_match_stats(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.expr("event_type = 'error' and value > 60").alias("flag"))
    arm = F.when(F.col("flag"), "_ => 0,").otherwise(F.concat(F.lit("E"), "event_id", F.lit(" => 1,")))
    arms = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", arm.alias("arm")))).alias("arms"))
    content = F.concat(F.lit("fn f() { match x {\n"), F.array_join(F.transform("arms", lambda a: a["arm"]), "\n"), F.lit("\n} }"))
    return detectors.dead_match_arms(parsed(arms.select(F.concat(F.lit("src/u"), "user_id", F.lit(".rs")).alias("path"), content.alias("content")))).stats


# ---------------------------------------------------------------- the call graph

_NEXT_PART = "e AS (SELECT DISTINCT l_partkey AS src, nxt AS dst FROM (SELECT l_partkey, l_quantity, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS nxt FROM lineitem) WHERE nxt IS NOT NULL AND nxt <> l_partkey AND l_quantity >= 48)"


def _calls(spark: SparkSession, sf_dir: str, call: str, body: str) -> tuple[DataFrame, DataFrame]:
    """A file for each part, whose function calls those of the parts that follow it; the first three are public."""
    from lodeline.catalog import part_edges

    calls = part_edges(spark, sf_dir).groupBy("src").agg(F.array_join(F.array_sort(F.collect_list(filled(call, d=F.col("dst")))), " ").alias("calls"))
    parts = table(spark, sf_dir, "part").select("p_partkey").join(calls, F.col("p_partkey") == F.col("src"), "left")
    text = filled(body, p=F.col("p_partkey"), v=F.when(F.col("p_partkey") < 3, "pub ").otherwise(""), c=F.coalesce("calls", F.lit("")))
    files = parts.select(F.concat(F.lit("src/m"), "p_partkey", F.lit(".rs")).alias("path"), text.alias("content"))
    return files, parsed(files)


_UNREACHED = f"WITH RECURSIVE {_NEXT_PART}, r(n) AS (SELECT p_partkey FROM part WHERE p_partkey < 3 UNION SELECT dst FROM e JOIN r ON src = n)"


@query(f"{_UNREACHED} SELECT 'f' || p_partkey AS full_path FROM part WHERE p_partkey NOT IN (SELECT n FROM r)")
def rust_unreachable_by_name(spark, sf_dir):
    _, facts = _calls(spark, sf_dir, "f@d();", "@vfn f@p() { @c }")
    return detectors.unreachable_functions(facts).dead.select("full_path")


@query(f"{_UNREACHED} SELECT 'T' || p_partkey || '::go' || p_partkey AS full_path FROM part WHERE p_partkey NOT IN (SELECT n FROM r)")
def rust_unreachable_by_suffix(spark, sf_dir):
    """Calls by type and method, found by the paths that end in them."""
    _, facts = _calls(spark, sf_dir, "T@d::go@d();", "struct T@p; impl T@p { @vfn go@p() { @c } }")
    return detectors.unreachable_functions(facts).dead.select("full_path")


@query(f"{_UNREACHED} SELECT 'T' || p_partkey || '::go' AS full_path FROM part WHERE p_partkey NOT IN (SELECT n FROM r)")
def rust_unreachable_by_import(spark, sf_dir):
    """All methods have one name; only imports under other names tell which type is called."""
    files, facts = _calls(spark, sf_dir, "use crate::T@d as A@d; A@d::go();", "struct T@p; impl T@p { @vfn go() { @c } }")
    return detectors.unreachable_functions(facts, detectors.resolved_usages(files, facts)).dead.select("full_path")


@query(f"{_UNREACHED} SELECT (SELECT count(*) FROM part) AS functions, (SELECT count(*) FROM e) AS edges, 3 AS entry_points, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT n FROM r)) AS unreachable")
def rust_call_graph_stats(spark, sf_dir):
    _, facts = _calls(spark, sf_dir, "f@d();", "@vfn f@p() { @c }")
    return detectors.unreachable_functions(facts).stats.select("functions", "edges", F.col("entry_points").cast("int").alias("entry_points"), "unreachable")


@query(f"WITH {_NEXT_PART} SELECT 'f' || src AS src, 'f' || dst AS dst FROM e")
def rust_call_edges(spark, sf_dir):
    _, facts = _calls(spark, sf_dir, "f@d();", "@vfn f@p() { @c }")
    return detectors.call_graph(facts)[1]


# ---------------------------------------------------------------- sources, increments, fixes, reports


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths by brand and type, with a mod.rs in the folders of a brand's small parts."""
    folder = F.concat(F.lit("src/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.when(F.col("p_size") > 10, F.concat(F.lit("/"), F.lower("p_type"))).otherwise(""))
    name = F.when(F.col("p_size") == 1, "mod").otherwise(F.concat(F.lit("p"), "p_partkey"))
    return table(spark, sf_dir, "part").select(F.concat(folder, F.lit("/"), name, F.lit(".rs")).alias("path")).distinct()


_TREE = "t AS (SELECT DISTINCT lower(replace(p_brand, '#', '_')) || CASE WHEN p_size > 10 THEN '/' || lower(p_type) ELSE '' END AS folder, CASE WHEN p_size = 1 THEN 'mod' ELSE 'p' || p_partkey END AS m FROM part)"


@query(f"WITH {_TREE}, c AS (SELECT folder, bool_or(m = 'mod') AS has_mod_file, count(*) AS modules FROM t GROUP BY folder) SELECT replace(folder, '/', '::') AS cluster, CASE WHEN contains(folder, '/') THEN split_part(folder, '/', 1) ELSE 'root' END AS parent, CASE WHEN contains(folder, '/') THEN 2 ELSE 1 END AS depth, has_mod_file, CAST(modules AS INT) AS modules, CAST((SELECT count(*) FROM c x WHERE x.folder LIKE c.folder || '/%') AS INT) AS children FROM c")
def cluster_tree(spark, sf_dir):
    """The folders of a tree of sources as clusters."""
    found = rust_tree.discover(_tree(spark, sf_dir))
    return found.select("cluster", "parent", "depth", "has_mod_file", F.size("modules").alias("modules"), F.size("children").alias("children"))


@query(f"WITH {_TREE}, c AS (SELECT folder, string_agg(m, ',' ORDER BY m) AS modules FROM t GROUP BY folder) SELECT replace(folder, '/', '::') AS cluster, modules, row_number() OVER (ORDER BY replace(folder, '/', '::')) - 1 AS place FROM c")
def cluster_order(spark, sf_dir):
    """Clusters in pre-order."""
    rows = rust_tree.cluster_tree(rust_tree.discover(_tree(spark, sf_dir))).collect()
    return spark.createDataFrame([(r["cluster"], ",".join(r["modules"]), i) for i, r in enumerate(rows)], "cluster string, modules string, place bigint")


@query(f"WITH {_TREE}, p AS (SELECT 'src/' || folder || '/' || m || '.rs' AS path, folder, m FROM t) SELECT path, m AS stem, replace(folder, '/', '::') || CASE WHEN m = 'mod' THEN '' ELSE '::' || m END AS module, split_part(folder, '/', 1) AS cluster, replace(folder, '/', '::') AS folder_cluster, split_part(folder, '/', 1) AS top_cluster, CASE WHEN contains(folder, '/') THEN 2 ELSE 1 END AS depth, 'crate::' || m AS built FROM p")
def path_names(spark, sf_dir):
    path = F.col("path")
    folder = F.regexp_extract(path, "^src/(.*)/[^/]*$", 1)
    return _tree(spark, sf_dir).select("path", paths.stem(F.translate(path, "/", "\\")).alias("stem"), paths.joined(paths.module_segments(path)).alias("module"), paths.cluster(path).alias("cluster"), paths.folder_cluster(path).alias("folder_cluster"), paths.top_cluster(path).alias("top_cluster"), paths.depth(folder).alias("depth"), paths.build_path(F.lit("crate"), F.lit(""), paths.stem(path)).alias("built"))


@query("SELECT p_partkey, NOT contains(p_name, 'red') AND p_size < 20 AND regexp_matches(p_brand, '^B') AND NOT (p_type = 'ECONOMY') AS kept FROM part")
def source_filters(spark, sf_dir):
    """Folders that are left out, names that are kept by their case."""
    path = F.concat(F.lit("/x/crate/"), F.when(F.col("p_name").contains("red"), "target/").otherwise("src/"), F.when(F.col("p_size") < 20, "a/").otherwise("skip/"), F.when(F.col("p_type") == "ECONOMY", ".git/").otherwise(""), F.lit("f.rs"))
    kept = ~rust_tree.pruned(path, "/x/crate", ("skip",)) & paths.starts_upper(F.col("p_brand")) & ~paths.starts_lower(F.col("p_brand")) & paths.has_upper(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", kept.alias("kept"))


@query("SELECT 'K' || p_partkey AS name, p_partkey % 3 = 0 AS parsed_again FROM part WHERE p_partkey % 7 <> 0")
def rust_incremental_parse(spark, sf_dir):
    """Facts of a second state of the sources: unchanged files keep those of the first, changed and new ones are parsed."""
    def files(text):
        rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("src/k"), "p_partkey", F.lit(".rs")).alias("path"), text.alias("content"))
        return rows.withColumn("hash", snapshot.content_hash(F.col("content")))

    key = F.col("p_partkey")
    first, second = files(filled("const K@p: u8 = 1;", p=key)), files(F.concat(filled("const K@p: u8 = 1;", p=key), F.when(key % 3 == 0, " // edited").otherwise("")))
    old = facts_since(first.where("p_partkey % 3 <> 0 or p_partkey % 2 = 0"), None)
    new = facts_since(second.where("p_partkey % 7 <> 0"), old)
    again = second.select(F.col("path").alias("file"), "hash").join(old.select("file", "hash").distinct(), ["file", "hash"], "left_anti").withColumn("again", F.lit(True))
    return view(new, "consts_declared").join(again, "file", "left").select("name", F.coalesce("again", F.lit(False)).alias("parsed_again"))


@query("SELECT 'remove_file' AS action, 'src/m' || p_partkey || '.rs' AS target, 'm' || p_partkey AS detail FROM part WHERE p_size = 1 UNION ALL SELECT 'remove_declaration', 'src/main.rs', 'm' || p_partkey FROM part WHERE p_size = 1")
def rust_fix_plan(spark, sf_dir):
    """What to remove for some modules that are told dead, by the file that declares them.

    Each crate of a workspace declares 10 000 keys' modules at most: a file that declares all would pass ``facts.MOST_BYTES``
    as the table grows, and one task would read it. Targets are told below their crate.
    """
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    crates = parts.groupBy(F.expr("p_partkey div 10000").alias("crate")).agg(F.array_join(F.collect_list(filled("mod m@p;", p=F.col("p_partkey"))), "\n").alias("content"))
    declared = crates.select(filled("c@n//src/main.rs", n=F.col("crate")).alias("path"), "content")
    dead = parts.where("p_size = 1").select(F.concat(F.lit("m"), "p_partkey").alias("name"), F.concat(F.lit("src/m"), "p_partkey", F.lit(".rs")).alias("file"))
    return fix.plan(dead, parsed(declared)).withColumn("target", F.substring_index("target", "//", -1))


@query(r"SELECT p_partkey, CASE WHEN p_size < 25 THEN 'fn a() {}' || chr(10) ELSE 'mod keep;' || chr(10) || 'fn a() {}' || chr(10) END AS content FROM part")
def fixed_sources(spark, sf_dir):
    """Declarations taken out of texts, whatever their attributes and visibility."""
    text = F.when(F.col("p_size") < 25, "#[cfg(x)] pub(crate) mod gone; // why\nfn a() {}\n").otherwise("mod keep;\npub mod gone ;\nfn a() {}\n")
    return table(spark, sf_dir, "part").select("p_partkey", fix.without_declaration_column(text, "gone").alias("content"))


@query("WITH d AS (SELECT DISTINCT p_type AS n FROM part), l AS (SELECT 0 AS place, 'DEAD MODULES (' || count(*) || '):' AS line FROM d UNION ALL SELECT row_number() OVER (ORDER BY n), '  - ' || n FROM d) SELECT CAST(place AS BIGINT) AS place, line FROM l")
def report_lines(spark, sf_dir):
    """The plain report of names, sorted."""
    text = report.dead_names_text(r["p_type"] for r in table(spark, sf_dir, "part").select("p_type").distinct().collect())
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "place bigint, line string")


@query("SELECT p_brand AS crate, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS dead FROM part GROUP BY p_brand")
def report_json(spark, sf_dir):
    """The report of a workspace as JSON, read back."""
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("crate")).agg(F.array_sort(F.collect_set("p_type")).alias("dead"))
    text = spark.createDataFrame([(report.crates_json(rows),)], "j string")
    read = text.select(F.explode(F.from_json("j", "map<string,struct<dead:array<string>>>")).alias("crate", "found"))
    return read.select("crate", F.array_join("found.dead", ",").alias("dead"))
