import datetime
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeline import errors
from lodeline.functions import paths
from lodeline.operators import graph, liveness, resolve, snapshot
from lodeline.sinks import export, fix, report
from lodeline.sources import rust_tree
from lodeline.streaming import reanalyze

EDGE = "src bigint, dst bigint"


def bfs(edges, roots):
    level, front, depth = {r: 0 for r in roots}, set(roots), 0
    while front:
        depth += 1
        front = {b for a, b in edges if a in front} - set(level)
        level |= {x: depth for x in front}
    return level


def reached(spark, edges, roots, **how):
    df = graph.reach(spark.createDataFrame(edges, EDGE), spark.createDataFrame([(r,) for r in roots], "id bigint"), **how)
    return {r["id"]: r["level"] for r in df.collect()}


CASES = [
    ([], [1]),
    ([], []),
    ([(1, 1)], [1]),
    ([(1, 2), (2, 1), (2, 3), (3, 1), (4, 5)], [1]),
    ([(i, i + 1) for i in range(100)], [0]),
    ([(0, i) for i in range(1, 101)], [0]),
    ([(0, 1), (0, 2), (1, 3), (2, 3)], [0, 9]),
    ([(0, 1), (0, 1), (None, 2), (1, None), (10, 11)], [0, 10]),
]


@pytest.mark.parametrize(("edges", "roots"), CASES)
def test_reach(spark, edges, roots):
    want = bfs([(a, b) for a, b in edges if None not in (a, b)], roots)
    assert reached(spark, edges, roots, mode="local") == want
    if len(want) < 20:
        assert reached(spark, edges, roots, mode="distributed") == want


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60), st.sets(st.integers(0, 35), max_size=4))
def test_reach_random(spark, edges, roots):
    assert reached(spark, edges, roots, mode="local") == bfs(edges, roots)


def test_reach_by_string_and_limit(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "id string")
    assert {r["id"] for r in graph.reach(edges, roots, max_level=1).collect()} == {"a", "b"}
    assert {r["id"] for r in graph.reach(edges, roots, mode="distributed", max_level=1).collect()} == {"a", "b"}
    with pytest.raises(ValueError, match="mode"):
        graph.reach(edges, roots, mode="odd")


def test_depth_is_by_source(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (9, 3)], EDGE)
    roots = spark.createDataFrame([(0,), (9,), (50,)], "id bigint")
    want = {0: 3, 9: 1, 50: 0}
    assert {r["source"]: r["depth"] for r in graph.depth_by_source(edges, roots).collect()} == want
    wide = graph.levels_by_source(edges, roots, mode="distributed").groupBy("source").agg(F.max("level").alias("d"))
    assert {r["source"]: r["d"] for r in wide.collect()} == want


def test_numeric_ids_by_range(spark, monkeypatch):
    monkeypatch.setattr(graph, "LOCAL_IDS", 10)
    nodes = spark.range(0, 1000).select((F.col("id") * 7 % 1009).alias("id"))
    got = sorted((r["id"], r["number"]) for r in graph.numeric_ids(nodes).collect())
    assert [n for _, n in got] == list(range(1000))


def test_build_edges(spark):
    refs = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "std"), ("b", "b")], "s string, r string")
    nodes = spark.createDataFrame([("a",), ("b",)], "n string")
    assert {tuple(r) for r in graph.build_edges(refs, nodes, "s", "r", "n").collect()} == {("a", "b"), ("b", "b")}
    assert graph.build_edges(refs, nodes, "s", "r", "n", self_edges=False).count() == 1


def test_dead_with_nulls_and_repeats(spark):
    declared = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (3, "c")], "k int, n string")
    used = spark.createDataFrame([("a",), ("a",), (None,)], "n string")
    assert sorted(r["k"] for r in liveness.dead(declared, used, ["n"]).collect()) == [2, 3, 3]


def test_mask_after_flag(spark):
    rows = [("m", i, f) for i, f in enumerate([False, True, False, True])] + [("n", 0, True)] + [("o", 0, True), ("o", 1, False)]
    df = spark.createDataFrame(rows, "g string, p int, w boolean")
    got = {(r["g"], r["p"]): r["reason"] for r in liveness.mask_after_flag(df, ["g"], ["p"], "w").collect()}
    assert got == {("m", 1): "NonFinalWildcard", ("m", 2): "MaskedByWildcard", ("o", 0): "NonFinalWildcard", ("o", 1): "MaskedByWildcard"}


def test_last_writer(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y")], "k string, t int, v string")
    assert [tuple(r) for r in liveness.last_writer(df, ["k"], ["t"]).collect()] == [("a", 3, "z")]


def test_suffix_fallback(spark):
    keys = spark.createDataFrame([("b::c",), ("oo::c",), ("x::a::b::c",), ("zz",)], "k string")
    known = spark.createDataFrame([("a::b::c",), ("foo::c",)], "p string")
    want = {("b::c", "a::b::c", "exact"), ("oo::c", "foo::c", "fallback"), ("x::a::b::c", "a::b::c", "fallback")}
    assert {tuple(r) for r in resolve.suffix_matches(keys, "k", known, "p", "::").collect()} == want


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text("ab:", max_size=5), max_size=8), st.lists(st.text("ab:", max_size=5), max_size=8), st.booleans())
def test_suffix_matches_are_brute_force(spark, asked, known, both):
    """At every size the same joins; the empty string ends every string."""
    got = resolve.suffix_matches(spark.createDataFrame([(k,) for k in asked], "k string"), "k", spark.createDataFrame([(p,) for p in known], "p string"), "p", "::", both)
    want = set()
    for k in set(asked):
        exact = {p for p in known if k in ["::".join(p.split("::")[i:]) for i in range(len(p.split("::")))]}
        want |= {(k, p, "exact") for p in exact} or {(k, p, "fallback") for p in known if p.endswith(k) or both and k.endswith(p)}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


@pytest.mark.parametrize(
    ("call", "want", "imported"),
    [("crate::a::f", "a::f", False), ("self::f", "m::n::f", False), ("super::f", "m::f", False), ("super::super::f", "f", False), ("std::mem::swap", "std::mem::swap", False), ("V::new", "lib::Vec2::new", True), ("f", "f", False), ("x::f", "m::n::x::f", False), ("crate", "crate", False)],
)
def test_resolve_calls(spark, call, want, imported):
    calls = spark.createDataFrame([("a", call, ["m", "n"])], "file string, call string, context array<string>")
    imports = spark.createDataFrame([("a", "V", ["lib", "Vec2"]), ("b", "f", ["no"])], "file string, local_name string, segments array<string>")
    row = resolve.resolve_calls(calls, imports).first()
    assert (row["resolved"], row["via_import"]) == (want, imported)


@pytest.mark.parametrize(
    ("path", "stem", "module", "root", "folder", "top"),
    [
        ("c/src/main.rs", "main", "crate", "main", "root", "root"),
        ("c\\src\\a\\mod.rs", "mod", "a", None, "a", "a"),
        ("src/a/b/c.rs", "c", "a::b::c", None, "a::b", "a"),
        ("src/bin/x.rs", "x", "bin::x", "x", "bin", "bin"),
        ("src/bin/y/main.rs", "main", "bin::y", "y", "bin::y", "bin"),
        (".hidden", ".hidden", ".hidden", None, "root", "root"),
    ],
)
def test_paths(spark, path, stem, module, root, folder, top):
    p = F.lit(path)
    row = spark.range(1).select(paths.stem(p), paths.joined(paths.module_segments(p)), paths.root_name(p), paths.folder_cluster(p), paths.top_cluster(p)).first()
    assert tuple(row) == (stem, module, root, folder, top)


def test_labels(spark):
    row = spark.range(1).select(paths.dot_id(F.lit("a::B<T>")), paths.short_label(F.lit("x" * 21)), paths.short_label(F.lit("x" * 20)), paths.build_path(F.lit("a"), F.lit(None), F.lit(""), F.lit("b")), paths.cluster(F.lit("z/src/q.rs"))).first()
    assert tuple(row) == ("a_B_T_", "x" * 17 + "...", "x" * 20, "a::b", "q")


def test_snapshot(spark, tmp_path):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "path string, hash string")
    old = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3")], "path string, hash string")
    assert {tuple(r) for r in snapshot.diff(new, old, "path").collect()} == {("a", "hit"), ("b", "changed"), ("d", "new"), ("c", "removed")}
    hits, misses = snapshot.split(new, old, "path")
    assert hits.count() == 1 and {r["path"] for r in misses.collect()} == {"b", "d"}
    folder = str(tmp_path / "s")
    assert snapshot.read_snapshot(spark, folder) is None
    snapshot.write_snapshot(old, folder)
    snapshot.write_snapshot(new, folder)
    assert {tuple(r) for r in snapshot.read_snapshot(spark, folder).collect()} == {tuple(r) for r in new.collect()}
    assert snapshot.read_snapshot(spark, folder, engine="2.0") is None
    assert snapshot.compatible("1.2", "1.9") and not snapshot.compatible("1.2", "2.0")


def test_tree_helpers(tmp_path):
    (tmp_path / "a" / "src").mkdir(parents=True)
    (tmp_path / "a" / "Cargo.toml").write_text('name = "a"')
    (tmp_path / "Cargo.toml").write_text("[workspace]\nmembers = []")
    assert rust_tree.is_workspace(str(tmp_path)) and not rust_tree.is_workspace(str(tmp_path / "a"))
    assert rust_tree.find_crates(str(tmp_path)) == [str(tmp_path / "a")]
    assert rust_tree.find_crate_root(str(tmp_path)) == str(tmp_path / "a")
    assert rust_tree.find_crate_root(str(tmp_path / "a" / "src")) == str(tmp_path / "a")
    config = tmp_path / "c.toml"
    assert rust_tree.load_config(str(config)) is None
    config.write_text('ignore = ["x"]\n[output]\nformat = "json"')
    assert rust_tree.load_config(str(config)) == rust_tree.Config(["x"], "json")
    config.write_text("ignore = 3")
    with pytest.raises(errors.ConfigError):
        rust_tree.load_config(str(config))
    for bad in ("/x", "../x", "a/../b", "a\0b", "C:\\x"):
        with pytest.raises(errors.InvalidPathError):
            rust_tree.checked_output_path(bad)


def test_remove_empty_dirs(tmp_path):
    (tmp_path / "src" / "a" / "b").mkdir(parents=True)
    (tmp_path / "src" / "c").mkdir()
    (tmp_path / "src" / "c" / "f").write_text("")
    assert len(fix.remove_empty_dirs(str(tmp_path))) == 2
    fix.remove_empty_dirs(str(tmp_path), dry_run=False)
    assert not (tmp_path / "src" / "a").exists() and (tmp_path / "src" / "c").exists()
    link = tmp_path / "l"
    link.symlink_to(tmp_path / "src" / "c" / "f")
    with pytest.raises(OSError, match="symbolic"):
        fix.remove_file(str(link))


def test_errors_and_log(capsys):
    error = errors.ParseError("odd", "a.rs")
    assert error.recoverable and error.path == "a.rs" and not errors.ConfigError("x").recoverable
    import io

    out = io.StringIO()
    report.json_log("lodeline-test", out).warning("hello", extra={"fields": {"n": 1}})
    assert json.loads(out.getvalue())["n"] == 1


def test_page_refuses_too_many(spark, monkeypatch):
    monkeypatch.setattr(export, "PAGE_NODES", 1)
    nodes = spark.createDataFrame([("a", "src/a.rs"), ("b", "src/b.rs")], "id string, path string")
    with pytest.raises(ValueError, match="more than"):
        export.html_page(nodes, spark.createDataFrame([], "src string, dst string"), nodes)


def test_stream_of_changes(spark, tmp_path):
    folder, found = tmp_path / "in", []
    folder.mkdir()

    def event(n, *rows):
        lines = [json.dumps({"path": p, "content": c, "ts": datetime.datetime(2024, 1, 1, 0, n).isoformat(), "deleted": d}) for p, c, d in rows]
        (folder / f"{n}.json").write_text("\n".join(lines))
        query = reanalyze.watch(spark, str(folder), str(tmp_path / "check"), lambda df, _: found.append({r["message"] for r in df.collect()}))
        query.awaitTermination()

    event(1, ("src/main.rs", "mod a;", False), ("src/a.rs", "", False), ("src/b.rs", "", False))
    event(2, ("src/b.rs", "", True), ("src/a.rs", "fn (", False))
    assert found[0] == {"dead module: b"}
    assert found[1] == {next(iter(x for x in found[1]))} and next(iter(found[1])).startswith("parse error")
