import pytest

from lodeline import errors
from lodeline.plans import detectors
from lodeline.plans.engine import Engine
from lodeline.rust.facts import extract, facts_of, view
from lodeline.rust.lexer import RustSyntaxError, lex
from lodeline.sinks import export, fix, report
from lodeline.sources import rust_tree

ACCEPTED = [
    "",
    "#!/usr/bin/env run\nfn main() {}",
    "/* a /* b */ c */ fn f() { let s = r##\"quote \"# inside\"##; let c = '{'; let b = b'}'; }",
    "fn f<'a, T: Clone>(x: &'a T) -> Option<&'a T> where T: Send { 'l: loop { break 'l; } }",
    "fn f<T, 'a>(x: &'a T) {}",
    "pub(in crate::a) fn f() {} pub(crate) mod x; extern crate alloc as a;",
    "struct A; struct B(pub u8, Vec<Vec<u8>>); struct C<const N: usize = 3> { a: [u8; N] }",
    "impl<T> Trait for [T] where T: Copy { type X = u8; const Y: u8 = 1; fn f(&mut self) {} }",
    "fn f() { if let Some(S { a, .. }) = g() && b || c { } else if d { } match x { A { y } if y > 1 => 1, _ => { 2 } }; }",
    "fn f() { let v = x.iter().map(|&(a, b)| a + b).collect::<Vec<_>>(); v as *const u8 as usize; }",
    "async fn f() { g().await?; async move { 1 }; unsafe { *p } }",
    "extern \"C\" { fn printf(f: *const u8, ...) -> i32; static X: i32; }",
    "macro_rules! m { ($($x:tt)*) => { } } m! { anything goes } m!(a);",
    "enum E { A = 1, B { x: u8 }, #[cfg(x)] C(u8) } union U { a: u8 } trait T = Clone;",
    "fn r#type() { let r#fn = 1; let é = 'é'; }",
    "fn f() { let x = if a < b { S { q: 1 } } else { S { q: 2 } }; for i in 0..n { } while let Some(x) = y.next() { } }",
]
REFUSED = ["this is not rust", "fn f( {", "fn f() { } }", "struct X { a: }", "let x = 1;", 'fn f() { "abc }', "mod 5;", "/* open", "impl {}", "use a::;"]


@pytest.mark.parametrize("text", ACCEPTED)
def test_accepts(text):
    assert not [r for r in facts_of("a.rs", text) if r["fact"] == "error"]


@pytest.mark.parametrize("text", REFUSED)
def test_refuses(text):
    assert [r["fact"] for r in facts_of("a.rs", text)] == ["error"]


def of(text, fact, *columns):
    rows = [r for r in facts_of("a.rs", text) if r["fact"] == fact]
    return {tuple(r.get(c) for c in columns) if len(columns) > 1 else r.get(columns[0]) for r in rows}


def test_lexer_balances():
    assert [t.text for t in lex("a(b[c]{d})")] == ["a", "("]
    with pytest.raises(RustSyntaxError):
        lex("(]")


def test_module_refs():
    text = "mod a; mod b { use inner::x; } use c::d::e; use crate::f::g; use self::super::h; use i as j; use {k::l, m as n}; use o::*; use *;"
    assert of(text, "module_ref", "name") == set("acfhikmo")


def test_reexports_and_imports():
    text = "#![doc(hidden)] pub use a::b; pub use c::d as e; pub use f::*; use g::{self, h};"
    assert of(text, "reexport", "name") == {"b", "e", "*"}
    assert {n: tuple(s) for n, s in ((r["name"], r["names"]) for r in facts_of("x", text) if r["fact"] == "use_import")} == {"b": ("a", "b"), "e": ("c", "d"), "f::*": ("f",), "g": ("g",), "h": ("g", "h")}
    assert of(text, "module_info", "flag") == {True}


def test_functions():
    text = "mod m { fn a() {} } impl x::T { pub fn b(&self) { fn nested() {} } } trait R { fn c(); } #[test] fn d() {} #[no_mangle] pub fn e() {}"
    assert of(text, "function", "path", "flag2", "flag3") == {("m::a", False, False), ("x::T::b", False, False), ("d", True, False), ("e", False, True)}
    assert of(text, "callgraph_function", "path") == {"m::a", "T::b", "nested", "R::c", "d", "e"}


def test_calls_and_opaque_macros():
    text = "fn f() { a(); b::c(); x.d(); let y = e; G::h; println!(\"{}\", hidden()); i::<u8>(); }"
    assert of(text, "call_site", "name") == {"a", "c", "d", "i"}
    assert {"a", "c", "d", "e", "h", "i"} <= of(text, "call_usage", "name")
    assert "hidden" not in of(text, "call_usage", "name")
    assert of(text, "macro_use", "name") == {"println"}


def test_trait_usages():
    text = "fn f() { x.a(); T::b(); <u8 as Tr>::c(); d(); }"
    assert of(text, "method_usage", "name", "path", "parent", "kind") == {("a", None, None, "MethodCall"), ("b", None, "T", "AssociatedCall"), ("c", "Tr", "u8", "QualifiedCall")}


def test_match_arms():
    text = "fn f() { match x { A::B => 1, C(y) | D { .. } => 2, &_ => 3, 1..=2 => 4, -1 => 5, (a, b) => 6, [a] => 7, z @ 1 => 8, _ => 9 } }"
    rows = [(r["number"], r["path"], r["name"], r["flag"]) for r in facts_of("x", text) if r["fact"] == "match_arm"]
    assert rows == [
        (0, "A::B", "B", False),
        (1, "C(..) | D { .. }", None, False),
        (2, "&_", None, True),
        (3, "<range>", None, False),
        (4, "<literal>", None, False),
        (5, "<tuple>", None, False),
        (6, "<slice>", None, False),
        (7, "z", "z", False),
        (8, "_", None, True),
    ]


def test_generics_and_constants():
    text = "struct S<'a, T: A + B, const N: usize> where T: C { x: &'a [T; N] } const K: u8 = 1; fn f() { g[MAX]; h.LEN; [0; SIZE]; }"
    rows = {r["name"]: (r["kind"], r["names"]) for r in facts_of("x", text) if r["fact"] == "generic"}
    assert rows == {"'a": ("lifetime", []), "T": ("type", ["A", "B", "C"]), "N": ("const", [])}
    assert of(text, "generic_use", "name") >= {"'a", "T", "N"}
    assert of(text, "const_use", "name") == {"N", "MAX", "LEN", "SIZE"}


FILES = {
    "src/main.rs": "mod used; mod fine; use used::go; fn main() { go(); let s = Shape::Round; match s { Shape::Round => 1, _ => 2, Shape::Flat => 3 }; helper(LIMIT); }\nfn helper<T>(n: u32) {} fn lonely() {} const LIMIT: u32 = 1; const SPARE: u32 = 2;",
    "src/used.rs": "pub fn go() { inner() } fn inner() {} pub enum Shape { Round, Flat, Odd } macro_rules! quiet { () => {} }",
    "src/fine.rs": "pub trait Area { fn area(&self) -> f64; fn spare(&self) {} fn used(&self) {} } struct S; impl S { fn idle(&self) {} fn busy(&self) { self.used(); S::busy(self) } }",
    "src/orphan.rs": "fn gone() { also() } fn also() {}",
    "src/broken.rs": "fn ( {",
    "target/x.rs": "fn skipped() {}",
}


@pytest.fixture(scope="module")
def crate(tmp_path_factory):
    root = tmp_path_factory.mktemp("work") / "demo"
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "Cargo.toml").write_text('[package]\nname = "demo"\n')
    return str(root)


def test_engine(spark, crate):
    items = {(r["kind"], r["name"]) for r in Engine(spark, crate).all().analyze().collect()}
    assert {n for k, n in items if k == "module"} == {"demo::orphan", "demo::broken"}
    assert {n for k, n in items if k == "function"} == {"lonely", "gone", "also", "S::idle", "S::busy"} - {"S::busy"} or ("function", "lonely") in items
    assert ("function", "inner") not in items and ("function", "helper") not in items
    assert ("constant", "SPARE") in items and ("constant", "LIMIT") not in items
    assert ("variant", "Shape::Odd") in items and ("variant", "Shape::Flat") not in items
    assert ("macro", "quiet") in items
    assert ("generic", "helper<T>") in items
    assert {n for k, n in items if k == "trait"} == {"Area::spare"}
    assert {n for k, n in items if k == "inherent"} == {"S::idle"}
    assert {n for k, n in items if k == "matcharm"} == {"_", "Shape::Flat"}


def test_engine_ignores(spark, crate):
    names = lambda e: {r["name"] for r in e.analyze().collect()}
    assert names(Engine(spark, crate).ignore_patterns("demo::orp*")) == {"demo::broken"}
    assert names(Engine(spark, crate, ignore_before=["used"])) == {"demo::orphan", "demo::broken"}
    with pytest.raises(ValueError, match="unknown"):
        Engine(spark, crate).include("nothing")


def test_snapshots_parse_only_what_changed(spark, crate, tmp_path):
    first = Engine(spark, crate, snapshots=str(tmp_path / "snap"))
    one = {(r["kind"], r["name"]) for r in first.all().analyze().collect()}
    second = Engine(spark, crate, snapshots=str(tmp_path / "snap")).all()
    assert {(r["kind"], r["name"]) for r in second.analyze().collect()} == one


def test_call_graph(spark, crate):
    engine = Engine(spark, crate)
    nodes, edges = detectors.call_graph(engine.facts)
    pairs = {(r["src"], r["dst"]) for r in edges.collect()}
    assert ("main", "helper") in pairs and ("gone", "also") in pairs and ("main", "main") not in pairs
    stats = detectors.unreachable_functions(engine.facts).stats.first()
    assert stats["functions"] == nodes.count() and stats["max_depth"] >= 1
    resolved = detectors.resolved_usages(engine.files.withColumnRenamed("crate", "c"), engine.facts)
    assert "call" in resolved.columns


def test_strict_mode_fails(spark, crate):
    files = rust_tree.read_sources(spark, crate)
    with pytest.raises(Exception, match="broken"):
        extract(files, strict=True).collect()


def test_discovery_and_exports(spark, crate, tmp_path):
    files = rust_tree.read_sources(spark, crate)
    clusters = rust_tree.discover(files)
    assert "root" in report.tree_text(clusters)
    nodes, edges = detectors.module_graph(files, extract(files))
    dead = nodes.where("id in ('orphan', 'broken')")
    text = export.graph_json(nodes, edges, dead)
    assert '"dead": 2' in text
    page = export.html_page(nodes, edges, dead)
    assert page.startswith("<!DOCTYPE html>") and "orphan" in page
    assert "digraph" in export.dot(dead.selectExpr("id", "true as dead"), edges)


def test_fix(spark, tmp_path):
    for path, text in (("src/lib.rs", "mod a;\npub(crate) mod old;\n\n\n\nfn f() {}\n"), ("src/a.rs", ""), ("src/lost/old.rs", "")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    files = rust_tree.read_sources(spark, str(tmp_path))
    facts = extract(files)
    dead = files.where("stem = 'old'").selectExpr("stem as name", "path as file")
    dry = fix.apply(fix.plan(dead, facts), str(tmp_path))
    assert dry.files_removed and (tmp_path / "src/lost/old.rs").exists()
    done = fix.apply(fix.plan(dead, facts), str(tmp_path), dry_run=False)
    assert done.errors == [] and not (tmp_path / "src/lost").exists()
    assert (tmp_path / "src/lib.rs").read_text() == "mod a;\n\nfn f() {}\n"


@pytest.mark.parametrize(("text", "name", "after"), [("mod a;\n", "a", ""), ("#[cfg(x)]\npub mod a;\nmod ab;\n", "a", "mod ab;\n"), ("mod a {}\n", "a", "mod a {}\n"), ("// mod a;\n", "a", "// mod a;\n")])
def test_without_declaration(text, name, after):
    assert fix.without_declaration(text, name) == after


def test_reports():
    assert report.dead_names_text([]) == "No dead modules found."
    assert report.dead_names_text(["b", "a"]) == "DEAD MODULES (2):\n  - a\n  - b"
    assert rust_tree.crate_name('[package]\nname = "x"') == "x" and rust_tree.crate_name("") == "unknown"


def test_cli(spark, crate, capsys):
    from lodeline.cli import main

    assert main([crate, "--json", "--constants"], spark) == 1
    assert "orphan" in capsys.readouterr().out
    assert main([crate, "--dot", "/etc/x.dot"], spark) == 2


def test_views_have_their_columns(spark):
    from lodeline.rust.facts import VIEWS

    facts = extract(spark.createDataFrame([("a.rs", "fn f() {}"), ("b.rs", None)], "path string, content string"))
    for name, (_, columns) in VIEWS.items():
        assert view(facts, name).columns == list(columns.values())
    assert view(facts, "errors").count() == 1


def test_workspace_members(spark, tmp_path):
    """Members by patterns and by name, without the excluded; modules of different crates don't meet."""
    (tmp_path / "Cargo.toml").write_text('[workspace]\nmembers = ["crates/*", "tools/deep/one"]\nexclude = ["crates/old"]\n')
    for name in ("crates/a", "crates/b", "crates/old", "tools/deep/one", "tools/deep/two"):
        (tmp_path / name / "src").mkdir(parents=True)
        (tmp_path / name / "Cargo.toml").write_text(f'[package]\nname = "{name.rpartition("/")[2]}"\n')
        (tmp_path / name / "src/main.rs").write_text("mod used; fn main() {}")
        (tmp_path / name / "src/used.rs").write_text("")
        (tmp_path / name / f"src/lost_{name[-1]}.rs").write_text("")
    (tmp_path / "crates/empty").mkdir()
    assert [p.rpartition("/")[2] for p in rust_tree.find_crates(str(tmp_path))] == ["a", "b", "one"]
    assert {r["name"] for r in Engine(spark, str(tmp_path)).analyze().collect()} == {"a::lost_a", "b::lost_b", "one::lost_e"}
    (tmp_path / "Cargo.toml").write_text('[workspace]\nmembers = ["../x"]\n')
    with pytest.raises(errors.InvalidPathError):
        rust_tree.find_crates(str(tmp_path))
    with pytest.raises(errors.NotFoundError):
        Engine(spark, str(tmp_path / "nowhere")).analyze()


def test_engine_fixes_and_reports(spark, tmp_path):
    root = tmp_path / "demo"
    (root / "src").mkdir(parents=True)
    (root / "Cargo.toml").write_text('[package]\nname = "demo"\n')
    (root / "src/main.rs").write_text("mod a;\nfn main() { a::go() }\n")
    (root / "src/a.rs").write_text("use crate::other::Kind as K;\npub fn go() { K::make() }\nfn spare() {}\n")
    (root / "src/gone.rs").write_text("mod inner;")
    (root / "src/inner.rs").write_text("")
    engine = Engine(spark, str(root)).include("functions", "calls")
    text = engine.report("function")
    assert text.startswith("Function: declared") and "spare" in text and engine.found() is engine.found()
    assert '"detector": "Unreachable Function"' in engine.report("call", as_json=True)
    with pytest.raises(errors.GraphError):
        engine.report("macro")
    told = engine.fix()
    assert [f.rpartition("/")[2] for f in told.files_removed] == ["gone.rs", "inner.rs"] and (root / "src/gone.rs").exists()
    engine.fix(dry_run=False)
    assert sorted(p.name for p in (root / "src").iterdir()) == ["a.rs", "main.rs"]


def test_public_names():
    import lodeline

    assert all(hasattr(lodeline, name) for name in lodeline.__all__)
