"""``python -m lodeline PATH``: what is dead in a Rust crate or workspace.

Exit codes: 0 nothing is dead, 1 something is, 2 the arguments are wrong.
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodeline.errors import InvalidPathError
from lodeline.operators import graph
from lodeline.plans import detectors
from lodeline.plans.engine import KINDS, Engine, analyze_crates
from lodeline.sinks import export, report
from lodeline.sinks.report import json_log
from lodeline.sources import rust_tree
from lodeline.sources.rust_tree import checked_output_path


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodeline", description=__doc__)
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--json", action="store_true")
    p.add_argument("--ignore", nargs="*", default=[], help="leave files out before the graph is built")
    p.add_argument("--ignore-after", nargs="*", default=[], help="leave names out of the result")
    p.add_argument("--exclude-dirs", nargs="*", default=[])
    p.add_argument("--workspace", action="store_true")
    p.add_argument("--discover", action="store_true")
    p.add_argument("--cache", help="folder of snapshots")
    p.add_argument("--fix", action="store_true")
    p.add_argument("--fix-dry-run", action="store_true")
    p.add_argument("--all", action="store_true")
    for kind in KINDS:
        p.add_argument(f"--{kind}", action="store_true")
    for kind in ("dot", "html", "modgraph", "callgraph", "callgraph-dot", "combined"):
        p.add_argument(f"--{kind}", metavar="FILE")
    p.add_argument("--callgraph-stats", action="store_true")
    p.add_argument("--reports", action="store_true", help="each detector's counts and dead items under its own heading")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments().parse_args(argv)
    outputs = [getattr(a, k) for k in ("dot", "html", "modgraph", "callgraph", "callgraph_dot", "combined")]
    try:
        for o in filter(None, outputs):
            checked_output_path(o)
    except InvalidPathError as error:
        json_log().error(str(error))
        return 2
    spark = spark or SparkSession.builder.getOrCreate()
    root = a.path if rust_tree.is_workspace(a.path) else rust_tree.find_crate_root(a.path)
    config = rust_tree.load_config(os.path.join(root, "lodeline.toml"))
    ignore = [*a.ignore, *(config.ignore if config else [])]
    if rust_tree.is_workspace(a.path):
        json_log().info("members", extra={"fields": {"crates": rust_tree.find_crates(a.path)}})
    if a.workspace:
        crates = analyze_crates(spark, rust_tree.find_crates(a.path), ignore_before=ignore)
        print(report.crates_json(crates))
        return int(not crates.isEmpty())
    engine = Engine(spark, root, excludes=tuple(a.exclude_dirs), ignore_before=ignore, ignore_after=a.ignore_after, snapshots=a.cache)
    engine.include(*(KINDS if a.all else [k for k in KINDS if getattr(a, k)]))
    if a.discover:
        clusters = rust_tree.discover(engine.files)
        print("\n".join(r["j"] for r in clusters.select(F.to_json(F.struct("*")).alias("j")).collect()) if a.json else report.tree_text(clusters))
        return 0
    _exports(a, engine)
    if a.callgraph_stats:
        print(json.dumps(engine.call_graph.stats.first().asDict()))
    items = engine.analyze().collect()
    if a.reports:
        print("\n".join(engine.report(kind, a.json) for kind in engine.found()))
    elif a.json:
        print(json.dumps({"dead": sorted(r["name"].rpartition("::")[2] for r in items if r["kind"] == "module"), "items": [r.asDict() for r in items]}, indent=2))
    else:
        print(report.dead_names_text(r["name"].rpartition("::")[2] for r in items if r["kind"] == "module"))
        for r in items:
            if r["kind"] != "module":
                print(f"{r['kind']}  {r['file']}  {r['name']}")
    if a.fix or a.fix_dry_run:
        done = engine.fix(dry_run=not a.fix or a.fix_dry_run)
        for error in done.errors:
            json_log().error(error)
        print(json.dumps(done.__dict__, indent=2))
    return int(bool(items))


def _exports(a: argparse.Namespace, engine: Engine) -> None:
    if a.dot or a.html or a.modgraph or a.combined:
        nodes, edges = detectors.module_graph(engine.files, engine.facts.withColumn("file", F.substring_index("file", "//", -1)))
        roots = rust_tree.root_modules(engine.files).select("id")
        dead = graph.dead_nodes(nodes, graph.reach(edges, graph.valid_roots(roots, nodes)))
        flagged = nodes.join(dead.select("id", F.lit(True).alias("d")), "id", "left").withColumn("dead", F.coalesce("d", F.lit(False)))
        modules = export.graph_json(nodes, edges, dead)
        if a.dot:
            export.save(export.dot(flagged, edges), a.dot)
        if a.html:
            export.save(export.html_page(nodes, edges, dead), a.html)
        if a.modgraph:
            export.save(modules, a.modgraph)
    if a.callgraph or a.callgraph_dot or a.combined:
        own = engine.files.select(F.concat("crate", F.lit("//"), "path").alias("path"))
        nodes, edges = detectors.call_graph(engine.facts, detectors.resolved_usages(own, engine.facts))
        dead = engine.call_graph.dead.select(F.col("full_path").alias("id"))
        calls = export.graph_json(nodes.withColumn("path", F.col("file")), edges, dead)
        if a.callgraph:
            export.save(export.named_graph_json(nodes, edges), a.callgraph)
        if a.callgraph_dot:
            flagged = nodes.join(dead.withColumn("d", F.lit(True)), "id", "left").withColumn("dead", F.coalesce("d", F.lit(False)))
            export.save(export.dot(flagged, edges, "calls"), a.callgraph_dot)
        if a.combined:
            export.save(json.dumps({"modules": json.loads(modules), "calls": json.loads(calls)}), a.combined)
