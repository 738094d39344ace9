"""The detectors: each a set of declared rows, a set of used keys, and a rule of liveness between them.

Every detector takes the wide fact table of ``lodeline.rust.facts`` and returns (dead rows, one row of counts).
A detector of one's own is ``Detector(declared, used, on)``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions import paths
from lodeline.operators import graph, liveness, resolve
from lodeline.operators.tables import materialise
from lodeline.rust.facts import view


@dataclass
class Found:
    dead: DataFrame
    stats: DataFrame


@dataclass
class Detector:
    """Declared rows that no used row matches on the key columns."""

    declared: DataFrame
    used: DataFrame
    on: dict[str, str] | list[str]

    def run(self) -> Found:
        gone = liveness.dead(self.declared, self.used, self.on)
        keys = list(self.on)
        flagged = liveness.with_dead_flag(self.declared, gone, keys)
        return Found(gone, liveness.stats(flagged))


# ---------------------------------------------------------------- modules


def module_graph(files: DataFrame, facts: DataFrame, ignore: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes (id, path) and edges (src, dst) by file stem; of files with one stem the last by path counts.

    ``ignore`` is a condition on path of files that are left out before the graph is built.
    """
    kept = files if ignore is None else files.where(~ignore)
    nodes = liveness.last_writer(kept.select(F.col("stem").alias("id"), "path"), ["id"], ["path"])
    refs = view(facts, "module_refs").join(nodes.select(F.col("path").alias("file"), F.col("id").alias("src")), "file").select("src", "ref")
    return nodes, graph.build_edges(refs, nodes, "src", "ref", "id")


def dead_modules(files: DataFrame, facts: DataFrame, roots: DataFrame, ignore: Column | None = None) -> Found:
    nodes, edges = module_graph(files, facts, ignore)
    reached = graph.reach(edges, graph.valid_roots(roots, nodes))
    return Found(graph.dead_nodes(nodes, reached).select(F.col("id").alias("name"), F.col("path").alias("file")), graph.graph_stats(nodes, edges, reached))


# ---------------------------------------------------------------- functions and the call graph


def dead_functions(facts: DataFrame) -> Found:
    """Functions that no entry reaches; calls are attributed to files, so each function of a file calls what the file calls."""
    functions = view(facts, "functions")
    nodes = liveness.last_writer(functions.withColumnRenamed("full_path", "id"), ["id"], ["file"])
    edges = resolve.name_edges(functions.select("file", "name", F.col("full_path").alias("path")), view(facts, "call_sites"))
    entry = paths.is_function_entry(F.col("name"), F.col("visibility"), F.col("is_test"), F.col("is_no_mangle"))
    gone = graph.dead_nodes(nodes, graph.reach(edges, nodes.where(entry).select("id")))
    flagged = liveness.with_dead_flag(nodes, gone, ["id"])
    public = F.col("visibility").startswith("pub")
    return Found(gone.withColumnRenamed("id", "full_path"), liveness.stats(flagged, public_dead=F.col("dead") & public, private_dead=F.col("dead") & ~public))


def resolved_usages(files: DataFrame, facts: DataFrame) -> DataFrame:
    """(file, kind 'resolved', call): qualified calls read through the imports and the file's own module."""
    calls = view(facts, "call_usages").where("kind = 'qualified'").select("file", "call")
    context = files.select(F.col("path").alias("file"), paths.module_segments(F.col("path")).alias("context"))
    found = resolve.resolve_calls(calls.join(context, "file"), view(facts, "use_imports"))
    return found.select("file", F.lit("resolved").alias("kind"), F.col("resolved").alias("call")).distinct()


def call_graph(facts: DataFrame, resolved: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes (id, name, file, ...) and edges (src, dst).

    A file with resolved calls uses only those: each by whole path, else by the paths that end in it. Other files
    use names, and qualified calls by suffix, else by either's end.
    """
    functions = view(facts, "callgraph_functions")
    nodes = liveness.last_writer(functions.withColumnRenamed("full_path", "id"), ["id"], ["file"])
    usages = view(facts, "call_usages")
    own = functions.select("file", F.col("full_path").alias("path")).distinct()
    if resolved is not None:
        usages = usages.join(resolved.select("file").distinct(), "file", "left_anti")
    by_name = resolve.name_edges(functions.select("file", "name", F.col("full_path").alias("path")), usages.where("kind = 'simple'").select("file", F.col("call").alias("name")))

    def by_path(calls: DataFrame, both_ways: bool) -> DataFrame:
        found = resolve.suffix_matches(calls, "call", own, "path", "::", both_ways).select(F.col("key").alias("call"), F.col("path").alias("dst"))
        targets = calls.select("file", "call").distinct().join(found, "call").select("file", "dst").distinct()
        return own.join(targets, "file").select(F.col("path").alias("src"), "dst").where("src <> dst")

    edges = by_name.unionByName(by_path(usages.where("kind = 'qualified'"), True))
    if resolved is not None:
        edges = edges.unionByName(by_path(resolved, False))
    return nodes, materialise(edges.distinct())


def unreachable_functions(facts: DataFrame, resolved: DataFrame | None = None) -> Found:
    nodes, edges = call_graph(facts, resolved)
    entries = nodes.where(paths.is_call_entry(F.col("name"), F.col("id"), F.col("visibility"))).select("id")
    gone = graph.dead_nodes(nodes, graph.reach(edges, entries))
    counts = nodes.agg(F.count(F.lit(1)).alias("functions")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))
    counts = counts.crossJoin(entries.agg(F.count(F.lit(1)).alias("entry_points"))).crossJoin(gone.agg(F.count(F.lit(1)).alias("unreachable")))
    # The deepest of the entries' own searches is a row for each entry and function; one search from all entries is not that.
    depth = graph.depth_by_source(edges, entries).agg(F.coalesce(F.max("depth"), F.lit(0).cast("bigint")).alias("max_depth"))
    return Found(gone.withColumnRenamed("id", "full_path"), counts.crossJoin(depth))


# ---------------------------------------------------------------- traits


def _usage_keys(usages: DataFrame) -> DataFrame:
    named = usages.where("trait_name is not null").withColumn("key", F.concat("trait_name", F.lit("::"), "method_name"))
    return liveness.union_keys((named, "key"), (usages.where("trait_name is null"), "method_name"))


def dead_traits(facts: DataFrame) -> dict[str, Found]:
    """``trait``, ``impl`` and ``inherent`` methods that are never called; required ones are alive."""
    usages = view(facts, "method_usages")
    called, keys = usages.select("method_name").distinct(), _usage_keys(usages)
    traits = liveness.last_writer(view(facts, "trait_methods"), ["full_path"], ["file"])
    gone = liveness.dead_by_all(traits.withColumn("key", F.concat("trait_name", F.lit("::"), "method_name")), [(called, ["method_name"]), (keys, ["key"])], F.col("is_required")).drop("key")
    impls = liveness.last_writer(view(facts, "impl_methods"), ["full_id"], ["file"])
    # The required method it implements: same trait, and a path that ends in the method.
    required = traits.where("is_required").select("trait_name", F.col("full_path").alias("required"))
    held = impls.join(required, (impls["trait_name"] == required["trait_name"]) & F.col("required").endswith(F.col("method_name")), "left_anti")
    gone_impls = liveness.dead(held, called, ["method_name"])
    inherent = liveness.last_writer(view(facts, "inherent_methods"), ["full_id"], ["file"])
    gone_inherent = liveness.dead_by_all(inherent, [(called, ["method_name"]), (keys, {"full_id": "key"})])
    out = {}
    for name, declared, dead, key in (("trait", traits, gone, "full_path"), ("impl", impls, gone_impls, "full_id"), ("inherent", inherent, gone_inherent, "full_id")):
        out[name] = Found(dead, liveness.stats(liveness.with_dead_flag(declared, dead, [key])))
    out["trait"].stats = out["trait"].stats.crossJoin(traits.agg(F.count_if(F.col("is_required")).alias("required"), F.count_if(~F.col("is_required")).alias("provided")))
    return out


# ---------------------------------------------------------------- flat detectors


def dead_generics(facts: DataFrame, by_file: bool = False) -> Found:
    """Generic parameters that their parent doesn't use: types and constants among its types, lifetimes among its lifetimes.

    Parents are told apart by name or, ``by_file``, by file and name.
    """
    declared = view(facts, "generics_declared").withColumn("class", F.when(F.col("kind") == "lifetime", "lifetime").otherwise("type"))
    used = view(facts, "generics_used").withColumnRenamed("kind", "class")
    gone = liveness.dead(declared, used, [*(["file"] if by_file else []), "parent", "name", "class"]).drop("class")
    keys = ["file", "parent", "name", "kind"]
    flagged = liveness.with_dead_flag(declared, gone, keys)
    kinds = {f"{k}s": F.col("kind") == k for k in ("type", "lifetime", "const")}
    return Found(gone, liveness.stats(flagged, **kinds, **{f"dead_{k}": F.col("dead") & c for k, c in kinds.items()}))


def dead_macros(facts: DataFrame) -> Found:
    return _flat(view(facts, "macros_declared"), view(facts, "macros_used"), {"exported_dead": F.col("dead") & F.col("exported")})


def dead_constants(facts: DataFrame) -> Found:
    return _flat(view(facts, "consts_declared"), view(facts, "consts_used"), {"statics": F.col("is_static"), "public_dead": F.col("dead") & F.col("visibility").startswith("pub")})


def _flat(declared: DataFrame, used: DataFrame, more: dict[str, Column]) -> Found:
    gone = liveness.dead(declared, used, ["name"])
    return Found(gone, liveness.stats(liveness.with_dead_flag(declared, gone, ["name"]), **more))


def dead_variants(facts: DataFrame) -> Found:
    """Enum variants used neither by name nor by ``Enum::Variant``; with the enums none of whose variants is used."""
    declared, used = view(facts, "variants_declared"), view(facts, "variants_used")
    evidence = [(used.where("kind = 'name'"), {"variant_name": "value"}), (used.where("kind = 'path'"), {"full_name": "value"})]
    gone = liveness.dead_by_all(declared, evidence)
    flagged = liveness.with_dead_flag(declared, gone, ["full_name"])
    enums = liveness.fully_dead_groups(flagged, ["enum_name"]).agg(F.count(F.lit(1)).alias("fully_dead_enums"))
    return Found(gone, liveness.stats(flagged).crossJoin(flagged.agg(F.countDistinct("enum_name").alias("enums"))).crossJoin(enums))


def dead_match_arms(facts: DataFrame) -> Found:
    """Arms after a wildcard, and wildcards that aren't last."""
    arms = view(facts, "match_arms")
    gone = liveness.mask_after_flag(arms, ["file", "match_id"], ["position"], "is_wildcard")
    counts = arms.agg(F.count(F.lit(1)).alias("arms"), F.countDistinct("file", "match_id").alias("matches"), F.count_if(F.col("is_wildcard")).alias("wildcards"))
    by = gone.agg(F.count(F.lit(1)).alias("dead"), F.count_if(F.col("reason") == "MaskedByWildcard").alias("masked"), F.count_if(F.col("reason") == "NonFinalWildcard").alias("non_final"))
    return Found(gone, counts.crossJoin(by))
