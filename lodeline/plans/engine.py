"""An engine over one crate or several: sources, facts, detectors, and one table of all that is dead."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.errors import CacheError, GraphError, NotFoundError
from lodeline.functions import paths
from lodeline.operators import snapshot
from lodeline.operators.liveness import dead_percentage
from lodeline.operators.tables import materialise
from lodeline.plans import detectors
from lodeline.plans.detectors import Found
from lodeline.rust.facts import FACTS, extract
from lodeline.sinks import fix
from lodeline.sinks.report import detector_json, detector_text, json_log
from lodeline.sources import rust_tree

#: What the engine can look for; modules are always looked for.
KINDS = ("functions", "traits", "generics", "macros", "constants", "enums", "matcharms", "calls")

# Names of the kinds in reports.
DISPLAY = {
    "module": "Module", "function": "Function", "trait": "Trait Method", "impl": "Impl Method", "inherent": "Inherent Method", "generic": "Generic Parameter",
    "call": "Unreachable Function", "macro": "Macro", "constant": "Constant", "static": "Static", "variant": "Enum Variant", "matcharm": "Match Arm",
}


@dataclass
class Engine:
    """Settings by keyword or by the methods that return the engine itself.

    ``ignore_before`` leaves files out before the module graph is built, so what only they use is dead as well;
    ``ignore_after`` leaves names out of the result. ``snapshots``: a folder where parsed facts are kept, so that
    only changed files are parsed again.
    """

    spark: SparkSession
    root: str
    kinds: set[str] = field(default_factory=set)
    excludes: tuple[str, ...] = ()
    ignore_before: list[str] = field(default_factory=list)
    ignore_after: list[str] = field(default_factory=list)
    snapshots: str | None = None
    strict: bool = False
    tests: bool = True
    _found: dict = field(default_factory=dict, repr=False)

    def include(self, *kinds: str) -> Engine:
        if unknown := set(kinds) - set(KINDS):
            raise ValueError(f"unknown kinds: {sorted(unknown)}")
        self.kinds |= set(kinds)
        return self

    def all(self) -> Engine:
        return self.include(*KINDS)

    def exclude_dirs(self, *names: str) -> Engine:
        self.excludes += names
        return self

    def ignore_patterns(self, *patterns: str) -> Engine:
        self.ignore_after += patterns
        return self

    def include_tests(self, yes: bool = True) -> Engine:
        self.tests = yes
        return self

    def with_cache(self, folder: str | None) -> Engine:
        self.snapshots = folder
        return self

    @cached_property
    def files(self) -> DataFrame:
        """All sources; of a workspace those of its crates, each under its name."""
        if rust_tree.is_workspace(self.root):
            crates = rust_tree.find_crates(self.root)
            parts = [self._crate(c) for c in crates]
            if parts:
                return reduce(DataFrame.unionByName, parts)
        return self._crate(self.root)

    def _crate(self, folder: str) -> DataFrame:
        if "://" not in folder and not Path(folder.removeprefix("file:")).is_dir():
            raise NotFoundError("no such folder", folder)
        manifest = Path(folder, "Cargo.toml")
        name = rust_tree.crate_name(manifest.read_text(errors="replace")) if manifest.is_file() else Path(folder).name
        found = rust_tree.read_sources(self.spark, folder, self.excludes, name)
        return found if self.tests else found.where(~F.col("path").rlike("(^|/)tests?/"))

    @cached_property
    def facts(self) -> DataFrame:
        """The wide fact table, each file parsed once; with crate, so that crates can't meet."""
        keyed = self.files.withColumn("path", F.concat("crate", F.lit("//"), "path"))
        if self.snapshots is None:
            return materialise(extract(keyed, strict=self.strict))
        try:
            old = snapshot.read_snapshot(self.spark, self.snapshots)
        except AnalysisException as error:
            old = None  # the work is done anew
            json_log().warning(str(CacheError(str(error).splitlines()[0], self.snapshots)))
        both = facts_since(keyed, old, self.strict)
        snapshot.write_snapshot(both, self.snapshots)
        return both.drop("hash")

    @cached_property
    def modules(self) -> Found:
        keyed = self.files.select(F.concat("crate", F.lit("//"), "path").alias("path"), F.concat("crate", F.lit("::"), "stem").alias("stem"), "crate")
        facts = self.facts.where("fact = 'module_ref'").withColumn("name", F.concat(F.substring_index("file", "//", 1), F.lit("::"), "name"))
        roots = rust_tree.root_modules(self.files).select(F.concat("crate", F.lit("::"), "id").alias("id"))
        ignore = paths.contains_any(F.substring_index("stem", "::", -1), self.ignore_before) if self.ignore_before else None
        return detectors.dead_modules(keyed, facts, roots, ignore)

    @cached_property
    def call_graph(self) -> Found:
        """Functions that no entry calls, with calls read through each file's imports."""
        own = self.files.select(F.concat("crate", F.lit("//"), "path").alias("path"))
        return detectors.unreachable_functions(self.facts, detectors.resolved_usages(own, self.facts))

    def found(self) -> dict[str, Found]:
        """Each detector's result that the settings ask for, by kind of item; each is planned once."""
        asked = frozenset(self.kinds)
        if asked not in self._found:
            self._found[asked] = self._detect()
        return self._found[asked]

    def report(self, kind: str, as_json: bool = False) -> str:
        """One detector's counts and dead rows, as text or JSON, under its display name."""
        if kind not in (found := self.found()):
            raise GraphError(f"nothing was found for {kind}; include it first")
        title, f = DISPLAY[kind], found[kind]
        return detector_json(title, f.dead, f.stats) if as_json else detector_text(title, f.dead, f.stats, tuple(c for c in f.dead.columns if c != "bounds"))

    def fix(self, dry_run: bool = True) -> fix.FixResult:
        """Removes the files and declarations of dead modules; by default only tells what it would do."""
        dead = self.modules.dead.withColumn("name", F.substring_index("name", "::", -1))
        return fix.apply(fix.plan(dead, self.facts), self.root, dry_run)

    def _detect(self) -> dict[str, Found]:
        out = {"module": self.modules}
        if "calls" in self.kinds:
            out["call"] = self.call_graph
        if "functions" in self.kinds:
            out["function"] = detectors.dead_functions(self.facts)
        if "traits" in self.kinds:
            out |= detectors.dead_traits(self.facts)
        if "generics" in self.kinds:
            out["generic"] = detectors.dead_generics(self.facts)
        if "macros" in self.kinds:
            out["macro"] = detectors.dead_macros(self.facts)
        if "constants" in self.kinds:
            out["constant"] = detectors.dead_constants(self.facts)
        if "enums" in self.kinds:
            out["variant"] = detectors.dead_variants(self.facts)
        if "matcharms" in self.kinds:
            out["matcharm"] = detectors.dead_match_arms(self.facts)
        return out

    def analyze(self) -> DataFrame:
        """(kind, name, file): all dead items, sorted."""
        names = {"module": "name", "function": "full_path", "call": "full_path", "trait": "full_path", "impl": "full_id", "inherent": "full_id", "generic": "concat(parent, '<', name, '>')", "variant": "full_name", "matcharm": "pattern"}
        parts = [f.dead.select(F.lit(kind).alias("kind"), F.expr(names.get(kind, "name")).alias("name"), "file") for kind, f in self.found().items()]
        items = reduce(DataFrame.unionByName, parts)
        return items.where(~paths.matches_any(F.col("name"), self.ignore_after)).orderBy("kind", "file", "name")

    def counts(self) -> DataFrame:
        """(kind, dead) and the share of each kind in all."""
        found = self.analyze().groupBy("kind").agg(F.count(F.lit(1)).alias("dead"))
        total = found.agg(F.sum("dead").alias("total"))  # a row for each kind, eleven at most
        return found.crossJoin(total).select("kind", "dead", dead_percentage(F.col("total"), F.col("dead")).alias("percent"))


def facts_since(files: DataFrame, known: DataFrame | None, strict: bool = False) -> DataFrame:
    """The facts, with each file's hash, of ``files`` (path, content, hash): of those whose path and hash are in ``known``
    (earlier facts with hashes, or None) the known ones, of the others parsed ones."""
    keyed = files.select(F.col("path").alias("file"), "content", "hash")
    if known is None:
        known = files.sparkSession.createDataFrame([], f"hash string, {FACTS}")
    hits, misses = snapshot.split(keyed, known.select("file", "hash").distinct(), "file")
    fresh = extract(misses, path="file", strict=strict).join(keyed.select("file", "hash"), "file")
    return materialise(known.join(hits, ["file", "hash"], "left_semi").select(*fresh.columns).unionByName(fresh))


def analyze_crates(spark: SparkSession, roots: list[str], **settings) -> DataFrame:
    """(crate, dead): dead modules of several crates, each with its sorted list."""
    parts = [Engine(spark, r, **settings).analyze().where("kind = 'module'") for r in roots]
    items = reduce(DataFrame.unionByName, parts)
    return items.groupBy(F.substring_index("name", "::", 1).alias("crate")).agg(F.array_sort(F.collect_list(F.substring_index("name", "::", -1))).alias("dead"))
