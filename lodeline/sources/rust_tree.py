"""Rust source trees as DataFrames, and what is read beside them on the driver: crates, manifests, configuration."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.errors import ConfigError, InvalidPathError
from lodeline.functions import paths
from lodeline.operators.snapshot import content_hash

# Folders that hold no sources of the crate.
PRUNED = ("target", ".git", "node_modules", ".cargo")


def pruned(path: Column, root: str, excludes: tuple[str, ...] = ()) -> Column:
    """Whether a folder of the path below ``root`` is one of those that are left out."""
    below = F.split(F.regexp_replace(path, f"^.*?{re.escape(root.rstrip('/'))}/", ""), "/")
    return F.arrays_overlap(below, F.array(*map(F.lit, (*PRUNED, *excludes))))


def read_sources(spark: SparkSession, root: str, excludes: tuple[str, ...] = (), crate: str | None = None) -> DataFrame:
    """(crate, path, stem, content, length, hash) of all ``*.rs`` files below ``root``, read by Spark. Paths are relative to it."""
    root = str(root).rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.rs").load(root)
    # Spark's readers pass over empty files, which are modules all the same.
    empty = [(p, bytearray(), 0) for p in _empty_files(spark, root)]
    files = files.select("path", "content", "length").unionByName(spark.createDataFrame(empty, "path string, content binary, length bigint"))
    own = F.regexp_replace(F.col("path"), f"^.*?{re.escape(root.removeprefix('file:'))}/", "")
    rows = files.where(~pruned(F.col("path"), root.removeprefix("file:"), excludes))
    return rows.select(
        F.lit(crate or Path(root).name).alias("crate"), own.alias("path"), paths.stem(own).alias("stem"), F.decode("content", "UTF-8").alias("content"), "length", content_hash(F.col("content")).alias("hash")
    )


def _empty_files(spark: SparkSession, root: str) -> list[str]:
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    found, out = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(top, True), []
    while found.hasNext():
        status = found.next()
        if status.getLen() == 0 and status.getPath().getName().endswith(".rs"):
            out.append(str(status.getPath()))
    return out


def root_modules(files: DataFrame) -> DataFrame:
    """(crate, path, id): entry points by path, with their root names."""
    return files.select("crate", "path", paths.root_name(F.col("path")).alias("id")).where("id is not null")


def discover(files: DataFrame) -> DataFrame:
    """Folders with sources as clusters: cluster, folder, parent, depth, has_mod_file, modules, children.

    The folder of the crate's sources is ``root``; other clusters are named by their folders joined by ``::``.
    """
    folder = F.regexp_replace(F.regexp_extract("path", r"^(?:.*?src/|src/)?(.*?)[^/]*$", 1), "/$", "")
    rows = files.select(folder.alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("file"), paths.stem(F.col("path")).alias("module"))
    name = F.when(F.col("folder") == "", "root").otherwise(F.regexp_replace("folder", "/", "::"))
    up = F.regexp_extract("folder", "^(.*)/[^/]*$", 1)
    clusters = rows.groupBy("folder").agg(F.max(F.col("file") == "mod.rs").alias("has_mod_file"), F.array_sort(F.collect_set("module")).alias("modules"))
    clusters = clusters.select(
        name.alias("cluster"), "folder", F.when(F.col("folder") != "", F.when(up == "", "root").otherwise(F.regexp_replace(up, "/", "::"))).alias("parent"), paths.depth(F.col("folder")).alias("depth"), "has_mod_file", "modules"
    )
    children = clusters.where("parent is not null").groupBy(F.col("parent").alias("cluster")).agg(F.array_sort(F.collect_list(F.col("cluster"))).alias("children"))
    return clusters.join(children, "cluster", "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))


def cluster_tree(clusters: DataFrame) -> DataFrame:
    """Clusters in pre-order from ``root``: by their path."""
    return clusters.orderBy(F.when(F.col("cluster") == "root", "").otherwise(F.col("cluster"))).select("cluster", "modules")


# ---------------------------------------------------------------- on the driver


def find_crate_root(start: str) -> str:
    """The crate of a folder: itself with a manifest and ``src``, or with ``src``; a child with a manifest; an ancestor with both; else itself."""
    here = Path(start)
    if (here / "src").is_dir():
        return str(here)
    if here.is_dir():
        for child in sorted(here.iterdir()):
            if (child / "Cargo.toml").is_file():
                return str(child)
    for above in here.parents:
        if (above / "Cargo.toml").is_file() and (above / "src").is_dir():
            return str(above)
    return str(here)


def is_workspace(root: str) -> bool:
    manifest = Path(root, "Cargo.toml")
    return manifest.is_file() and "[workspace]" in manifest.read_text(errors="replace")


def find_crates(root: str) -> list[str]:
    """The crates of a folder, sorted: the root if it has a manifest and sources, the members that a workspace's manifest
    lists (with ``*`` patterns, less those it excludes), and, where it lists none, folders one level below with a manifest."""
    top = Path(root)
    if not top.is_dir():
        return []
    own = [str(top)] if (top / "Cargo.toml").is_file() and (top / "src").is_dir() else []
    if not (patterns := workspace_lists(root)[0]):
        return own + [str(p) for p in sorted(top.iterdir()) if p.name not in PRUNED and (p / "Cargo.toml").is_file()]
    members = {p for pattern in patterns for p in top.glob(pattern) if (p / "Cargo.toml").is_file() and p.name not in PRUNED}
    gone = {top / x for x in workspace_lists(root)[1]}
    return own + [str(p) for p in sorted(members) if not any(g == p or g in p.parents for g in gone) and p != top]


def workspace_lists(root: str) -> tuple[list[str], list[str]]:
    """``members`` and ``exclude`` of a workspace's manifest; empty where there is none. A pattern that leaves the folder is an error."""
    manifest = Path(root, "Cargo.toml")
    if not manifest.is_file():
        return [], []
    try:
        listed = tomllib.loads(manifest.read_text(errors="replace")).get("workspace", {})
    except tomllib.TOMLDecodeError as error:
        raise ConfigError(str(error), str(manifest)) from error
    out = tuple([str(x).rstrip("/") for x in listed.get(k, [])] if isinstance(listed, dict) else [] for k in ("members", "exclude"))
    for pattern in out[0]:
        if os.path.isabs(pattern) or ".." in pattern.split("/"):
            raise InvalidPathError("a member must be inside the workspace", pattern)
    return out


def crate_name(manifest: str) -> str:
    """From a manifest's text: the first line that begins with ``name`` and has a value; ``unknown`` if there is none."""
    for line in manifest.splitlines():
        key, eq, value = line.partition("=")
        if key.strip() == "name" and eq:
            return value.strip().strip("\"'")
    return "unknown"


@dataclass
class Config:
    """What a configuration file holds."""

    ignore: list[str] = field(default_factory=list)
    output_format: str | None = None


def load_config(path: str) -> Config | None:
    """A TOML file with ``ignore`` and ``[output] format``; None if it isn't there."""
    if not os.path.isfile(path):
        return None
    try:
        data = tomllib.loads(Path(path).read_text())
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as error:
        raise ConfigError(str(error), path) from error
    ignore, output = data.get("ignore", []), data.get("output", {})
    if not isinstance(ignore, list) or not all(isinstance(x, str) for x in ignore) or not isinstance(output, dict):
        raise ConfigError("ignore is a list of strings, output a table", path)
    return Config(ignore, output.get("format"))


def checked_output_path(path: str) -> str:
    """A relative path that stays where it is; else InvalidPathError."""
    if "\0" in path or os.path.isabs(path) or re.match(r"[A-Za-z]:", path) or ".." in re.split(r"[\\/]", path):
        raise InvalidPathError("an output path must be relative and without ..", path)
    return path
