"""Removal of dead modules: a plan as a DataFrame, then changes to files on the driver, by default only told."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.rust.facts import view

#: Folders deeper than this are left alone.
DEEPEST = 128


@dataclass
class FixResult:
    files_removed: list[str] = field(default_factory=list)
    declarations_removed: list[str] = field(default_factory=list)
    dirs_removed: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def plan(dead: DataFrame, facts: DataFrame) -> DataFrame:
    """(action, target, detail): each dead module's file to remove, and its declaration in the first file that declares it."""
    refs = view(facts, "module_refs").where("ref_kind = 'mod'").select(F.col("ref").alias("name"), F.col("file").alias("parent"))
    removals = dead.select(F.lit("remove_file").alias("action"), F.col("file").alias("target"), F.col("name").alias("detail"))
    parents = dead.select("name").join(refs, "name").groupBy("name").agg(F.min("parent").alias("parent"))
    return removals.unionByName(parents.select(F.lit("remove_declaration").alias("action"), F.col("parent").alias("target"), F.col("name").alias("detail")))


def _pattern(name: str) -> str:
    return rf"(?m)^[ \t]*(?:#\[[^\]\n]*\][ \t]*\n?[ \t]*)*(?:pub(?:\([^)\n]*\))?[ \t]+)?mod[ \t]+{re.escape(name)}[ \t]*;[^\n]*(?:\n|\Z)"


def without_declaration(content: str, name: str) -> str:
    """Source text without ``mod name;``, whatever its visibility and attributes; blank runs become one line; a last newline stays."""
    out = re.sub(_pattern(name), "", content)
    if out == content:
        return content
    return re.sub(r"\n{3,}", "\n\n", out)


def without_declaration_column(content: Column, name: str) -> Column:
    """The same as an expression."""
    out = F.regexp_replace(content, _pattern(name).replace(r"\Z", r"\z"), "")
    return F.when(out == content, content).otherwise(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def remove_file(path: str, dry_run: bool = True) -> bool:
    """False if it isn't there; symbolic links and what isn't a file are refused."""
    p = Path(path)
    if p.is_symlink():
        raise OSError(f"{path} is a symbolic link")
    if not p.exists():
        return False
    if not p.is_file():
        raise OSError(f"{path} isn't a file")
    if not dry_run:
        p.unlink()
    return True


def remove_declaration(path: str, name: str, dry_run: bool = True) -> bool:
    p = Path(path)
    before = p.read_text()
    after = without_declaration(before, name)
    if after != before and not dry_run:
        p.write_text(after)
    return after != before


def remove_empty_dirs(root: str, dry_run: bool = True) -> list[str]:
    """Empty folders below ``root``, innermost first; a folder named src stays."""
    out: list[str] = []

    def visit(folder: Path, depth: int) -> bool:
        """Whether nothing is left in it."""
        if depth > DEEPEST:
            return False
        empty = True
        for child in sorted(folder.iterdir()):
            empty = (child.is_dir() and not child.is_symlink() and visit(child, depth + 1)) and empty
        if not empty or folder.name == "src" or depth == 0:
            return False
        out.append(str(folder))
        if not dry_run:
            os.rmdir(folder)
        return True

    visit(Path(root), 0)
    return out


def apply(steps: DataFrame, root: str, dry_run: bool = True) -> FixResult:
    """Makes the changes of a plan, whose targets are below ``root``; what fails is told and the rest goes on."""
    result = FixResult()
    for row in sorted(steps.collect(), key=tuple):
        target = os.path.join(root, row["target"].rpartition("//")[2])
        try:
            if row["action"] == "remove_file":
                if remove_file(target, dry_run):
                    result.files_removed.append(target)
            elif os.path.exists(target) and remove_declaration(target, row["detail"].rpartition("::")[2], dry_run):
                result.declarations_removed.append(f"{target}: {row['detail']}")
        except OSError as error:
            result.errors.append(str(error))
    source = os.path.join(root, "src")
    result.dirs_removed = remove_empty_dirs(source if os.path.isdir(source) else root, dry_run)
    return result
