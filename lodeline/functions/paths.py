"""Path, module and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(path: Column) -> Column:
    """Backslashes as slashes, without the prefix of verbatim paths."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^//\?/", "")


def stem(path: Column) -> Column:
    """The file's name without its last extension; a dot file's name is all stem."""
    name = F.regexp_extract(normalised(path), "([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def module_segments(path: Column) -> Column:
    """A source file's module path: the folders after the last ``src``, then the file unless it is mod, lib or main."""
    parts = F.split(normalised(path), "/")
    n = F.size(parts)
    at = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda found, i: F.when(F.element_at(parts, i) == "src", i).otherwise(found))
    inside = F.slice(parts, at + 1, F.greatest(n - at, F.lit(0)))
    named = F.filter(inside, lambda p: ~p.isin("mod.rs", "lib.rs", "main.rs", ""))
    return F.transform(named, lambda p: F.regexp_replace(p, r"\.rs$", ""))


def joined(segments: Column) -> Column:
    """``a::b``; ``crate`` for none."""
    return F.when(F.size(segments) == 0, "crate").otherwise(F.array_join(segments, "::"))


def parent(segments: Column) -> Column:
    """All segments but the last; null for none."""
    return F.when(F.size(segments) > 0, F.slice(segments, 1, F.size(segments) - 1))


def build_path(*parts: Column) -> Column:
    """Parts joined by ``::``; null and empty parts are left out."""
    return F.concat_ws("::", *(F.when(p != "", p) for p in parts))


def cluster(path: Column) -> Column:
    """The first folder or file after ``src``, without extension; null if there is no ``src``."""
    first = F.regexp_extract(normalised(path), r"(?:^|/)src/([^/]+)", 1)
    return F.when(first != "", F.regexp_replace(first, r"\.rs$", ""))


def folder_cluster(path: Column) -> Column:
    """The folders after ``src`` joined by ``::``; ``root`` for none."""
    folders = F.regexp_extract(normalised(path), r"(?:^|/)src/(.*)/[^/]*$", 1)
    return F.when(folders == "", "root").otherwise(F.regexp_replace(folders, "/", "::"))


def top_cluster(path: Column) -> Column:
    """The first of ``folder_cluster``."""
    return F.regexp_extract(folder_cluster(path), r"^(.*?)(?:::|$)", 1)


def depth(folder: Column) -> Column:
    """Segments of a folder, 0 for the empty one."""
    return F.size(F.filter(F.split(normalised(folder), "/"), lambda p: p != ""))


def root_name(path: Column) -> Column:
    """An entry point's root name; null for other files.

    ``src/main.rs`` is main, ``src/lib.rs`` lib, ``src/bin/x.rs`` and ``src/bin/x/main.rs`` are x.
    """
    p = normalised(path)
    one = F.regexp_extract(p, r"(?:^|/)src/(main|lib)\.rs$", 1)
    flat = F.regexp_extract(p, r"(?:^|/)src/bin/([^/]+)\.rs$", 1)
    nested = F.regexp_extract(p, r"(?:^|/)src/bin/([^/]+)/main\.rs$", 1)
    return F.when(one != "", one).when(flat != "", flat).when(nested != "", nested)


def dot_id(name: Column) -> Column:
    """A name as a DOT identifier."""
    return F.regexp_replace(name, "::|<|>", "_")


def short_label(name: Column, most: int = 20) -> Column:
    """Names of more than ``most`` characters as their first ``most - 3`` and three dots."""
    return F.when(F.length(name) > most, F.concat(F.substring(name, 1, most - 3), F.lit("..."))).otherwise(name)


# Visibility spellings of the extractors, and of the module facts beside them.
VISIBILITY = {"pub": "Public", "pub(crate)": "PubCrate", "pub(super)": "PubSuper", "pub(restricted)": "PubIn", "private": "Private"}


def visibility_name(spelled: Column) -> Column:
    """A visibility's spelling as its name; what is unknown is private."""
    out = F.lit("Private")
    for text, name in VISIBILITY.items():
        out = F.when(spelled == text, name).otherwise(out)
    return out


def may_be_external(name: Column) -> Column:
    """Seen from outside the crate, perhaps."""
    return name.isin("Public", "PubIn")


def is_crate_internal(name: Column) -> Column:
    return name.isin("PubCrate", "PubSuper")


def starts_lower(name: Column) -> Column:
    return name.rlike(r"^\p{Ll}")


def starts_upper(name: Column) -> Column:
    return name.rlike(r"^\p{Lu}")


def has_upper(name: Column) -> Column:
    return name.rlike(r"\p{Lu}")


def is_function_entry(name: Column, visibility: Column, is_test: Column, is_no_mangle: Column) -> Column:
    """Entry of the function analysis: main, any pub, a test, or exported to the linker."""
    return (name == "main") | visibility.startswith("pub") | is_test | is_no_mangle


def is_call_entry(name: Column, path: Column, visibility: Column) -> Column:
    """Entry of the call graph: main, exactly pub, or a path with ``test`` in it."""
    return (name == "main") | path.contains("test") | (visibility == "pub")


def contains_any(column: Column, patterns: list[str]) -> Column:
    """Whether a plain pattern is in the column; false for no pattern."""
    out = F.lit(False)
    for p in patterns:
        out = out | column.contains(p)
    return out


def matches_any(column: Column, patterns: list[str]) -> Column:
    """Patterns with a star at the end are prefixes, with a star at the start suffixes, others are looked for anywhere."""
    out = F.lit(False)
    for p in patterns:
        out = out | (column.startswith(p[:-1]) if p.endswith("*") else column.endswith(p[1:]) if p.startswith("*") else column.contains(p))
    return out
