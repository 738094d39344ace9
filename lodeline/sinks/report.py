"""Reports as text and JSON, and a JSON log."""

from __future__ import annotations

import json
import logging
import sys
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame


def dead_names_text(names: Iterable[str]) -> str:
    names = sorted(names)
    return "\n".join([f"DEAD MODULES ({len(names)}):", *(f"  - {n}" for n in names)]) if names else "No dead modules found."


def dead_names_json(names: Iterable[str]) -> str:
    return json.dumps({"dead": sorted(names)}, indent=2)


def detector_json(title: str, dead: DataFrame, stats: DataFrame) -> str:
    """One detector's counts and dead rows."""
    rows = [r.asDict(recursive=True) for r in dead.collect()]
    return json.dumps({"detector": title, "stats": stats.first().asDict(), "dead": sorted(rows, key=lambda r: json.dumps(r, sort_keys=True, default=str))}, indent=2, default=str)


def detector_text(title: str, dead: DataFrame, stats: DataFrame, columns: tuple[str, ...]) -> str:
    rows = sorted(tuple(str(r[c]) for c in columns) for r in dead.select(*columns).collect())
    lines = [f"{title}: " + ", ".join(f"{k} {v}" for k, v in stats.first().asDict().items()), *("  " + "  ".join(r) for r in rows)]
    return "\n".join(lines if rows else [*lines, "  none"])


def tree_text(clusters: DataFrame) -> str:
    """Clusters with their modules, in the order of their paths."""
    rows = clusters.select("cluster", "depth", "modules").collect()
    rows.sort(key=lambda r: "" if r["cluster"] == "root" else r["cluster"])
    return "\n".join(f"{'  ' * r['depth']}{r['cluster']} ({len(r['modules'])}): {', '.join(r['modules'])}" for r in rows)


def crates_json(crates: DataFrame) -> str:
    """Rows (crate, dead) by crate."""
    return json.dumps({r["crate"]: {"dead": list(r["dead"])} for r in sorted(crates.collect(), key=lambda r: r["crate"])}, indent=2)


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        out = {"timestamp": int(time.time()), "level": record.levelname.lower(), "message": record.getMessage()}
        return json.dumps(out | getattr(record, "fields", {}))


def json_log(name: str = "lodeline", stream=None) -> logging.Logger:
    """A logger that writes a JSON object for each line to stderr."""
    log = logging.getLogger(name)
    if not log.handlers:
        handler = logging.StreamHandler(stream or sys.stderr)
        handler.setFormatter(JsonFormatter())
        log.addHandler(handler)
        log.setLevel(logging.INFO)
        log.propagate = False
    return log
