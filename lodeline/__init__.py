"""Reachability and liveness analytics on Spark: what users need, under one name."""

from lodeline.errors import CacheError, ConfigError, FixError, GraphError, InvalidPathError, LodelineError, NotFoundError, ParseError, ReadError
from lodeline.operators.graph import build_edges, dead_nodes, depth_by_source, reach, valid_roots
from lodeline.operators.liveness import dead, dead_by_all, last_writer, mask_after_flag
from lodeline.operators.resolve import name_edges, resolve_calls, suffix_matches
from lodeline.plans.detectors import Detector, Found
from lodeline.plans.engine import DISPLAY, KINDS, Engine, analyze_crates
from lodeline.rust.facts import extract, view

__all__ = [
    "DISPLAY", "KINDS", "CacheError", "ConfigError", "Detector", "Engine", "FixError", "Found", "GraphError", "InvalidPathError", "LodelineError", "NotFoundError", "ParseError", "ReadError",
    "analyze_crates", "build_edges", "dead", "dead_by_all", "dead_nodes", "depth_by_source", "extract", "last_writer", "mask_after_flag", "name_edges", "reach", "resolve_calls", "suffix_matches", "valid_roots", "view",
]
