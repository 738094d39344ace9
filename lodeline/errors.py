"""Errors of the engine."""

from __future__ import annotations


class LodelineError(Exception):
    """Of all the engine's errors. ``path``: the file concerned, if any."""

    recoverable = False

    def __init__(self, message: str, path: str | None = None):
        super().__init__(f"{path}: {message}" if path else message)
        self.path = path


class ReadError(LodelineError):
    """A file or folder can't be read; the others can."""

    recoverable = True


class ParseError(LodelineError):
    """A source file isn't understood; the others are."""

    recoverable = True


class CacheError(LodelineError):
    """A snapshot can't be used; the work is done anew."""

    recoverable = True


class ConfigError(LodelineError):
    """A configuration file is wrong."""


class InvalidPathError(LodelineError):
    """A path isn't allowed."""


class NotFoundError(LodelineError):
    """A crate or entry point isn't there."""


class GraphError(LodelineError):
    """A graph can't be built."""


class FixError(LodelineError):
    """A change couldn't be made."""

    recoverable = True
