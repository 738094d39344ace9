"""Rust source to token trees."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class RustSyntaxError(ValueError):
    """The text isn't Rust, as far as this front end reads it."""


@dataclass(slots=True)
class Token:
    kind: str  # name, lifetime, literal, mark, group
    text: str  # of a group its opening bracket
    items: list[Token] = field(default_factory=list)
    line: int = 0

    def is_(self, text: str) -> bool:
        return self.text == text and self.kind in ("mark", "name")

    def group(self, bracket: str) -> bool:
        return self.kind == "group" and self.text == bracket


_TOKEN = re.compile(
    r"""
    (?P<space>\s+|//[^\n]*)
  | (?P<raw>(?:b|c|br|cr)?r(?P<hash>\#*)")
  | (?P<string>[bc]?"(?:[^"\\]|\\.)*")
  | (?P<char>b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))')
  | (?P<lifetime>'(?:r\#)?[^\W\d]\w*)
  | (?P<number>[0-9](?:[0-9a-zA-Z_]|\.(?![.\w])|\.(?=[0-9])|(?<=[eE])[+-](?=[0-9]))*)
  | (?P<name>(?:r\#)?[^\W\d]\w*)
  | (?P<mark>::|->|=>|\.\.=|\.\.\.|\.\.|==|!=|[-+*/%^!&|=<>@.,;:\#$?~])
  | (?P<open>[(\[{])
  | (?P<close>[)\]}])
    """,
    re.X | re.S,
)
_BRACKETS = {")": "(", "]": "[", "}": "{"}


def _after_comment(text: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    raise RustSyntaxError("a comment doesn't end")


def lex(text: str) -> list[Token]:
    """Token trees; brackets must match. A first line ``#!...`` that isn't an attribute is skipped."""
    text = text.removeprefix("﻿")
    at = 0
    if text.startswith("#!") and not re.match(r"#!\s*\[", text):
        at = text.find("\n") if "\n" in text else len(text)
    stack: list[Token] = [Token("group", "")]
    line, last = 1, at
    while at < len(text):
        if text.startswith("/*", at):
            at = _after_comment(text, at)
            continue
        if not (m := _TOKEN.match(text, at)):
            raise RustSyntaxError(f"unexpected {text[at]!r}")
        kind, word, at = m.lastgroup, m[0], m.end()
        line += text.count("\n", last, m.start())
        last = m.start()
        if kind == "hash" or m["raw"]:
            end = text.find('"' + m["hash"], at)
            if end < 0:
                raise RustSyntaxError("a raw string doesn't end")
            at = end + 1 + len(m["hash"])
            stack[-1].items.append(Token("literal", '"', line=line))
        elif kind in ("string", "char", "number"):
            stack[-1].items.append(Token("literal", word, line=line))
        elif kind == "open":
            stack[-1].items.append(group := Token("group", word, line=line))
            stack.append(group)
        elif kind == "close":
            if len(stack) == 1 or stack[-1].text != _BRACKETS[word]:
                raise RustSyntaxError(f"unmatched {word}")
            stack.pop()
        elif kind != "space":
            stack[-1].items.append(Token(kind, word.removeprefix("r#") if kind == "name" else word, line=line))
    if len(stack) > 1:
        raise RustSyntaxError(f"unclosed {stack[-1].text}")
    return stack[0].items
