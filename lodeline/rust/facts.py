"""Fact rows of Rust files: each file is parsed once and yields rows of one wide table, cut into views by fact.

Rows carry only what their fact has; see ``VIEWS`` for the columns that each view shows under its own names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.operators.shipping import ship
from lodeline.rust.lexer import RustSyntaxError, Token
from lodeline.rust.parser import Cursor, Listener, Path, Use, parse, split, type_name

#: Larger files aren't parsed but told as errors.
MOST_BYTES = 10_000_000
# Words of a use path that name no module.
_PLACES = ("self", "super", "crate")

FACTS = "file string, fact string, name string, path string, parent string, kind string, visibility string, flag boolean, flag2 boolean, flag3 boolean, number int, total int, place long, names array<string>"
_KINDS = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
_ARROW = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in FACTS.split(", "))])

#: View: fact, and the wide table's columns under the view's names.
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "module_refs": ("module_ref", {"file": "file", "name": "ref", "kind": "ref_kind", "visibility": "visibility"}),
    "module_info": ("module_info", {"file": "file", "flag": "doc_hidden"}),
    "reexports": ("reexport", {"file": "file", "name": "name"}),
    "functions": ("function", {"file": "file", "name": "name", "path": "full_path", "visibility": "visibility", "flag": "is_method", "parent": "impl_type", "flag2": "is_test", "flag3": "is_no_mangle"}),
    "call_sites": ("call_site", {"file": "file", "name": "name", "path": "path", "flag": "is_method_call"}),
    "callgraph_functions": ("callgraph_function", {"file": "file", "name": "name", "path": "full_path", "flag": "is_method", "parent": "parent_type", "visibility": "visibility"}),
    "call_usages": ("call_usage", {"file": "file", "kind": "kind", "name": "call"}),
    "use_imports": ("use_import", {"file": "file", "name": "local_name", "names": "segments"}),
    "trait_methods": ("trait_method", {"file": "file", "parent": "trait_name", "name": "method_name", "path": "full_path", "visibility": "visibility", "flag": "is_required"}),
    "impl_methods": ("impl_method", {"file": "file", "parent": "trait_name", "kind": "type_name", "name": "method_name", "path": "full_id"}),
    "inherent_methods": ("inherent_method", {"file": "file", "parent": "type_name", "name": "method_name", "path": "full_id", "visibility": "visibility", "flag": "is_static"}),
    "method_usages": ("method_usage", {"file": "file", "name": "method_name", "path": "trait_name", "parent": "type_name", "kind": "usage_kind"}),
    "generics_declared": ("generic", {"file": "file", "name": "name", "kind": "kind", "parent": "parent", "path": "parent_kind", "names": "bounds"}),
    "generics_used": ("generic_use", {"file": "file", "parent": "parent", "kind": "kind", "name": "name"}),
    "macros_declared": ("macro", {"file": "file", "name": "name", "path": "module_path", "flag": "exported"}),
    "macros_used": ("macro_use", {"file": "file", "name": "name"}),
    "consts_declared": ("const", {"file": "file", "name": "name", "flag": "is_static", "flag2": "is_mutable", "visibility": "visibility", "path": "module_path", "parent": "impl_type"}),
    "consts_used": ("const_use", {"file": "file", "name": "name"}),
    "variants_declared": ("variant", {"file": "file", "parent": "enum_name", "name": "variant_name", "path": "full_name", "kind": "module_path", "visibility": "visibility"}),
    "variants_used": ("variant_use", {"file": "file", "kind": "kind", "name": "value"}),
    "match_arms": ("match_arm", {"file": "file", "place": "match_id", "number": "position", "total": "total_arms", "path": "pattern", "name": "variant_name", "flag": "is_wildcard"}),
    "match_used": ("match_use", {"file": "file", "kind": "kind", "name": "value"}),
    "errors": ("error", {"file": "file", "path": "reason"}),
}

_USAGE_KINDS = ("MethodCall", "AssociatedCall", "QualifiedCall")


class FactListener(Listener):
    def __init__(self, file: str):
        self.file, self.rows, self.seen = file, [], set()
        self.modules: list[str] = []
        self.functions = 0  # functions that are open
        self.block: tuple | None = None  # the open impl or trait
        self.held: list = []
        self.parent: str | None = None  # of generic usage
        self.exact = False
        self.matches = 0
        self.hidden = False

    def add(self, fact: str, once: bool = True, **of) -> None:
        key = (fact, *((k, tuple(v) if isinstance(v, list) else v) for k, v in of.items()))
        if once and key in self.seen:
            return
        self.seen.add(key)
        self.rows.append({"file": self.file, "fact": fact, **of})

    def joined(self, *names: str | None) -> str:
        return "::".join([*self.modules, *(n for n in names if n)])

    # modules and imports

    def inner_attribute(self, tokens):
        if len(tokens) == 2 and tokens[0].text == "doc" and tokens[1].group("(") and any(t.text == "hidden" for t in tokens[1].items):
            self.hidden = True

    def module(self, name, visibility, inline):
        if not inline and not self.modules and not self.functions:
            self.add("module_ref", name=name, kind="mod", visibility=visibility)
        if inline:
            self.modules.append(name)

    def leave_module(self):
        self.modules.pop()

    def use(self, leaf: Use, top: bool):
        if top:
            names = list(leaf.names)
            while names and names[0] in _PLACES:
                names.pop(0)
            if names and names[0] != "*":
                self.add("module_ref", name=names[0], kind="use", visibility=leaf.visibility)
            if leaf.visibility != "private":
                self.add("reexport", name=leaf.alias or leaf.names[-1])
        names = list(leaf.names)
        if names[-1] == "*":
            self.add("use_import", name="::".join([*names[-2:-1], "*"]), names=names[:-1])
            return
        if names[-1] == "self" and len(names) > 1:
            names.pop()
        if names[0] == "crate" and len(names) > 1:
            names.pop(0)
        if leaf.alias != "_":
            self.add("use_import", name=leaf.alias or names[-1], names=names)

    # functions, traits and impls

    def function(self, name, visibility, attributes, generics, where, inputs, output, has_body, has_self):
        block = self.block if not self.functions else None
        marks = {a[0].text for a in attributes if a} | {t.text for a in attributes if len(a) > 1 and a[0].text == "unsafe" for t in a[1].items}
        in_trait, in_impl = block is not None and block[0] == "trait", block is not None and block[0] == "impl"
        if not self.functions and not in_trait:
            self.add("function", once=False, name=name, path=self.joined(block[2] if in_impl else None, name), visibility=visibility, flag=in_impl, parent=block[2] if in_impl else None, flag2="test" in marks, flag3="no_mangle" in marks)
        owner = block[1] if in_trait else (block[1] or block[3]) if in_impl else None
        self.add("callgraph_function", once=False, name=name, path=self.joined(owner, name), visibility=block[2] if in_trait else visibility, flag=in_trait or in_impl and has_self, parent=block[3] if in_impl else None)
        if in_trait:
            self.add("trait_method", once=False, parent=block[1], name=name, path=self.joined(block[1], name), visibility=block[2], flag=not has_body)
        elif in_impl and block[1]:
            self.add("impl_method", once=False, parent=block[1], kind=block[4], name=name, path=f"impl {block[1]} for {block[4]} :: {name}")
        elif in_impl:
            self.add("inherent_method", once=False, parent=block[4], name=name, path=f"{block[4]}::{name}", visibility=visibility, flag=not has_self)
        self.held.append((self.functions, self.parent))
        self.functions += 1
        if block is None and self.functions == 1:
            self.parent = name
            self.declare(name, "function", generics, where)
        elif block is None:  # a function within a function
            self.parent = name
        for pattern, kind in inputs:
            if pattern == "self":
                for t in kind:
                    if t.kind == "lifetime":
                        self.generic_use("lifetime", t.text)

    def leave_function(self):
        self.functions, self.parent = self.held.pop()

    def trait(self, name, visibility, generics, where):
        self.held.append((self.block, self.parent))
        self.block, self.parent = ("trait", name, visibility), name
        self.declare(name, "trait", generics, where)

    def impl(self, trait_path: Path | None, self_type, generics, where):
        self.held.append((self.block, self.parent))
        last = trait_path.names[-1] if trait_path else None
        whole = type_name(self_type, whole=True)
        self.block = ("impl", last, "<unknown>" if whole.startswith("&") else whole, type_name(self_type), whole)
        self.parent = last or type_name(self_type)
        self.declare(self.parent, "impl", generics, where)

    def record(self, kind, name, visibility, generics, where, fields):
        self.held.append((self.block, self.parent))
        self.parent = name
        if not self.functions:
            self.declare(name, kind, generics, where)

    def leave_block(self):
        self.block, self.parent = self.held.pop()

    def variant(self, enum, name, visibility):
        self.add("variant", once=False, parent=enum, name=name, path=f"{enum}::{name}", kind="::".join(self.modules), visibility=visibility)

    def constant(self, name, visibility, static, mutable):
        if self.functions or self.block is not None and self.block[0] == "trait":
            return
        owner = self.block[2] if self.block is not None else None
        self.add("const", once=False, name=name, flag=static, flag2=mutable, visibility=visibility, path="::".join(self.modules), parent=owner)

    # generics

    def declare(self, parent, kind, generics: list[list[Token]], where: list[list[Token]]):
        bounds: dict[str, list[str]] = {}
        for part in where:
            sides = split(part, ":")
            if len(sides) > 1 and len(sides[0]) == 1:
                bounds.setdefault(sides[0][0].text, []).extend(self.bound_names(part[len(sides[0]) + 1 :]))
        for part in generics:
            part = part[next((i for i, t in enumerate(part) if t.kind in ("name", "lifetime")), 0) :]
            if not part:
                continue
            if part[0].kind == "lifetime":
                self.add("generic", once=False, name=part[0].text, kind="lifetime", parent=parent, path=kind, names=[])
            elif part[0].is_("const") and len(part) > 1:
                self.add("generic", once=False, name=part[1].text, kind="const", parent=parent, path=kind, names=[])
            else:
                inline = split(part, "=")[0][2:] if len(part) > 1 and part[1].is_(":") else []
                self.add("generic", once=False, name=part[0].text, kind="type", parent=parent, path=kind, names=self.bound_names(inline) + bounds.get(part[0].text, []))

    def bound_names(self, tokens: list[Token]) -> list[str]:
        found = [type_name([t for t in b if not t.is_("?")]) for b in split(tokens, "+") if b and b[0].kind != "lifetime"]
        return [n for n in found if n != "<unknown>"]

    def generic_use(self, kind: str, name: str):
        self.add("generic_use", parent=self.parent, kind=kind, name=name)

    def type(self, tokens, where):
        if where != "bound":
            self.collect(tokens)

    def collect(self, tokens: list[Token]) -> None:
        """Single upper-case names and lifetimes, through references, arguments, slices, tuples and bounds."""
        for part in split(tokens, "+"):
            c = Cursor(part)
            while (t := c.peek()) is not None:
                if t.kind == "lifetime":
                    self.generic_use("lifetime", t.text)
                    c.next()
                elif t.kind == "group":
                    inner = split(t.items, ";")
                    for x in split(inner[0] if inner else [], ","):
                        self.collect(x)
                    if t.text == "[" and len(inner) > 1 and self.exact is False and len(inner[1]) == 1 and inner[1][0].kind == "name" and inner[1][0].text[:1].isupper():
                        self.generic_use("type", inner[1][0].text)
                    c.next()
                elif t.is_("<"):
                    for x in split(c.angle(), ","):
                        at = next((i for i, y in enumerate(x) if y.is_("=")), -1)
                        self.collect(x[at + 1 :])
                elif t.kind == "name" and t.text not in ("mut", "const", "dyn", "impl", "fn", "unsafe", "extern", "for", "as"):
                    alone = not (c.at and part[c.at - 1].is_("::")) and not c.sees("::", 1)
                    if alone and t.text[:1].isupper():
                        self.generic_use("type", t.text)
                    c.next()
                else:
                    c.next()

    # usage

    def macro_definition(self, name, exported):
        self.add("macro", once=False, name=name, path="::".join(self.modules), flag=exported)

    def macro_call(self, path: Path):
        self.add("macro_use", name=path.names[-1])

    def path(self, path: Path, called: bool):
        last, several = path.names[-1], len(path.names) > 1
        if called:
            self.add("call_site", name=last, path=path.text if several else None, flag=False)
            if path.self_type is not None:
                self.add("method_usage", name=last, path="::".join(path.names[:-1]) or None, parent=type_name(path.self_type, whole=True), kind="QualifiedCall")
            elif several:
                self.add("method_usage", name=last, path=None, parent="::".join(path.names[:-1]), kind="AssociatedCall")
        if called or last[:1].islower():
            self.add("call_usage", kind="simple", name=last)
            if several:
                self.add("call_usage", kind="qualified", name=path.text)
        self.value(path)

    def value(self, path: Path):
        last = path.names[-1]
        self.const_use(last)
        self.variant_path(path)

    def const_use(self, name: str):
        if any(ch.isupper() for ch in name):
            self.add("const_use", name=name)

    def variant_path(self, path: Path):
        self.add("variant_use", kind="name", name=path.names[-1])
        if len(path.names) > 1:
            self.add("variant_use", kind="path", name="::".join(path.names[-2:]))
        self.add("match_use", kind="name", name=path.names[-1])
        self.add("match_use", kind="path", name=path.text)

    def method(self, name):
        self.add("call_site", name=name, path=None, flag=True)
        self.add("call_usage", kind="simple", name=name)
        self.add("method_usage", name=name, path=None, parent=None, kind="MethodCall")

    def member(self, name):
        self.const_use(name)

    def struct_literal(self, path: Path):
        self.variant_path(path)

    def pattern_path(self, path: Path, shape):
        self.variant_path(path)
        if shape == "path":
            self.const_use(path.names[-1])

    def pattern_name(self, name):
        self.const_use(name)
        if name[:1].isupper():
            self.add("variant_use", kind="name", name=name)
            self.add("match_use", kind="name", name=name)

    def array_length(self, path: Path):
        self.const_use(path.names[-1])

    const_argument = array_length

    def match(self, arms):
        self.matches += 1
        for position, (pattern, variant, wildcard) in enumerate(arms):
            self.add("match_arm", once=False, place=self.matches, number=position, total=len(arms), path=pattern, name=variant, flag=wildcard)


def facts_of(file: str, content: str | None) -> list[dict]:
    """All rows of one file; of a file that can't be parsed, one error row."""
    listener = FactListener(file)
    try:
        if content is None:
            raise RustSyntaxError("no text")
        if len(content.encode("utf-8", "surrogatepass")) > MOST_BYTES:
            raise RustSyntaxError("too large")
        parse(content, listener)
    except (RustSyntaxError, RecursionError) as error:
        return [{"file": file, "fact": "error", "path": str(error) or "nested too deeply"}]
    listener.add("module_info", flag=listener.hidden)
    return listener.rows


def spread(files: DataFrame) -> DataFrame:
    """``files`` dealt to twice as many tasks as there are cores. For tables of small texts, which are few bytes but much work."""
    return files.repartition(2 * files.sparkSession.sparkContext.defaultParallelism)


def extract(files: DataFrame, path: str = "path", content: str = "content", strict: bool = False) -> DataFrame:
    """The wide fact table of files (path, content). ``strict``: the first file that can't be parsed fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, text in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                found = facts_of(file, text.decode("utf-8", "replace") if isinstance(text, bytes) else text)
                if strict and found[0]["fact"] == "error":
                    raise RustSyntaxError(f"{file}: {found[0]['path']}")
                rows += found
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    ship(files.sparkSession)
    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(run, FACTS)


def view(facts: DataFrame, name: str) -> DataFrame:
    """One canonical table of the wide one."""
    fact, columns = VIEWS[name]
    return facts.where(F.col("fact") == fact).select(*(F.col(a).alias(b) for a, b in columns.items()))
