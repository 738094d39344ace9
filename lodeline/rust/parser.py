"""Items, expressions, patterns and types of a Rust file, told to a listener as they are read.

Nothing but what the listener asks for is kept. Macro bodies are opaque. A file that isn't read to its end
raises ``RustSyntaxError``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from lodeline.rust.lexer import RustSyntaxError, Token, lex

# Words that can't be names.
KEYWORDS = frozenset(
    "as break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await".split()
)
_PATH_WORDS = frozenset(("self", "Self", "super", "crate"))
_ITEM_WORDS = frozenset(("mod", "use", "fn", "struct", "enum", "union", "trait", "impl", "static", "type", "extern"))


@dataclass(slots=True)
class Path:
    names: list[str]
    arguments: list[list[Token]] = field(default_factory=list)  # of each <...>
    self_type: list[Token] | None = None  # of <T as ...>

    @property
    def text(self) -> str:
        return "::".join(self.names)


@dataclass(slots=True)
class Use:
    """A leaf of a use tree: its whole path, ``*`` for a glob, and the name it is known by."""

    names: list[str]
    alias: str | None
    visibility: str


class Cursor:
    """Reads a list of tokens."""

    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    def peek(self, ahead: int = 0) -> Token | None:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else None

    def next(self) -> Token:
        if (t := self.peek()) is None:
            raise RustSyntaxError("unexpected end")
        self.at += 1
        return t

    def sees(self, text: str, ahead: int = 0) -> bool:
        return (t := self.peek(ahead)) is not None and t.is_(text)

    def sees_group(self, bracket: str, ahead: int = 0) -> bool:
        return (t := self.peek(ahead)) is not None and t.group(bracket)

    def take(self, text: str) -> bool:
        if self.sees(text):
            self.at += 1
            return True
        return False

    def expect(self, text: str) -> Token:
        t = self.next()
        if not (t.is_(text) or t.group(text)):
            raise RustSyntaxError(f"line {t.line}: expected {text}, found {t.text}")
        return t

    def name(self) -> str:
        t = self.next()
        if t.kind != "name":
            raise RustSyntaxError(f"line {t.line}: expected a name, found {t.text}")
        return t.text

    def angle(self) -> list[Token]:
        """What stands between < and its >, with the cursor after it."""
        self.expect("<")
        depth, start = 1, self.at
        while depth:
            t = self.next()
            depth += t.is_("<") - t.is_(">")
        return self.tokens[start : self.at - 1]

    def until(self, *stops: str) -> list[Token]:
        """Tokens up to a mark or group outside <...>, not taken."""
        start, depth = self.at, 0
        while (t := self.peek()) is not None:
            if depth <= 0 and (t.kind in ("mark", "name", "group")) and t.text in stops:
                break
            depth += t.is_("<") - t.is_(">")
            self.at += 1
        return self.tokens[start : self.at]


def split(tokens: list[Token], mark: str) -> list[list[Token]]:
    """Parts between marks outside <...>; an empty last part is left out."""
    out, now, depth = [], [], 0
    for t in tokens:
        depth += t.is_("<") - (t.is_(">") and depth > 0)
        if t.is_(mark) and depth == 0:
            out.append(now)
            now = []
        else:
            now.append(t)
    return [*out, now] if now else out


def type_name(tokens: list[Token], whole: bool = False) -> str:
    """A type's path, its last name or, ``whole``, all of it with a leading reference; ``<unknown>`` for other types."""
    c = Cursor(tokens)
    prefix = ""
    while c.sees("&"):
        c.next()
        if (t := c.peek()) is not None and t.kind == "lifetime":
            c.next()
        prefix += "&mut " if c.take("mut") else "&"
    t = c.peek()
    if t is None or (prefix and not whole) or not (t.kind == "name" and (t.text not in KEYWORDS or t.text in _PATH_WORDS) or t.is_("::") or t.is_("<")):
        return "<unknown>" if not prefix or not whole else prefix + "<unknown>"
    try:
        path = _type_path(c)
    except RustSyntaxError:
        return "<unknown>"
    return prefix + (path.text if whole else path.names[-1]) if path.names else "<unknown>"


def _type_path(c: Cursor) -> Path:
    path = Path([])
    if c.sees("<"):
        inner = c.angle()
        parts = Cursor(inner)
        path.self_type = parts.until("as")
        if parts.take("as"):
            path.names += _type_path(parts).names
        c.expect("::")
    c.take("::")
    while True:
        path.names.append(c.name())
        if c.sees("::") and c.sees("<", 1):
            c.next()
        if c.sees("<"):
            path.arguments.append(c.angle())
        elif c.sees_group("(") and path.names[-1] in ("Fn", "FnMut", "FnOnce"):
            path.arguments.append(c.next().items)
            if c.take("->"):
                path.arguments.append(c.until(",", "+", "=", ";", "{", ">"))
        if not (c.sees("::") and (t := c.peek(1)) is not None and t.kind == "name"):
            return path
        c.next()


class Listener:
    """What a file tells. All do nothing here."""

    def inner_attribute(self, tokens): ...
    def module(self, name, visibility, inline): ...
    def leave_module(self): ...
    def use(self, leaf: Use, top: bool): ...
    def function(self, name, visibility, attributes, generics, where, inputs, output, has_body, has_self): ...
    def leave_function(self): ...
    def record(self, kind, name, visibility, generics, where, fields): ...
    def variant(self, enum, name, visibility): ...
    def trait(self, name, visibility, generics, where): ...
    def impl(self, trait_path, self_type, generics, where): ...
    def leave_block(self): ...
    def constant(self, name, visibility, static, mutable): ...
    def macro_definition(self, name, exported): ...
    def macro_call(self, path): ...
    def path(self, path: Path, called: bool): ...
    def method(self, name): ...
    def member(self, name): ...
    def struct_literal(self, path: Path): ...
    def pattern_path(self, path: Path, shape: str): ...
    def pattern_name(self, name): ...
    def type(self, tokens, where): ...
    def match(self, arms): ...
    def array_length(self, path: Path): ...
    def const_argument(self, path: Path): ...


class Parser:
    def __init__(self, listener: Listener):
        self.on = listener
        self.depth = 0  # of modules and bodies; 0 at the top of the file

    def file(self, text: str) -> None:
        c = Cursor(lex(text))
        while c.sees("#") and c.sees("!", 1):
            c.next(), c.next()
            self.on.inner_attribute(c.expect("[").items)
        self.items(c)

    # ------------------------------------------------------------ items

    def items(self, c: Cursor, owner: str = "") -> None:
        while c.peek() is not None:
            self.item(c, owner)

    def attributes(self, c: Cursor) -> list[list[Token]]:
        out = []
        while c.sees("#"):
            c.next()
            c.take("!")
            out.append(c.expect("[").items)
        return out

    def visibility(self, c: Cursor) -> str:
        if not c.take("pub"):
            return "private"
        if c.sees_group("(") and (inner := c.peek().items) and inner[0].text in ("crate", "super", "self", "in"):
            c.next()
            return {"crate": "pub(crate)", "super": "pub(super)"}.get(inner[0].text, "pub(restricted)")
        return "pub"

    def item(self, c: Cursor, owner: str) -> None:
        if c.take(";"):
            return
        attributes, visibility = self.attributes(c), self.visibility(c)
        if c.peek() is None:
            raise RustSyntaxError("nothing after an attribute")
        c.take("default") if c.sees("default") and not c.sees("!", 1) else None
        ahead = 0
        while (t := c.peek(ahead)) is not None and (t.text in ("const", "async", "unsafe", "extern", "safe") and t.kind == "name" or ahead and t.kind == "literal" and c.peek(ahead - 1).is_("extern")):
            ahead += 1
        if c.sees("fn", ahead):
            c.at += ahead
            return self.function(c, visibility, attributes, owner)
        if c.sees("unsafe") and any(c.sees(w, 1) for w in ("impl", "trait", "extern", "mod", "auto")):
            c.next()
        if c.sees("auto") and c.sees("trait", 1):
            c.next()
        t = c.next()
        word = t.text if t.kind == "name" else ""
        if word == "mod":
            self.module(c, visibility)
        elif word == "use":
            self.use_tree(c, visibility)
        elif word == "extern" and c.take("crate"):
            c.until(";")
            c.expect(";")
        elif word == "extern":
            if (t := c.peek()) is not None and t.kind == "literal":
                c.next()
            self.foreign(Cursor(c.expect("{").items))
        elif word in ("struct", "enum") or word == "union" and (n := c.peek()) is not None and n.kind == "name":
            self.record(c, word, visibility)
        elif word == "trait":
            self.trait(c, visibility)
        elif word == "impl":
            self.impl(c)
        elif word in ("const", "static"):
            self.constant(c, word, visibility)
        elif word == "type":
            c.name()
            if c.sees("<"):
                c.angle()
            body = c.until(";")
            c.expect(";")
            parts = split(body, "=")
            if len(parts) > 1:
                self.type(parts[-1], "alias")
        elif word == "macro_rules" and c.take("!"):
            name = c.name()
            self.on.macro_call(Path(["macro_rules"]))
            self.on.macro_definition(name, any(a and a[0].text == "macro_export" for a in attributes))
            self.macro_body(c)
        elif word == "macro" and (n := c.peek()) is not None and n.kind == "name":
            self.on.macro_definition(c.name(), visibility != "private")
            while not c.sees_group("{"):
                c.next()
            c.next()
        elif t.kind == "name" or t.is_("::"):
            c.at -= 1
            path = self.expression_path(c)
            if not c.take("!"):
                raise RustSyntaxError(f"line {t.line}: {path.text} isn't an item")
            if (n := c.peek()) is not None and n.kind == "name":
                c.next()
            self.on.macro_call(path)
            self.macro_body(c)
        else:
            raise RustSyntaxError(f"line {t.line}: {t.text} isn't an item")

    def macro_body(self, c: Cursor) -> None:
        body = c.next()
        if body.kind != "group":
            raise RustSyntaxError(f"line {body.line}: a macro has no body")
        if body.text != "{":
            c.take(";")

    def module(self, c: Cursor, visibility: str) -> None:
        name = c.name()
        if c.take(";"):
            self.on.module(name, visibility, False)
            return
        body = c.expect("{")
        self.on.module(name, visibility, True)
        self.depth += 1
        inner = Cursor(body.items)
        self.items(inner)
        self.depth -= 1
        self.on.leave_module()

    def use_tree(self, c: Cursor, visibility: str) -> None:
        tree = Cursor(c.until(";"))
        c.expect(";")
        tree.take("::")
        self.use_leaves(tree, [], visibility)
        if tree.peek() is not None:
            raise RustSyntaxError("an odd use")

    def use_leaves(self, c: Cursor, before: list[str], visibility: str) -> None:
        if c.sees_group("{"):
            for part in split(c.next().items, ","):
                inner = Cursor(part)
                inner.take("::")
                self.use_leaves(inner, before, visibility)
            return
        if c.take("*"):
            self.on.use(Use([*before, "*"], None, visibility), self.depth == 0)
            return
        names = [*before, c.name()]
        if c.take("::"):
            self.use_leaves(c, names, visibility)
            return
        alias = c.name() if c.take("as") else None
        self.on.use(Use(names, alias, visibility), self.depth == 0)

    def generics(self, c: Cursor) -> list[list[Token]]:
        return split(c.angle(), ",") if c.sees("<") else []

    def where(self, c: Cursor, *stops: str) -> list[list[Token]]:
        return split(c.until(*stops), ",") if c.take("where") else []

    def function(self, c: Cursor, visibility: str, attributes: list, owner: str) -> None:
        c.expect("fn")
        name, generics = c.name(), self.generics(c)
        inputs = split(c.expect("(").items, ",")
        output = c.until("where", "{", ";") if c.take("->") else []
        where = self.where(c, "{", ";")
        has_body = c.sees_group("{")
        types, has_self = [], False
        for part in inputs:
            one = Cursor(part)
            self.attributes(one)
            rest = one.tokens[one.at :]
            colon = split(rest, ":")
            if any(t.is_("self") for t in (colon[0] if colon else [])):
                has_self = True
                types.append(("self", rest))
            elif len(colon) > 1:
                types.append((rest, rest[len(colon[0]) + 1 :]))
            elif rest:
                types.append((rest, rest))  # a trait's unnamed argument
        self.on.function(name, visibility, attributes, generics, where, types, output, has_body, has_self)
        self.generic_bounds(generics, where)
        for pattern, kind in types:
            if pattern != "self":
                if pattern is not kind:
                    self.pattern(Cursor(split(pattern, ":")[0]))
                self.type(kind, "signature")
        if output:
            self.type(output, "signature")
        if has_body:
            self.body(c.next().items)
        else:
            c.expect(";")
        self.on.leave_function()

    def generic_bounds(self, generics, where) -> None:
        for part in (*generics, *where):
            at = next((i for i, t in enumerate(part) if t.is_(":") or t.is_("=")), len(part))
            for bound in split(part[at + 1 :], "+"):
                self.type(bound, "bound")

    def body(self, tokens: list[Token]) -> None:
        self.depth += 1
        self.block(tokens)
        self.depth -= 1

    def record(self, c: Cursor, kind: str, visibility: str) -> None:
        name, generics = c.name(), self.generics(c)
        where = self.where(c, "{", ";", "(")
        fields: list[list[Token]] = []
        if kind == "enum":
            body = c.expect("{")
            variants = []
            for part in split(body.items, ","):
                v = Cursor(part)
                self.attributes(v)
                self.visibility(v)
                variants.append((v.name(), v))
            for _, v in variants:
                if v.sees_group("("):
                    fields += self.tuple_fields(v.next().items)
                elif v.sees_group("{"):
                    fields += self.named_fields(v.next().items)
        elif c.sees_group("{"):
            fields = self.named_fields(c.next().items)
        elif c.sees_group("("):
            fields = self.tuple_fields(c.next().items)
            where += self.where(c, ";")
            c.expect(";")
        else:
            c.expect(";")
        self.on.record(kind, name, visibility, generics, where, fields)
        self.generic_bounds(generics, where)
        for f in fields:
            self.type(f, "field")
        if kind == "enum":
            for variant, v in variants:
                self.on.variant(name, variant, visibility)
                if v.take("="):
                    self.expressions(v.tokens[v.at :])
        self.on.leave_block()

    def tuple_fields(self, tokens: list[Token]) -> list[list[Token]]:
        out = []
        for part in split(tokens, ","):
            one = Cursor(part)
            self.attributes(one)
            self.visibility(one)
            out.append(part[one.at :])
        return out

    def named_fields(self, tokens: list[Token]) -> list[list[Token]]:
        out = []
        for part in split(tokens, ","):
            one = Cursor(part)
            self.attributes(one)
            self.visibility(one)
            one.name()
            one.expect(":")
            if one.peek() is None:
                raise RustSyntaxError("a field has no type")
            out.append(part[one.at :])
        return out

    def trait(self, c: Cursor, visibility: str) -> None:
        name, generics = c.name(), self.generics(c)
        bounds = c.until("{", "where", ";") if c.take(":") else []
        where = self.where(c, "{", ";")
        if c.take("="):
            c.until(";")
        self.on.trait(name, visibility, generics, where)
        self.generic_bounds(generics, where)
        for b in split(bounds, "+"):
            self.type(b, "bound")
        if c.sees_group("{"):
            self.depth += 1
            self.items(Cursor(c.next().items), "trait")
            self.depth -= 1
        else:
            c.expect(";")
        self.on.leave_block()

    def impl(self, c: Cursor) -> None:
        generics = self.generics(c)
        c.take("const")
        c.take("!")
        head = c.until("{", "where")
        where = self.where(c, "{")
        depth, at = 0, None
        for i, t in enumerate(head):
            depth += t.is_("<") - t.is_(">")
            if t.is_("for") and depth == 0 and not (i + 1 < len(head) and head[i + 1].is_("<")):
                at = i
                break
        trait_path = _type_path(Cursor(head[:at])) if at is not None else None
        self_type = head[at + 1 :] if at is not None else head
        if not self_type:
            raise RustSyntaxError("an impl of nothing")
        self.on.impl(trait_path, self_type, generics, where)
        self.generic_bounds(generics, where)
        self.type(self_type, "self")
        self.depth += 1
        self.items(Cursor(c.expect("{").items), "impl")
        self.depth -= 1
        self.on.leave_block()

    def foreign(self, c: Cursor) -> None:
        self.depth += 1
        self.items(c, "extern")
        self.depth -= 1

    def constant(self, c: Cursor, word: str, visibility: str) -> None:
        mutable = word == "static" and c.take("mut")
        name = c.name()
        kind = []
        if c.sees("<"):
            c.angle()
        if c.take(":"):
            kind = c.until("=", ";")
        value = c.until(";") if c.take("=") else []
        c.expect(";")
        self.on.constant(name, visibility, word == "static", mutable)
        self.type(kind, "constant")
        self.expressions(value)

    # ------------------------------------------------------------ types

    def type(self, tokens: list[Token], where: str) -> None:
        """Tells the type, and the paths of expressions within it."""
        if not tokens:
            return
        self.on.type(tokens, where)
        self.inside_type(tokens)

    def inside_type(self, tokens: list[Token]) -> None:
        for i, t in enumerate(tokens):
            if t.group("["):
                parts = split(t.items, ";")
                self.inside_type(parts[0] if parts else [])
                if len(parts) > 1:
                    if (p := self.only_path(parts[1])) is not None:
                        self.on.array_length(p)
                    self.expressions(parts[1])
            elif t.group("("):
                self.inside_type(t.items)
            elif t.group("{"):
                if (p := self.only_path(t.items)) is not None:
                    self.on.const_argument(p)
                self.expressions(t.items)
            elif t.is_("!") and i and tokens[i - 1].kind == "name" and i + 1 < len(tokens) and tokens[i + 1].kind == "group":
                self.on.macro_call(Path([tokens[i - 1].text]))

    def only_path(self, tokens: list[Token]) -> Path | None:
        if not tokens or tokens[0].kind != "name":
            return None
        c = Cursor(tokens)
        try:
            path = self.expression_path(c)
        except RustSyntaxError:
            return None
        return path if c.peek() is None else None

    # ------------------------------------------------------------ statements and expressions

    def block(self, tokens: list[Token]) -> None:
        """Statements: nested items, let, and expressions."""
        c = Cursor(tokens)
        while (t := c.peek()) is not None:
            start = c.at
            if t.is_(";"):
                c.next()
                continue
            if t.is_("#"):
                self.attributes(c)
                if c.peek() is None:
                    return
                t = c.peek()
            if self.starts_item(c):
                c.at = start
                self.item(c, "")
            elif t.is_("let"):
                self.let(c, ("else", ";"))
                if c.take("else"):
                    self.block(c.expect("{").items)
            else:
                self.expression(c, True, (";",), statement=True)
            if c.at == start:
                raise RustSyntaxError(f"line {t.line}: can't read {t.text}")

    def starts_item(self, c: Cursor) -> bool:
        t, n = c.peek(), c.peek(1)
        if t.kind != "name" or n is None:
            return False
        if t.text in _ITEM_WORDS:
            return t.text != "union" or n.kind == "name"
        if t.text == "pub" or t.text == "macro_rules" and n.is_("!"):
            return True
        if t.text == "const":
            return not n.group("{") and not n.is_("|") and not n.is_("move")
        if t.text == "unsafe":
            return n.text in ("fn", "impl", "trait", "extern")
        return t.text == "async" and n.is_("fn")

    def let(self, c: Cursor, stops: tuple[str, ...], literals: bool = True) -> None:
        c.expect("let")
        pattern = c.until(":", "=", *stops)
        self.pattern_of(pattern)
        if c.take(":"):
            kind = c.until("=", *stops)
            self.type(kind, "let")
        if c.take("="):
            self.expression(c, literals, stops)

    def expressions(self, tokens: list[Token]) -> None:
        """A list of tokens that are expressions, whatever parts them."""
        c = Cursor(tokens)
        while c.peek() is not None:
            start = c.at
            self.expression(c, True, ())
            if c.at == start:
                c.next()

    def expression(self, c: Cursor, literals: bool, stops: tuple[str, ...], statement: bool = False) -> None:
        """Reads on until a stop. ``literals``: ``path {`` is a struct. A statement ends after its block, too."""
        operand = True  # an operand may start here
        while (t := c.peek()) is not None:
            if t.kind in ("mark", "name") and t.text in stops:
                return
            if t.kind == "group":
                c.next()
                if t.text == "{":
                    self.block(t.items)
                    if statement and operand and not self.goes_on(c):
                        return
                elif t.text == "[" and (parts := split(t.items, ";")) and len(parts) == 2:
                    self.expressions(parts[0])
                    self.expressions(parts[1])
                else:
                    self.expressions(t.items)
                operand = False
            elif t.kind == "literal":
                c.next()
                operand = False
            elif t.kind == "lifetime":
                c.next()
                if c.sees(":"):
                    c.next()
            elif t.is_("#"):
                self.attributes(c)
            elif t.is_("|") and operand:
                self.closure(c)
            elif t.is_("<") and operand or t.is_("::"):
                self.path_expression(c, literals)
                operand = False
            elif t.kind == "mark":
                c.next()
                if t.text == "." and (n := c.peek()) is not None and n.kind == "name":
                    self.dotted(c)
                    operand = False
                elif t.text == "?":
                    operand = False
                elif t.text == "|" and c.take("|"):
                    operand = True
                else:
                    operand = True
            else:
                operand = self.word(c, t, literals, statement and operand)
                if operand is None:
                    return

    def goes_on(self, c: Cursor) -> bool:
        """Whether an expression that began with a block continues."""
        return c.sees(".") or c.sees("?")

    def word(self, c: Cursor, t: Token, literals: bool, statement: bool) -> bool | None:
        """A name or keyword; whether an operand may follow, None at the end of a statement."""
        word = t.text
        if word in ("if", "while"):
            c.next()
            self.condition(c)
            self.block(c.expect("{").items)
            while c.take("else"):
                if c.take("if"):
                    self.condition(c)
                self.block(c.expect("{").items)
            return None if statement and not self.goes_on(c) else False
        if word == "match":
            c.next()
            self.head(c)
            self.arms(c.expect("{").items)
            return None if statement and not self.goes_on(c) else False
        if word == "for" and not c.sees("<", 1):
            c.next()
            self.pattern_of(c.until("in"))
            c.expect("in")
            self.head(c)
            self.block(c.expect("{").items)
            return None if statement and not self.goes_on(c) else False
        if word in ("loop", "unsafe", "async", "const") and (c.sees_group("{", 1) or word == "async" and c.sees("move", 1) and c.sees_group("{", 2)):
            c.next()
            c.take("move")
            self.block(c.next().items)
            return None if statement and not self.goes_on(c) else False
        if word == "let":  # in a condition
            c.next()
            self.pattern_of(c.until("="))
            c.expect("=")
            return True
        if word == "as":
            c.next()
            self.cast(c)
            return False
        if word in ("return", "break", "continue", "move", "mut", "ref", "dyn", "in", "async", "static", "box", "yield", "await", "const", "unsafe", "else", "where", "impl", "fn", "type", "use", "pub", "enum", "struct", "trait", "mod", "extern", "loop", "for"):
            if word in KEYWORDS or word in ("yield",):
                c.next()
                return True
        if word in ("true", "false"):
            c.next()
            return False
        self.path_expression(c, literals)
        return False

    def condition(self, c: Cursor) -> None:
        self.head(c)

    def head(self, c: Cursor) -> None:
        """An expression before a block: ``path {`` is not a struct here."""
        start, tokens = c.at, c.tokens
        end = start
        seen = False  # an operand has been seen, so a block is the body
        while end < len(tokens):
            t = tokens[end]
            if t.group("{") and seen:
                break
            if t.is_("let"):  # its pattern may have braces
                while end < len(tokens) and not tokens[end].is_("="):
                    end += 1
                seen = False
            elif t.is_("match") or t.is_("if") and end > start or t.is_("unsafe") or t.is_("loop"):  # holds a block of its own
                while end < len(tokens) and not tokens[end].group("{"):
                    end += 1
                while end + 1 < len(tokens) and tokens[end + 1].is_("else"):
                    end += 1
                    while end < len(tokens) and not tokens[end].group("{"):
                        end += 1
                seen = True
            else:
                seen = seen or t.kind in ("name", "literal", "group") and t.text not in ("let", "mut", "move", "async")
                if t.kind == "mark" and t.text in ("=", "&", "|", "==", "!=", "+", "*", "/", "-"):
                    seen = False
            end += 1
        inner = Cursor(tokens[:end])
        inner.at = start
        self.expression(inner, False, ())
        c.at = end

    def closure(self, c: Cursor) -> None:
        c.expect("|")
        inputs = c.until("|")
        c.expect("|")
        for part in split(inputs, ","):
            sides = split(part, ":")
            if sides:
                self.pattern_of(sides[0])
            if len(sides) > 1:
                self.type(part[len(sides[0]) + 1 :], "closure")
        if c.take("->"):
            kind = c.until("{")
            self.type(kind, "closure")

    def dotted(self, c: Cursor) -> None:
        name = c.name()
        if name == "await":
            return
        if c.sees("::") and c.sees("<", 1):
            c.next()
            self.arguments(c.angle())
        if c.sees_group("("):
            self.on.method(name)
            self.expressions(c.next().items)
        else:
            self.on.member(name)

    def arguments(self, tokens: list[Token]) -> None:
        """Of a turbofish."""
        for part in split(tokens, ","):
            self.type(part, "argument")

    def cast(self, c: Cursor) -> None:
        start = c.at
        while c.sees("&") or c.sees("*") or c.sees("mut") or c.sees("const") or c.sees("dyn") or c.sees("impl") or (t := c.peek()) is not None and t.kind == "lifetime":
            c.next()
        t = c.peek()
        if t is None:
            raise RustSyntaxError("a cast to nothing")
        if t.kind == "group" or t.is_("_"):
            c.next()
        elif t.is_("unsafe") or t.is_("extern") or t.is_("fn"):
            while not c.sees_group("("):
                c.next()
            c.next()
            if c.take("->"):
                self.cast(c)
        else:
            _type_path(c)
        self.type(c.tokens[start : c.at], "cast")

    def expression_path(self, c: Cursor) -> Path:
        path = Path([])
        if c.sees("<"):
            parts = Cursor(c.angle())
            path.self_type = parts.until("as")
            if parts.take("as"):
                path.names += _type_path(parts).names
            c.expect("::")
        c.take("::")
        while True:
            path.names.append(c.name())
            while c.sees("::") and c.sees("<", 1):
                c.next()
                path.arguments.append(c.angle())
            if not (c.sees("::") and (t := c.peek(1)) is not None and t.kind == "name"):
                return path
            c.next()

    def path_expression(self, c: Cursor, literals: bool) -> None:
        path = self.expression_path(c)
        if path.self_type is not None:
            self.type(path.self_type, "qualified")
        for a in path.arguments:
            self.arguments(a)
        if c.sees("!") and (n := c.peek(1)) is not None and n.kind == "group":
            c.next(), c.next()
            self.on.macro_call(path)
            return
        if c.sees_group("(") and path.names[-1] not in KEYWORDS - _PATH_WORDS:
            self.on.path(path, True)
            self.expressions(c.next().items)
            return
        if literals and c.sees_group("{") and self.looks_like_struct(path, c.peek()):
            self.on.struct_literal(path)
            for part in split(c.next().items, ","):
                f = Cursor(part)
                self.attributes(f)
                if (t := f.peek()) is not None and t.kind in ("name", "literal") and f.sees(":", 1):
                    f.next(), f.next()
                elif f.take(".."):
                    pass
                self.expression(f, True, ())
            return
        self.on.path(path, False)

    def looks_like_struct(self, path: Path, body: Token) -> bool:
        last = path.names[-1]
        return last[:1].isupper() or len(path.names) > 1 and len(body.items) > 1 and body.items[1].is_(":")

    # ------------------------------------------------------------ match and patterns

    def arms(self, tokens: list[Token]) -> None:
        c, arms, bodies = Cursor(tokens), [], []
        while c.peek() is not None:
            if c.take(","):
                continue
            self.attributes(c)
            head = c.until("=>")
            if not head or not c.take("=>"):
                raise RustSyntaxError("an arm without =>")
            guard = next((i for i, t in enumerate(head) if t.is_("if")), len(head))
            if c.sees_group("{") and not (c.sees(".", 1) or c.sees("?", 1)):
                body = [c.next()]
            else:
                start = c.at
                while (t := c.peek()) is not None and not t.is_(","):
                    if t.is_("<") and c.at > start and c.tokens[c.at - 1].is_("::"):
                        c.angle()
                    elif t.is_("|") and (c.at == start or c.tokens[c.at - 1].text in ("(", ",", "=", "move")):
                        c.next()
                        c.until("|")
                        c.next()
                    else:
                        c.next()
                body = c.tokens[start : c.at]
            arms.append(head[:guard])
            bodies.append((head[guard + 1 :], body))
        self.on.match([self.render(a) for a in arms])
        for pattern, (guard, body) in zip(arms, bodies, strict=True):
            self.pattern_of(pattern)
            self.expressions(guard)
            if len(body) == 1 and body[0].group("{"):
                self.block(body[0].items)
            else:
                self.expressions(body)

    def render(self, tokens: list[Token]) -> tuple[str, str | None, bool]:
        """An arm's pattern as canonical text, its variant and whether it is a wildcard."""
        cases = split_cases(tokens)
        if len(cases) > 1:
            return " | ".join(self.render(x)[0] for x in cases), None, False
        tokens = cases[0] if cases else []
        if not tokens:
            return "<complex>", None, False
        t = tokens[0]
        if t.is_("_") and len(tokens) == 1:
            return "_", None, True
        if t.is_("&"):
            rest = tokens[1:]
            inner = self.render(rest[1:] if rest and rest[0].is_("mut") else rest)
            return "&" + inner[0], inner[1], inner[2]
        if any(x.is_("..") or x.is_("..=") or x.is_("...") for x in tokens) and not (len(tokens) == 1):
            return "<range>", None, False
        if t.kind == "literal" or t.is_("-") or t.text in ("true", "false"):
            return "<literal>", None, False
        if t.kind == "group":
            inner = split(t.items, ",")
            if t.text == "(" and len(inner) == 1 and not (t.items and t.items[-1].is_(",")):
                return "<complex>", None, False
            return ("<tuple>" if t.text == "(" else "<slice>" if t.text == "[" else "<complex>"), None, False
        c = Cursor(tokens)
        bound = c.take("ref")
        bound = c.take("mut") or bound
        if c.peek() is None or c.peek().kind != "name" and not c.sees("::") and not c.sees("<"):
            return "<complex>", None, False
        path = self.expression_path(c)
        name = path.names[-1]
        if bound or c.sees("@") or c.peek() is None and len(path.names) == 1:
            return name, name, False
        if c.peek() is None:
            return path.text, name, False
        if c.sees_group("("):
            return f"{path.text}(..)", name, False
        if c.sees_group("{"):
            return f"{path.text} {{ .. }}", name, False
        return "<complex>", None, False

    def pattern_of(self, tokens: list[Token]) -> None:
        for case in split_cases(tokens):
            self.pattern(Cursor(case))

    def pattern(self, c: Cursor) -> None:
        """Tells the names and paths of one pattern, its alternatives too."""
        while (t := c.peek()) is not None:
            if t.kind == "group":
                c.next()
                for part in split(t.items, ","):
                    self.pattern_of(part)
            elif t.kind == "name" and t.text in ("ref", "mut", "box", "_", "true", "false"):
                c.next()
            elif t.kind == "name" and t.text == "const" and c.sees_group("{", 1):
                c.next()
                self.block(c.next().items)
            elif t.kind == "name" or t.is_("::") or t.is_("<"):
                path = self.expression_path(c)
                if c.sees("!") and (n := c.peek(1)) is not None and n.kind == "group":
                    c.next(), c.next()
                    self.on.macro_call(path)
                elif c.sees_group("("):
                    self.on.pattern_path(path, "tuple")
                    for part in split(c.next().items, ","):
                        self.pattern_of(part)
                elif c.sees_group("{"):
                    self.on.pattern_path(path, "struct")
                    for part in split(c.next().items, ","):
                        f = Cursor(part)
                        self.attributes(f)
                        if f.sees(":", 1):
                            f.next(), f.next()
                            self.pattern_of(part[f.at :])
                        else:
                            self.pattern_of([x for x in part if not x.is_("..")])
                elif len(path.names) > 1:
                    self.on.pattern_path(path, "path")
                else:
                    self.on.pattern_name(path.names[0])
            else:
                c.next()


def split_cases(tokens: list[Token]) -> list[list[Token]]:
    return [x for x in split(tokens, "|") if x]


def parse(text: str, listener: Listener) -> None:
    Parser(listener).file(text)
