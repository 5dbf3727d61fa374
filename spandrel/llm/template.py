"""A small sandboxed template language for conversations, compiled to Python closures.

Text with `{{ expression }}` and the statements for / endfor, if / elif / else / endif, set, generation / endgeneration.
Expressions: strings, integers, true, false, none, names, `a.b` and `a["b"]` (keys of mappings only), `not`, `and`,
`or`, `==`, `!=`, `in`, `+`, `~` (joins as text), `x if c else y`, brackets and filters from a fixed list. Nothing else
can be reached: no attributes, no calls, no names that start with an underscore.

The parser makes a syntax tree, constants are folded in it, neighbouring texts are joined, and each node becomes a closure. A
loop reads its sequence one item ahead, so messages can be a stream.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any, Protocol

_TAGS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKENS = re.compile(r"""\s*(?:(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>\d+)|(?P<name>[A-Za-z]\w*)|(?P<mark>==|!=|[.\[\]()|+~]))""")
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", '"': '"', "'": "'"}


class TemplateError(ValueError):
    pass


class Sink(Protocol):
    def write(self, text: str) -> None: ...
    def begin(self) -> None: ...
    def end(self) -> None: ...


# Syntax tree: ("const", v) | ("name", n) | ("item", e, key) | ("op", name, a, b) | ("not", e) | ("pick", c, a, b) | ("filter", name, e);
# ("out", e) | ("for", name, e, body) | ("if", [(c, body), ...], other) | ("set", name, e) | ("generation", body).


class _Expression:
    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> bool:
        self.at += (found := self.peek(*values))
        return found

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("expected a name")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        tree = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def choice(self) -> tuple:
        tree = self.either()
        if self.take("if"):
            condition = self.either()
            tree = ("pick", condition, tree, self.choice() if self.take("else") else ("const", ""))
        return tree

    def _left(self, below: Callable[[], tuple], *marks: str) -> tuple:
        tree = below()
        while self.peek(*marks):
            mark = self.tokens[self.at][1]
            self.at += 1
            tree = ("op", mark, tree, below())
        return tree

    def either(self) -> tuple:
        return self._left(self.both, "or")

    def both(self) -> tuple:
        return self._left(self.negated, "and")

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self._left(self.joined, "==", "!=", "in")

    def joined(self) -> tuple:
        return self._left(self.filtered, "+", "~")

    def filtered(self) -> tuple:
        tree = self.primary()
        while self.peek(".", "[", "|"):
            if self.take("."):
                tree = ("item", tree, ("const", self.name()))
            elif self.take("["):
                tree = ("item", tree, self.choice())
                self.need("]")
            else:
                self.need("|")
                tree = ("filter", self.name(), tree)
        return tree

    def primary(self) -> tuple:
        if self.take("("):
            tree = self.choice()
            self.need(")")
            return tree
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), value[1:-1], flags=re.S))
        if kind == "number":
            return ("const", int(value))
        if kind == "name":
            return ("const", {"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list[tuple]:
    """The template's syntax tree."""
    pieces, at = [], 0
    for m in _TAGS.finditer(source):
        if m.start() > at:
            pieces.append(("text", source[at : m.start()]))
        if m[1] is not None:
            pieces.append(("out", m[1]))
        elif m[2] is not None:
            pieces.append(("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        pieces.append(("text", source[at:]))
    if any(kind == "text" and re.search(r"\{[{%#]", value) for kind, value in pieces):
        raise TemplateError("a tag has no end")
    position = 0

    def body(*ends: str) -> tuple[list[tuple], str]:
        nonlocal position
        out: list[tuple] = []
        while position < len(pieces):
            kind, value = pieces[position]
            position += 1
            if kind == "text":
                out.append(("out", ("const", value)))
                continue
            if kind == "out":
                out.append(("out", _Expression(value).whole()))
                continue
            word, _, rest = value.partition(" ")
            if word in ends:
                return out, value
            if word == "for":
                name, found, sequence = rest.partition(" in ")
                if not found or not re.fullmatch(r"[A-Za-z]\w*", name.strip()):
                    raise TemplateError(f"bad loop {value!r}")
                out.append(("for", name.strip(), _Expression(sequence).whole(), body("endfor")[0]))
            elif word == "if":
                cases, other, condition = [], [], rest
                while True:
                    inner, end = body("elif", "else", "endif")
                    cases.append((_Expression(condition).whole(), inner))
                    if end.startswith("elif"):
                        condition = end.partition(" ")[2]
                        continue
                    if end == "else":
                        other = body("endif")[0]
                    break
                out.append(("if", cases, other))
            elif word == "set":
                name, found, value = rest.partition("=")
                if not found or not re.fullmatch(r"[A-Za-z]\w*", name.strip()):
                    raise TemplateError(f"bad set {rest!r}")
                out.append(("set", name.strip(), _Expression(value).whole()))
            elif word == "generation":
                out.append(("generation", body("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown statement {value!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return out, ""

    return body()[0]


def _text(x: Any) -> str:
    return "" if x is None else str(x)


_OPERATORS: dict[str, Callable[[Any, Any], Any]] = {
    "+": lambda a, b: a + b if isinstance(a, (str, int)) and type(a) is type(b) else _text(a) + _text(b),
    "~": lambda a, b: _text(a) + _text(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "in": lambda a, b: isinstance(b, (str, tuple, list, Mapping)) and a in b,
}
FILTERS: dict[str, Callable[[Any], Any]] = {"trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "capitalize": lambda x: _text(x).capitalize()}


def fold(tree: tuple, filters: Mapping[str, Callable]) -> tuple:
    """The expression with all constant parts worked out."""
    if tree[0] in ("const", "name"):
        return tree
    if tree[0] == "filter":
        if tree[1] not in filters:
            raise TemplateError(f"unknown filter {tree[1]!r}")
        inner = fold(tree[2], filters)
        return ("const", filters[tree[1]](inner[1])) if inner[0] == "const" else ("filter", tree[1], inner)
    parts = [fold(x, filters) if isinstance(x, tuple) else x for x in tree[1:]]
    known = [x[0] == "const" for x in parts if isinstance(x, tuple)]
    if tree[0] == "pick" and parts[0][0] == "const":
        return parts[1] if parts[0][1] else parts[2]
    if tree[0] == "op" and tree[1] in ("and", "or") and parts[1][0] == "const":
        return parts[2] if bool(parts[1][1]) == (tree[1] == "and") else parts[1]
    out = (tree[0], *parts)
    return ("const", _expression(out, filters)({})) if all(known) else out


def _expression(tree: tuple, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    kind = tree[0]
    if kind == "const":
        return lambda env, v=tree[1]: v
    if kind == "name":
        return lambda env, n=tree[1]: env.get(n)
    if kind == "filter":
        f, inner = filters[tree[1]], _expression(tree[2], filters)
        return lambda env: f(inner(env))
    if kind == "not":
        inner = _expression(tree[1], filters)
        return lambda env: not inner(env)
    if kind == "item":
        whole, key = _expression(tree[1], filters), _expression(tree[2], filters)

        def item(env: dict) -> Any:
            held = whole(env)
            return held.get(key(env)) if isinstance(held, Mapping) else None

        return item
    if kind == "pick":
        condition, a, b = (_expression(x, filters) for x in tree[1:])
        return lambda env: a(env) if condition(env) else b(env)
    a, b = _expression(tree[2], filters), _expression(tree[3], filters)
    if tree[1] == "and":
        return lambda env: a(env) and b(env)
    if tree[1] == "or":
        return lambda env: a(env) or b(env)
    return lambda env, f=_OPERATORS[tree[1]]: f(a(env), b(env))


def _folded(body: list[tuple], filters: Mapping[str, Callable]) -> list[tuple]:
    out: list[tuple] = []
    for node in body:
        kind = node[0]
        if kind == "out":
            tree = fold(node[1], filters)
            if tree[0] == "const":
                tree = ("const", _text(tree[1]))
                if out and out[-1][0] == "out" and out[-1][1][0] == "const":
                    tree = ("const", out.pop()[1][1] + tree[1])
            out.append(("out", tree))
        elif kind == "for":
            out.append(("for", node[1], fold(node[2], filters), _folded(node[3], filters)))
        elif kind == "set":
            out.append(("set", node[1], fold(node[2], filters)))
        elif kind == "generation":
            out.append(("generation", _folded(node[1], filters)))
        else:
            cases, other = [], _folded(node[2], filters)
            for condition, inner in node[1]:
                tree = fold(condition, filters)
                if tree[0] != "const":
                    cases.append((tree, _folded(inner, filters)))
                elif tree[1]:
                    other = _folded(inner, filters)
                    break
            out += [("if", cases, other)] if cases else other
    return out


def _statements(body: list[tuple], filters: Mapping[str, Callable]) -> Callable[[dict, Sink], None]:
    steps = [_statement(node, filters) for node in body]

    def run(env: dict, sink: Sink) -> None:
        for step in steps:
            step(env, sink)

    return run


def _statement(node: tuple, filters: Mapping[str, Callable]) -> Callable[[dict, Sink], None]:
    kind = node[0]
    if kind == "out":
        if node[1][0] == "const":
            return lambda env, sink, t=node[1][1]: sink.write(t)
        value = _expression(node[1], filters)
        return lambda env, sink: sink.write(_text(value(env)))
    if kind == "set":
        name, value = node[1], _expression(node[2], filters)
        return lambda env, sink: env.__setitem__(name, value(env))
    if kind == "generation":
        inner = _statements(node[1], filters)

        def generation(env: dict, sink: Sink) -> None:
            sink.begin()
            inner(env, sink)
            sink.end()

        return generation
    if kind == "if":
        cases = [(_expression(c, filters), _statements(b, filters)) for c, b in node[1]]
        other = _statements(node[2], filters)

        def choose(env: dict, sink: Sink) -> None:
            for condition, inner in cases:
                if condition(env):
                    return inner(env, sink)
            other(env, sink)

        return choose
    each = _each(node, filters)

    def loop(env: dict, sink: Sink) -> None:
        for _ in each(env, sink):
            pass

    return loop


def _once(node: tuple, filters: Mapping[str, Callable]) -> Callable[[dict, Sink], Iterator[None]]:
    step = _statement(node, filters)

    def run(env: dict, sink: Sink) -> Iterator[None]:
        step(env, sink)
        yield

    return run


def _each(node: tuple, filters: Mapping[str, Callable]) -> Callable[[dict, Sink], Iterator[None]]:
    """A loop that pauses after each turn."""
    name, sequence, inner = node[1], _expression(node[2], filters), _statements(node[3], filters)

    def loop(env: dict, sink: Sink) -> Iterator[None]:
        items = iter(sequence(env) or ())
        end, index = object(), 0
        item = next(items, end)
        while item is not end:
            following = next(items, end)
            inner(env | {name: item, "loop": {"index": index + 1, "first": index == 0, "last": following is end}}, sink)
            yield
            item, index = following, index + 1

    return loop


class Template:
    def __init__(self, source: str, filters: Mapping[str, Callable] | None = None):
        known = {**FILTERS, **(filters or {})}
        self.tree = _folded(parse(source), known)
        self._steps = [(_each if node[0] == "for" else _once)(node, known) for node in self.tree]

    def steps(self, sink: Sink, messages: Iterable[Mapping], **names: Any) -> Iterator[None]:
        """Renders, and pauses after each turn of an outermost loop and each outermost statement, so that the sink can be emptied."""
        env = {"messages": messages, **names}
        for step in self._steps:
            yield from step(env, sink)

    def render(self, sink: Sink, messages: Iterable[Mapping], **names: Any) -> None:
        for _ in self.steps(sink, messages, **names):
            pass
