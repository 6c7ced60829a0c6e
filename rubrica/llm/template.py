"""A small sandboxed template language, compiled to Python closures.

    text  {{ expression }}  {% for x in expression %} ... {% endfor %}
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %}
    {% set x = expression %}  {% generation %} ... {% endgeneration %}

Expressions: strings, numbers, true, false, none, names, ``x.key``, ``==``, ``!=``, ``and``,
``or``, ``not``, ``~`` (join as text), parentheses, ``x | filter``; in loops ``loop.first``, ``loop.last``
and ``loop.index``.  There are no calls, and a dot reads keys of mappings only, so a template
reaches nothing but its context and the given filters.

``parse`` makes a syntax tree, ``fold`` evaluates what is constant, and ``Template`` turns the
tree into closures that write (text, is it generated) to a sink.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[.|()~]))""")
_CONSTANTS = {"true": True, "false": False, "none": None}
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}


class TemplateError(ValueError):
    """The template does not follow the language."""


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> str:
        kind, text = self.peek()
        if kind == "end" or (value is not None and text != value):
            raise TemplateError(f"expected {value or 'more'}, found {text!r}")
        self.at += 1
        return text

    def whole(self) -> tuple:
        node = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.peek() == ("name", "or"):
            self.take()
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.peek() == ("name", "and"):
            self.take()
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        if self.peek() == ("name", "not"):
            self.take()
            return ("not", self.negated())
        node = self.joined()
        if self.peek()[1] in ("==", "!=") and self.peek()[0] == "op":
            op = self.take()
            node = (op, node, self.joined())
        return node

    def joined(self) -> tuple:
        node = self.filtered()
        while self.peek() == ("op", "~"):
            self.take()
            node = ("~", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.simple()
        while self.peek() in (("op", "|"), ("op", ".")):
            if self.take() == "|":
                node = ("filter", node, self.take())
            else:
                node = ("key", node, self.take())
        return node

    def simple(self) -> tuple:
        kind, text = self.peek()
        self.take()
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), text[1:-1]))
        if kind == "num":
            return ("const", int(text))
        if kind == "name":
            return ("const", _CONSTANTS[text]) if text in _CONSTANTS else ("name", text)
        if text == "(":
            node = self.either()
            self.take(")")
            return node
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str) -> list[tuple]:
    """Syntax tree of a template: a list of nodes."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        parts.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))

    def body(i: int, ends: tuple[str, ...]) -> tuple[list[tuple], int, str]:
        nodes: list[tuple] = []
        while i < len(parts):
            kind, text = parts[i]
            i += 1
            if kind == "text":
                nodes.append(("text", text))
            elif kind == "out":
                nodes.append(("out", _Expression(text).whole()))
            else:
                word, _, rest = text.partition(" ")
                if word in ends:
                    return nodes, i, text
                if word == "for":
                    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)
                    if not m:
                        raise TemplateError(f"cannot read {text!r}")
                    inner, i, _ = body(i, ("endfor",))
                    nodes.append(("for", m[1], _Expression(m[2]).whole(), inner))
                elif word == "if":
                    cases, last = [], text
                    while last.partition(" ")[0] in ("if", "elif"):
                        test = _Expression(last.partition(" ")[2]).whole()
                        inner, i, last = body(i, ("elif", "else", "endif"))
                        cases.append((test, inner))
                    other: list[tuple] = []
                    if last == "else":
                        other, i, _ = body(i, ("endif",))
                    nodes.append(("if", cases, other))
                elif word == "set":
                    name, eq, value = rest.partition("=")
                    if not eq or not name.strip().isidentifier():
                        raise TemplateError(f"cannot read {text!r}")
                    nodes.append(("set", name.strip(), _Expression(value).whole()))
                elif word == "generation":
                    inner, i, _ = body(i, ("endgeneration",))
                    nodes.append(("generation", inner))
                else:
                    raise TemplateError(f"unknown tag {text!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return nodes, i, ""

    return body(0, ())[0]


def _text(value: Any) -> str:
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def fold_expression(node: tuple, filters: dict[str, Callable[[str], str]]) -> tuple:
    """Replace constant parts by their values."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "key":
        return ("key", fold_expression(node[1], filters), node[2])
    if kind == "filter":
        if node[2] not in filters:
            raise TemplateError(f"unknown filter {node[2]!r}")
        node = ("filter", fold_expression(node[1], filters), node[2])
        inner = [node[1]]
    else:
        node = (kind, *[fold_expression(x, filters) for x in node[1:]])
        inner = list(node[1:])
    if kind in ("and", "or") and node[1][0] == "const":
        short = bool(node[1][1]) == (kind == "or")
        return node[1] if short else node[2]
    if all(x[0] == "const" for x in inner):
        return ("const", compile_expression(node, filters)({}))
    return node


def fold(nodes: list[tuple], filters: dict[str, Callable[[str], str]]) -> list[tuple]:
    """Constant outputs become text, constant conditions are decided, neighbouring texts join."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in nodes:
        kind = node[0]
        if kind == "text":
            add(node)
        elif kind == "out":
            value = fold_expression(node[1], filters)
            add(("text", _text(value[1])) if value[0] == "const" else ("out", value))
        elif kind == "set":
            add(("set", node[1], fold_expression(node[2], filters)))
        elif kind == "for":
            add(("for", node[1], fold_expression(node[2], filters), fold(node[3], filters)))
        elif kind == "generation":
            add(("generation", fold(node[1], filters)))
        else:
            cases, other = [], fold(node[2], filters)
            for test, inner in node[1]:
                test = fold_expression(test, filters)
                if test[0] != "const":
                    cases.append((test, fold(inner, filters)))
                elif test[1]:
                    other = fold(inner, filters)
                    break
            if cases:
                add(("if", cases, other))
            else:
                for x in other:
                    add(x)
    return out


def compile_expression(node: tuple, filters: dict[str, Callable[[str], str]]) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda scope: value
    if kind == "name":
        name = node[1]
        return lambda scope: scope.get(name)
    first = compile_expression(node[1], filters)
    if kind == "key":
        key = node[2]

        def read(scope: dict) -> Any:
            value = first(scope)
            return value.get(key) if isinstance(value, dict) else None

        return read
    if kind == "filter":
        apply = filters[node[2]]
        return lambda scope: apply(_text(first(scope)))
    if kind == "not":
        return lambda scope: not first(scope)
    second = compile_expression(node[2], filters)
    if kind == "and":
        return lambda scope: first(scope) and second(scope)
    if kind == "or":
        return lambda scope: first(scope) or second(scope)
    if kind == "==":
        return lambda scope: first(scope) == second(scope)
    if kind == "!=":
        return lambda scope: first(scope) != second(scope)
    return lambda scope: _text(first(scope)) + _text(second(scope))


Writer = Callable[[str, bool], None]
Code = Callable[[dict, Writer, bool], None]


def compile_nodes(nodes: list[tuple], filters: dict[str, Callable[[str], str]]) -> Code:
    steps = [_compile_node(n, filters) for n in nodes]

    def run(scope: dict, write: Writer, generated: bool) -> None:
        for step in steps:
            step(scope, write, generated)

    return run


def _compile_node(node: tuple, filters: dict[str, Callable[[str], str]]) -> Code:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda scope, write, generated: write(text, generated)
    if kind == "out":
        value = compile_expression(node[1], filters)
        return lambda scope, write, generated: write(_text(value(scope)), generated)
    if kind == "set":
        name, value = node[1], compile_expression(node[2], filters)
        return lambda scope, write, generated: scope.__setitem__(name, value(scope))
    if kind == "generation":
        inner = compile_nodes(node[1], filters)
        return lambda scope, write, generated: inner(scope, write, True)
    if kind == "if":
        cases = [(compile_expression(t, filters), compile_nodes(b, filters)) for t, b in node[1]]
        other = compile_nodes(node[2], filters)

        def choose(scope: dict, write: Writer, generated: bool) -> None:
            for test, body in cases:
                if test(scope):
                    return body(scope, write, generated)
            return other(scope, write, generated)

        return choose
    items, step = compile_expression(node[2], filters), compile_step(node, filters)

    def loop(scope: dict, write: Writer, generated: bool) -> None:
        for item, index, last in _ahead(items(scope) or ()):
            step(scope, write, generated, item, index, last)

    return loop


def _ahead(items: Iterable) -> Iterator[tuple[Any, int, bool]]:
    """Items with their number from 1 and whether they are the last one; reads one ahead."""
    found, missing, index = iter(items), object(), 0
    item = next(found, missing)
    while item is not missing:
        after = next(found, missing)
        index += 1
        yield item, index, after is missing
        item = after


def compile_step(node: tuple, filters: dict[str, Callable[[str], str]]) -> Callable:
    """One turn of a loop."""
    name, body = node[1], compile_nodes(node[3], filters)

    def step(scope: dict, write: Writer, generated: bool, item: Any, index: int, last: bool) -> None:
        loop = {"index": index, "first": index == 1, "last": last}
        body({**scope, name: item, "loop": loop}, write, generated)

    return step


class Template:
    """A compiled template."""

    def __init__(self, source: str, filters: dict[str, Callable[[str], str]] | None = None):
        self.filters = {"trim": str.strip, "upper": str.upper, "lower": str.lower} | (filters or {})
        self.tree = fold(parse(source), self.filters)
        self.code = compile_nodes(self.tree, self.filters)
        loops = [i for i, n in enumerate(self.tree) if n[0] == "for" and n[2] == ("name", "messages")]
        self.by_turn = None
        if len(loops) == 1:
            i = loops[0]
            before, after = (compile_nodes(part, self.filters) for part in (self.tree[:i], self.tree[i + 1 :]))
            self.by_turn = (before, compile_step(self.tree[i], self.filters), after)

    def pieces(self, messages: Iterable[dict], **context: Any) -> Iterator[list[tuple[str, bool]]]:
        """(text, was it inside generation markers) of one turn after another.

        For templates with one outer loop over ``messages``, which may be an iterator.  What
        stands before the loop goes to the first turn, what stands after it to the last.
        """
        if self.by_turn is None:
            raise TemplateError("turn by turn, a template needs one outer loop over messages")
        before, step, after = self.by_turn
        scope = dict(context)
        for item, index, last in _ahead(messages):
            out: list[tuple[str, bool]] = []

            def write(text: str, generated: bool, out: list = out) -> None:
                if text:
                    out.append((text, generated))

            if index == 1:
                before(scope, write, False)
            step(scope, write, False, item, index, last)
            if last:
                after(scope, write, False)
            yield out

    def text(self, messages: Iterable[dict], **context: Any) -> tuple[str, list[tuple[int, int]]]:
        """The whole text, and the places that were written inside generation markers."""
        parts: list[str] = []
        spans: list[tuple[int, int]] = []
        at = 0

        def write(text: str, generated: bool) -> None:
            nonlocal at
            if generated and text:
                spans.append((at, at + len(text)))
            parts.append(text)
            at += len(text)

        self.code({**context, "messages": list(messages)}, write, False)
        return "".join(parts), spans
