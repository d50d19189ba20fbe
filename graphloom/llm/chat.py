"""Chat formatting with a sandboxed template language, compiled to closures.

A template is text with tags::

    {{ expression }}                     put a value
    {% for name in expression %} ... {% endfor %}
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}   text that the loss counts

Expressions know literals, names, ``a.b`` and ``a['b']`` on mappings, ``==``
``!=`` ``in`` ``and`` ``or`` ``not`` ``+``, parentheses and ``| filter``.
There are no calls, no access to Python attributes and only the given filters,
so a template reaches nothing but its variables. In a loop ``loop.first``,
``loop.last`` and ``loop.index0`` are known.

Source is parsed into a syntax tree; constant expressions are folded, branches
on constants are resolved and neighbouring texts are joined; then each node
becomes a closure ``run(scope, emit)``, where ``emit(text, generating)`` takes
the output piece by piece. A conversation streams through with one message in
memory: loops take any iterator, and ``TurnReader`` reads turns back from the
pieces.

The house template marks every turn by control strings. Control strings inside
texts are escaped by a backslash after their first character (and a further
one where there are some already), which ``unescape`` takes away again.

Defined results: null texts and roles count as empty; rows of a conversation
are ordered by turn, then role and text, nulls first; repeated rows are turns of
their own; rows with a null conversation id form one conversation with a null
id; an empty table gives no conversations. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import filled

Emit = Callable[[str, bool], None]

#: What the house template puts between texts.
HOUSE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}<s>[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% elif m.role == 'system' %}<<SYS>>\n{{ m.text | escape }}\n<</SYS>>"
    "{% else %}<role>{{ m.role | escape }}</role>{{ m.text | escape }}</s>"
    "{% endif %}{% endfor %}"
)
#: Control strings without their first character, as a pattern.
CONTROL = r"/?s>|/?INST\]|<SYS>>|</SYS>>|/?role>"
_TO_ESCAPE = re.compile(rf"([<\[])(\\*)({CONTROL})")
_TO_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({CONTROL})")


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _TO_UNESCAPE.sub(r"\1\2\3", text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    pass


# -- Syntax tree ---------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Unary:
    of: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Filtered:
    of: object
    name: str


@dataclass(frozen=True)
class Put:
    what: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# -- Parser --------------------------------------------------------------------

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}", re.S)
_WORD = re.compile(r"\s*(?:([A-Za-z_]\w*)|(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(==|!=|[().\[\]|+]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent over an expression's words."""

    def __init__(self, source: str, filters: dict):
        self.words, self.filters, at = [], filters, 0
        while source[at:].strip():
            m = _WORD.match(source, at)
            if m is None:
                raise TemplateError(f"unexpected {source[at:].strip()[:10]!r} in {source.strip()!r}")
            kind = "name number string op".split()[m.lastindex - 1]
            self.words.append((kind, m[m.lastindex]))
            at = m.end()
        self.words.append(("end", ""))

    def take(self, *values: str) -> str | None:
        kind, value = self.words[0]
        if kind in ("op", "name") and value in values:
            self.words.pop(0)
            return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing before {self.words[0][1]!r}")

    def whole(self):
        found = self.either()
        if self.words[0][0] != "end":
            raise TemplateError(f"unexpected {self.words[0][1]!r}")
        return found

    def either(self):
        found = self.both()
        while self.take("or"):
            found = Binary("or", found, self.both())
        return found

    def both(self):
        found = self.negated()
        while self.take("and"):
            found = Binary("and", found, self.negated())
        return found

    def negated(self):
        return Unary(self.negated()) if self.take("not") else self.compared()

    def compared(self):
        found = self.added()
        while op := self.take("==", "!=", "in"):
            found = Binary(op, found, self.added())
        return found

    def added(self):
        found = self.filtered()
        while self.take("+"):
            found = Binary("+", found, self.filtered())
        return found

    def filtered(self):
        found = self.reached()
        while self.take("|"):
            kind, name = self.words.pop(0)
            if kind != "name" or name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            found = Filtered(found, name)
        return found

    def reached(self):
        found = self.atom()
        while op := self.take(".", "["):
            if op == ".":
                kind, name = self.words.pop(0)
                if kind != "name":
                    raise TemplateError(f"no name after '.': {name!r}")
                found = Item(found, Const(name))
            else:
                found = Item(found, self.either())
                self.need("]")
        return found

    def atom(self):
        if self.take("("):
            found = self.either()
            self.need(")")
            return found
        kind, value = self.words.pop(0)
        if kind == "number":
            return Const(int(value))
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1]))
        if kind == "name" and value in ("true", "false", "none"):
            return Const({"true": True, "false": False, "none": None}[value])
        if kind == "name" and value not in ("and", "or", "not", "in"):
            return Name(value)
        raise TemplateError(f"unexpected {value!r}" if value else "an expression ends early")


def parse(source: str, filters: dict = FILTERS) -> tuple:
    """A template's syntax tree: a tuple of nodes."""
    parts, at = [], 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        parts.append(("put", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    expression = lambda s: _Expression(s, filters).whole()

    def body(ends: tuple[str, ...]) -> tuple[tuple, str]:
        nodes = []
        while parts:
            kind, value = parts.pop(0)
            if kind == "text":
                nodes.append(Put(Const(value)))
            elif kind == "put":
                nodes.append(Put(expression(value)))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return tuple(nodes), value
                if word == "for":
                    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                    if m is None:
                        raise TemplateError(f"bad loop {value!r}")
                    nodes.append(For(m[1], expression(m[2]), body(("endfor",))[0]))
                elif word == "if":
                    nodes.append(branch(rest))
                elif word == "generation":
                    nodes.append(Generation(body(("endgeneration",))[0]))
                else:
                    raise TemplateError(f"unexpected tag {value!r}")
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return tuple(nodes), ""

    def branch(test: str) -> If:
        then, end = body(("elif", "else", "endif"))
        word, _, rest = end.partition(" ")
        other = (branch(rest),) if word == "elif" else body(("endif",))[0] if word == "else" else ()
        return If(expression(test), then, other)

    return body(())[0]


# -- Constant folding ----------------------------------------------------------


def _binary(op: str, a, b):
    if op == "+":
        return _text(a) + _text(b) if isinstance(a, str) or isinstance(b, str) else a + b
    return {"==": lambda: a == b, "!=": lambda: a != b, "in": lambda: a in b}[op]()


def _text(value) -> str:
    return "" if value is None else str(value)


def fold(node, filters: dict = FILTERS):
    """An expression with its constant parts worked out."""
    if isinstance(node, Unary):
        of = fold(node.of, filters)
        return Const(not of.value) if isinstance(of, Const) else Unary(of)
    if isinstance(node, Filtered):
        of = fold(node.of, filters)
        return Const(filters[node.name](_text(of.value))) if isinstance(of, Const) else Filtered(of, node.name)
    if isinstance(node, Item):
        return Item(fold(node.of, filters), fold(node.key, filters))
    if isinstance(node, Binary):
        a, b = fold(node.left, filters), fold(node.right, filters)
        if isinstance(a, Const) and node.op in ("and", "or"):
            return b if bool(a.value) == (node.op == "and") else a
        if isinstance(a, Const) and isinstance(b, Const):
            return Const(_binary(node.op, a.value, b.value))
        return Binary(node.op, a, b)
    return node


def fold_body(nodes: Iterable, filters: dict = FILTERS) -> tuple:
    """A body with constants folded, branches on them resolved and neighbouring
    texts joined."""
    out: list = []

    def add(node) -> None:
        if isinstance(node, Put) and isinstance(node.what, Const):
            text = _text(node.what.value)
            if out and isinstance(out[-1], Put) and isinstance(out[-1].what, Const):
                text = out.pop().what.value + text
            if text:
                out.append(Put(Const(text)))
        else:
            out.append(node)

    for node in nodes:
        if isinstance(node, Put):
            add(Put(fold(node.what, filters)))
        elif isinstance(node, For):
            add(For(node.name, fold(node.over, filters), fold_body(node.body, filters)))
        elif isinstance(node, Generation):
            add(Generation(fold_body(node.body, filters)))
        else:
            test, then, other = fold(node.test, filters), fold_body(node.then, filters), fold_body(node.other, filters)
            if isinstance(test, Const):
                for x in then if test.value else other:
                    add(x)
            else:
                add(If(test, then, other))
    return tuple(out)


# -- Closures ------------------------------------------------------------------


def _value(node, filters: dict) -> Callable[[dict], object]:
    """A closure from scope to an expression's value; unknown names are None."""
    if isinstance(node, Const):
        return lambda scope, value=node.value: value
    if isinstance(node, Name):
        return lambda scope, name=node.name: scope.get(name)
    if isinstance(node, Item):
        of, key = _value(node.of, filters), _value(node.key, filters)

        def item(scope):
            holder = of(scope)
            return holder.get(key(scope)) if isinstance(holder, dict) else None

        return item
    if isinstance(node, Unary):
        of = _value(node.of, filters)
        return lambda scope: not of(scope)
    if isinstance(node, Filtered):
        of, run = _value(node.of, filters), filters[node.name]
        return lambda scope: run(_text(of(scope)))
    left, right, op = _value(node.left, filters), _value(node.right, filters), node.op
    if op == "and":
        return lambda scope: left(scope) and right(scope)
    if op == "or":
        return lambda scope: left(scope) or right(scope)
    if op == "==":
        return lambda scope: left(scope) == right(scope)
    return lambda scope: _binary(op, left(scope), right(scope))


def _runner(nodes: tuple, generating: bool, filters: dict) -> Callable[[dict, Emit], None]:
    runs = [_node(n, generating, filters) for n in nodes]
    if len(runs) == 1:
        return runs[0]

    def run(scope: dict, emit: Emit) -> None:
        for r in runs:
            r(scope, emit)

    return run


def _node(node, generating: bool, filters: dict) -> Callable[[dict, Emit], None]:
    if isinstance(node, Put):
        value = _value(node.what, filters)
        return lambda scope, emit: emit(_text(value(scope)), generating)
    if isinstance(node, Generation):
        return _runner(node.body, True, filters)
    if isinstance(node, If):
        test, then, other = _value(node.test, filters), _runner(node.then, generating, filters), _runner(node.other, generating, filters)
        return lambda scope, emit: (then if test(scope) else other)(scope, emit)
    over, body, name = _value(node.over, filters), _runner(node.body, generating, filters), node.name

    def loop(scope: dict, emit: Emit) -> None:
        items = iter(over(scope) or ())
        here, i = next(items, loop), 0
        while here is not loop:
            after = next(items, loop)
            body(scope | {name: here, "loop": {"first": i == 0, "last": after is loop, "index0": i}}, emit)
            here, i = after, i + 1

    return loop


def compile_template(source: str, filters: dict = FILTERS) -> Callable[[dict, Emit], None]:
    """Source to a closure that renders variables, piece by piece."""
    return _runner(fold_body(parse(source, filters), filters), False, filters)


def render(source: str, **variables) -> tuple[str, list[tuple[int, int]]]:
    """A template's output and the stretches of it that the loss counts."""
    out, spans, at = [], [], 0

    def emit(text: str, generating: bool) -> None:
        nonlocal at
        if generating and text:
            spans.append((at, at + len(text)))
        out.append(text)
        at += len(text)

    compile_template(source)(variables, emit)
    return "".join(out), spans


# -- Reading back --------------------------------------------------------------


class TurnReader:
    """Turns read back from the house template's output, as it comes."""

    #: Begin, end and role of a turn; the last one fits any text.
    KINDS = (("<s>[INST] ", " [/INST]", "user"), ("<<SYS>>\n", "\n<</SYS>>", "system"), ("<role>", "</s>", None), ("", "</s>", "assistant"))

    def __init__(self, take: Callable[[str, str], None]):
        self.take, self.held = take, ""

    def feed(self, text: str) -> None:
        self.held += text
        while found := self._turn():
            self.take(*found)

    def _turn(self) -> tuple[str, str] | None:
        # The longest begin decides once so many characters are there.
        begin, end, role = next(k for k in self.KINDS if self.held.startswith(k[0]))
        if role == "assistant" and any(k[0].startswith(self.held) for k in self.KINDS[:3]):
            return None
        stop = self.held.find(end, len(begin))
        if stop < 0:
            return None
        text, self.held = self.held[len(begin) : stop], self.held[stop + len(end) :]
        if role is None:
            role, _, text = text.partition("</role>")
            role = unescape(role)
        return role, unescape(text)

    def close(self) -> None:
        if self.held:
            raise ValueError(f"a turn without an end: {self.held[:40]!r}")


class _Formatted:
    """A conversation as it is rendered and read back: its digests."""

    def __init__(self, render_into, conversation):
        self.conversation, self.turns, self.chars, self.loss_chars = conversation, 0, 0, 0
        self.turns_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()
        self._render, self._reader = render_into, TurnReader(self._turn)

    def _turn(self, role: str, text: str) -> None:
        self.turns += 1
        self.turns_sha.update(f"{role}\n{text}\n".encode())

    def _emit(self, text: str, generating: bool) -> None:
        self.chars += len(text)
        if generating:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss_sha.update(plain.encode())
        self._reader.feed(text)

    def run(self, messages: Iterator[dict]) -> tuple:
        self._render({"messages": messages}, self._emit)
        self._reader.close()
        return self.conversation, self.turns, self.turns_sha.hexdigest(), self.loss_chars, self.loss_sha.hexdigest(), self.chars


def formatted(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, all read back from the formatted output.

    Rows meet by conversation and stream through in order of turn, so the
    length of a conversation is not bounded by memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        render_into = compile_template(HOUSE)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(3)))

        def out(found: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=[id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        found = []
        for conversation, turns in groupby(rows(), key=lambda r: r[0]):
            found.append(_Formatted(render_into, conversation).run({"role": role, "text": text} for _, role, text in turns))
            if len(found) == 2000:
                yield out(found)
                found = []
        if found:
            yield out(found)

    rows = conversations.select(F.col(id_col).cast("long").alias(id_col), F.col(turn_col).alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"))
    ordered = rows.repartition(id_col).sortWithinPartitions(id_col, "turn", "role", "text").select(id_col, "role", "text")
    return ordered.mapInArrow(run, f"`{id_col}` long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
