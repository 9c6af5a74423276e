"""The filter language: lexer, parser and compiler to a Column.

    octets > 1000 and (proto in [6, 17] or not name contains 'ab')

Numbers are unsigned 64-bit; strings have no escapes; ``=`` is ``==`` and ``!`` is ``not``. Logic is
two-valued: a comparison with a missing field or a null is false, also ``!=``, so ``not`` of it is
true. Negations are moved to the leaves, and a negated leaf is closed with ``coalesce(.., false)``
first. Other leaves stay bare, as a filter takes null for false anyway, so they reach the scan.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegralType, StringType

from ..functions.columns import BUILTINS, u64_image

MAX_TOKENS, MAX_DEPTH = 4096, 128


class FilterError(ValueError):
    """A filter that can't be read, or a limit that it exceeds."""


@dataclass(frozen=True)
class Compare:
    field: object
    op: str
    value: int | str


@dataclass(frozen=True)
class Contains:
    field: object
    needle: str


@dataclass(frozen=True)
class InSet:
    field: object
    values: tuple


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Const:
    """True or false; the grammar has no word for it, so only trees built in code hold one."""

    value: bool


@dataclass(frozen=True)
class Call:
    """A builtin on the left side; an extension that is off unless asked for."""

    name: str
    args: tuple


TOKEN = re.compile(
    r"""\s*(?:(?P<punct>[()\[\],])|(?P<op>==|!=|<=|>=|=|<|>|!)|(?P<str>'[^']*'|"[^"]*")"""
    r"""|(?P<num>0x[0-9a-fA-F]+|\d+)|(?P<name>[A-Za-z_][A-Za-z0-9_.]*)|(?P<end>\Z)|(?P<bad>.))""",
    re.DOTALL,
)
WORDS = {"and": "and", "AND": "and", "or": "or", "OR": "or", "not": "not", "NOT": "not", "contains": "contains", "in": "in"}


def tokenize(text: str) -> list[tuple[str, object]]:
    """(kind, value) pairs, an ``end`` last."""
    out: list[tuple[str, object]] = []
    for m in TOKEN.finditer(text):
        kind, raw = m.lastgroup, m[m.lastgroup]
        if kind == "bad":
            raise FilterError(f"unexpected {raw!r} at {m.start(kind)}")
        if kind == "num":
            value = int(raw, 16) if raw.startswith("0x") else int(raw)
            if value >> 64:
                raise FilterError("number over 64 bits")
            out.append(("num", value))
        elif kind == "str":
            out.append(("str", raw[1:-1]))
        elif kind == "name":
            out.append((WORDS[raw], raw) if raw in WORDS else ("name", raw))
        elif raw == "!":
            out.append(("not", raw))
        elif kind == "op":
            out.append(("op", "==" if raw == "=" else raw))
        else:
            out.append((raw or "end", raw))
        if len(out) > MAX_TOKENS + 1:
            raise FilterError("too many tokens")
        if kind == "end":
            break
    return out


class _Parser:
    def __init__(self, text: str, calls: bool):
        self.tokens, self.at, self.calls = tokenize(text), 0, calls

    def peek(self) -> str:
        return self.tokens[self.at][0]

    def take(self, kind: str | None = None):
        found, value = self.tokens[self.at]
        if kind and found != kind:
            raise FilterError(f"expected {kind}, found {value or 'the end'!r}")
        self.at += 1
        return value

    def chain(self, word: str, node: type, part):
        parts = [part()]
        while self.peek() == word:
            self.take()
            parts.append(part())
        return parts[0] if len(parts) == 1 else node(tuple(parts))

    def either(self):
        return self.chain("or", Or, self.both)

    def both(self):
        return self.chain("and", And, self.unary)

    def unary(self):
        negations = 0
        while self.peek() == "not":
            self.take()
            negations += 1
            if negations > MAX_TOKENS:
                raise FilterError("too deep")
        if self.peek() == "(":
            self.take()
            inner = self.either()
            self.take(")")
        else:
            inner = self.leaf()
        return Not(inner) if negations % 2 else inner

    def literal(self):
        if self.peek() not in ("num", "str"):
            raise FilterError("expected a number or a string")
        return self.take()

    def operand(self):
        name = self.take("name")
        if self.calls and self.peek() == "(":
            self.take()
            args = [self.argument()]
            while self.peek() == ",":
                self.take()
                args.append(self.argument())
            self.take(")")
            if name not in BUILTINS or BUILTINS[name][0] != len(args):
                raise FilterError(f"no builtin {name} of {len(args)} arguments")
            return Call(name, tuple(args))
        return name

    def argument(self):
        return self.take() if self.peek() == "num" else self.operand()

    def leaf(self):
        field = self.operand()
        if self.peek() == "contains":
            self.take()
            return Contains(field, self.take("str"))
        if self.peek() == "in":
            self.take()
            self.take("[")
            values = [self.literal()]
            while self.peek() == ",":
                self.take()
                values.append(self.literal())
            self.take("]")
            return InSet(field, tuple(values))
        if self.peek() != "op":
            raise FilterError("expected a comparison")
        return Compare(field, self.take(), self.literal())


def parse(text: str, calls: bool = False):
    """The syntax tree; ``calls`` allows builtins on the left of a comparison."""
    parser = _Parser(text, calls)
    try:
        tree = parser.either()
    except RecursionError as e:
        raise FilterError("too deep") from e
    parser.take("end")
    return tree


def _children(node) -> tuple:
    if isinstance(node, (And, Or)):
        return node.parts
    return (node.part,) if isinstance(node, Not) else ()


def fold(node):
    """An equal tree without needless nodes: negated constants and negations are resolved, a constant that
    decides an and or an or takes its place, one that doesn't is dropped, and so are chains of one part."""
    if isinstance(node, Not):
        part = fold(node.part)
        if isinstance(part, Const):
            return Const(not part.value)
        return part.part if isinstance(part, Not) else Not(part)
    if isinstance(node, (And, Or)):
        decides = isinstance(node, Or)
        parts = [fold(p) for p in node.parts]
        if any(isinstance(p, Const) and p.value == decides for p in parts):
            return Const(decides)
        parts = [p for p in parts if not isinstance(p, Const)]
        if not parts:
            return Const(not decides)
        return parts[0] if len(parts) == 1 else type(node)(tuple(parts))
    return node


def node_count(node) -> int:
    return 1 + sum(map(node_count, _children(node)))


def fields(node) -> list:
    """Field references in order, repeats included."""
    if isinstance(node, Const):
        return []
    inner = _children(node)
    return [f for c in inner for f in fields(c)] if inner else [node.field]


def cost(text: str) -> int:
    """The number of field references."""
    return len(fields(parse(text)))


def depth(node, binary: bool = False) -> int:
    """Levels of the tree; with ``binary``, as if every chain were nested to the left."""
    inner = [depth(c, binary) for c in _children(node)]
    if not inner:
        return 1
    if not binary or isinstance(node, Not):
        return 1 + max(inner)
    n = len(inner)
    return max(d + (n - max(i, 1)) for i, d in enumerate(inner))


COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


class _Compiler:
    def __init__(self, columns: Mapping[str, Column], kinds: Mapping[str, str]):
        self.columns, self.kinds = columns, kinds

    def value(self, field) -> tuple[Column, str] | None:
        if isinstance(field, int):
            return F.lit(_signed(field)).cast("long"), "int"
        if isinstance(field, Call):
            args = [self.value(a) for a in field.args]
            if any(a is None or a[1] != "int" for a in args):
                return None
            return BUILTINS[field.name][1](*[a[0] for a in args]), "int"
        return (self.columns[field], self.kinds[field]) if field in self.columns else None

    def image(self, found: tuple[Column, str]) -> Column:
        column, kind = found
        return u64_image(column.cast("long")) if kind == "int" else column.cast("binary")

    def leaf(self, node) -> Column:
        found = self.value(node.field)
        if found is None:
            return F.lit(False)
        if isinstance(node, Contains):
            test = F.contains(self.image(found), F.lit(node.needle.encode()))
        elif isinstance(node, InSet):
            if found[1] == "int" and all(isinstance(v, int) for v in node.values):
                test = found[0].cast("long").isin(*[_signed(v) for v in node.values])
            else:
                test = reduce(operator.or_, (self.compare(found, "==", v) for v in node.values))
        else:
            test = self.compare(found, node.op, node.value)
        return test

    def compare(self, found: tuple[Column, str], op: str, value: int | str) -> Column:
        if found[1] == "int" and isinstance(value, int):
            left, right = found[0].cast("long"), F.lit(_signed(value)).cast("long")
            if value >> 63 and op not in ("==", "!="):  # beyond a long: compare as unsigned bytes
                return COMPARE[op](u64_image(left), F.lit(value.to_bytes(8, "big")))
            return COMPARE[op](left, right)
        image = value.to_bytes(8, "big") if isinstance(value, int) else value.encode()
        return COMPARE[op](self.image(found), F.lit(image))

    def compile(self, node, positive: bool = True) -> Column:
        if isinstance(node, Const):
            return F.lit(node.value == positive)
        if isinstance(node, Not):
            return self.compile(node.part, not positive)
        if isinstance(node, (And, Or)):
            parts = [self.compile(p, positive) for p in node.parts]
            join = operator.and_ if isinstance(node, And) == positive else operator.or_
            while len(parts) > 1:  # balanced, so that long chains stay shallow
                parts = [reduce(join, parts[i : i + 2]) for i in range(0, len(parts), 2)]
            return parts[0]
        return self.leaf(node) if positive else ~F.coalesce(self.leaf(node), F.lit(False))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


#: Names of the language for columns of a flow table.
FLOW_FIELDS = ("octets", "packets", "records", "src", "dst", "sport", "dport", "proto", "flow_id", "template", "first_ms", "last_ms")


def flow_columns(df: DataFrame) -> dict[str, Column]:
    names = {f: ("template_id" if f == "template" else f) for f in FLOW_FIELDS}
    return {f: df[c] for f, c in names.items() if c in df.columns}


def compile_filter(text, df: DataFrame, columns: Mapping[str, Column] | None = None, calls: bool = False, compat: bool = False, value: bool = False) -> Column:
    """A predicate for ``df``; with ``value``, one that is false where it would be null.

    ``text`` is the language's text, or a tree of its nodes.

    ``columns`` maps the language's names to columns; by default every integral, string or binary
    column goes by its own name. Names that are not there are missing fields. A tree deeper than
    MAX_DEPTH raises; with ``compat`` it matches nothing, counted with chains nested to the left.
    """
    tree = fold(parse(text, calls) if isinstance(text, str) else text)
    if depth(tree, binary=compat) > MAX_DEPTH:
        if compat:
            return F.lit(False)
        raise FilterError("too deep")
    found = dict(columns) if columns is not None else {c: df[c] for c in df.columns}
    kinds = {}
    for name, kind in zip(found, df.select(*[c.alias(n) for n, c in found.items()]).schema.fields, strict=True) if found else ():
        if isinstance(kind.dataType, IntegralType):
            kinds[name] = "int"
        elif isinstance(kind.dataType, (StringType, BinaryType)):
            kinds[name] = "bytes"
    predicate = _Compiler({n: found[n] for n in kinds}, kinds).compile(tree)
    return F.coalesce(predicate, F.lit(False)) if value else predicate
