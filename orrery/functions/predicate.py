"""Predicates: AND/OR trees of comparisons over records, compiled to Spark columns and rendered as SQL, CQL, CDDL or text.

The logic has two values. A missing field equals NULL and differs from anything else; it is never
ordered, and contains nothing. Type families do not mix: text against a number is unequal and never
ordered. NaN equals nothing and is not ordered. A list in MATCHES or IN is satisfied by any of its
values; EQ and NE take one value. MATCHES is plain containment, so ``%`` and ``_`` stand for themselves.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Literal = int | float | str | bool | bytes | None
#: Operators by name, with the text and the SQL sign of each.
OPS = {"gt": ">", "lt": "<", "eq": "=", "ne": "!=", "ge": ">=", "le": "<=", "in": "IN", "matches": "MATCHES"}
MAX_CHILDREN = 255


@dataclass(frozen=True)
class Pred:
    """One comparison: a field by name or by position, an operator, and its values."""

    field: str | int
    op: str
    values: tuple[Literal, ...]

    def __post_init__(self) -> None:
        if self.op not in OPS:
            raise ValueError(f"unknown operator {self.op!r}")
        if self.op in ("eq", "ne", "gt", "lt", "ge", "le") and len(self.values) != 1:
            raise ValueError(f"{self.op} takes one value; several are for in")


@dataclass(frozen=True)
class Node:
    """All (and) or any (or) of the children; all of none is true, any of none is false."""

    kind: str
    children: tuple["Pred | Node", ...]

    def __post_init__(self) -> None:
        if self.kind not in ("and", "or") or len(self.children) > MAX_CHILDREN:
            raise ValueError(f"a node is and/or with {MAX_CHILDREN} children at most")


def all_of(*children: Pred | Node) -> Node:
    return Node("and", children)


def any_of(*children: Pred | Node) -> Node:
    return Node("or", children)


def _family(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(kind, T.BinaryType):
        return "bytes"
    return "number" if isinstance(kind, T.NumericType) else "other"


def _value_family(v: Literal) -> str:
    return "null" if v is None else "bool" if isinstance(v, bool) else "text" if isinstance(v, str) else "bytes" if isinstance(v, bytes) else "number"


def _compare(c: Column, family: str, kind: T.DataType, op: str, v: Literal) -> Column:
    other = _value_family(v)
    if op == "matches":
        if family != other or family not in ("text", "bytes"):
            return F.lit(False)
        return F.coalesce(F.contains(c, F.lit(v)), F.lit(False))
    if op in ("eq", "ne"):
        if other == "null":
            same = c.isNull()
        elif family != other or isinstance(v, float) and v != v:
            same = F.lit(False)
        else:
            same = c.eqNullSafe(F.lit(v))
        return ~same if op == "ne" else same
    if family != other or family not in ("number", "text"):
        return F.lit(False)
    x = F.lit(v)
    test = {"gt": c > x, "lt": c < x, "ge": c >= x, "le": c <= x}[op]
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        test = test & ~F.isnan(c)
    return F.coalesce(test, F.lit(False))


def to_column(p: Pred | Node, schema: T.StructType) -> Column:
    """The predicate as a Boolean column that is never null. Fields the schema lacks are missing in every record: what follows from that is settled here."""
    if isinstance(p, Node):
        parts = [to_column(c, schema) for c in p.children]
        return reduce(and_ if p.kind == "and" else or_, parts) if parts else F.lit(p.kind == "and")
    name = schema.names[p.field] if isinstance(p.field, int) and p.field < len(schema) else p.field
    if name not in schema.names:
        missing = {"eq": p.values[0] is None, "ne": p.values[0] is not None, "in": None in p.values} if p.values else {}
        return F.lit(bool(missing.get(p.op, False)))
    kind = schema[name].dataType
    tests = [_compare(F.col(f"`{name}`"), _family(kind), kind, "eq" if p.op == "in" else p.op, v) for v in p.values]
    return reduce(or_, tests) if tests else F.lit(False)


def fields(p: Pred | Node) -> list[str | int]:
    """Every field that a predicate reads, once per comparison."""
    return [p.field] if isinstance(p, Pred) else [f for c in p.children for f in fields(c)]


def leaves(p: Pred | Node) -> list[Pred]:
    return [p] if isinstance(p, Pred) else [x for c in p.children for x in leaves(c)]


def fingerprint(p: Pred | Node) -> str:
    """The predicate's structure without its values: equal for predicates that differ in values alone."""
    if isinstance(p, Pred):
        return f"{p.field} {OPS[p.op]} ?"
    return f"({f' {p.kind.upper()} '.join(map(fingerprint, p.children))})"


def _sql_value(v: Literal) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, bytes):
        return f"X'{v.hex()}'"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def _name(f: str | int) -> str:
    return f"field_{f}" if isinstance(f, int) else f


def to_sql(p: Pred | Node) -> str:
    """ANSI SQL with the same two-valued logic, for fields and values of one family."""
    if isinstance(p, Node):
        return "(" + f" {p.kind.upper()} ".join(map(to_sql, p.children)) + ")" if p.children else ("TRUE" if p.kind == "and" else "FALSE")
    f, v = _name(p.field), [_sql_value(x) for x in p.values]
    if p.op == "eq":
        return f"{f} IS NOT DISTINCT FROM {v[0]}"
    if p.op == "ne":
        return f"{f} IS DISTINCT FROM {v[0]}"
    if p.op == "in":
        return "(" + " OR ".join(f"{f} IS NOT DISTINCT FROM {x}" for x in v) + ")" if v else "FALSE"
    if p.op == "matches":
        return "(" + " OR ".join(f"coalesce(position({x} IN {f}) > 0, FALSE)" for x in v) + ")" if v else "FALSE"
    return f"coalesce({f} {OPS[p.op]} {v[0]}, FALSE)"


def to_cql(p: Pred | Node) -> str:
    """CQL's WHERE clause; it has no OR and no containment."""
    if isinstance(p, Node):
        if p.kind == "or" and len(p.children) > 1:
            raise ValueError("CQL has no OR")
        return " AND ".join(map(to_cql, p.children))
    if p.op == "matches":
        return f"{_name(p.field)} LIKE {_sql_value('%' + str(p.values[0]) + '%')}"
    if p.op == "in":
        return f"{_name(p.field)} IN ({', '.join(map(_sql_value, p.values))})"
    return f"{_name(p.field)} {OPS[p.op]} {_sql_value(p.values[0])}"


def to_cddl(p: Pred | Node) -> str:
    """A CDDL group that describes the predicate."""
    if isinstance(p, Node):
        return f"{{ {p.kind}: [{', '.join(map(to_cddl, p.children))}] }}"
    value = {"null": "null", "bool": "bool", "text": "tstr", "bytes": "bstr", "number": "number"}[_value_family(p.values[0] if p.values else None)]
    return f'{{ field: "{_name(p.field)}", op: "{p.op}", comparands: [+ {value}] }}'


def display(p: Pred | Node) -> str:
    """The text form that parse() reads."""
    if isinstance(p, Node):
        return "(" + f" {p.kind.upper()} ".join(map(display, p.children)) + ")" if p.children else f"({p.kind.upper()})"
    f = f"[{p.field}]" if isinstance(p.field, int) else p.field
    if p.op in ("in", "matches"):
        return f"{f} {OPS[p.op]} ({', '.join(map(_sql_value, p.values))})"
    return f"{f} {OPS[p.op]} {_sql_value(p.values[0])}"


_TOKEN = re.compile(r"\s*(?:(?P<num>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<bytes>[xX]'[0-9a-fA-F]*')|(?P<str>'(?:[^']|'')*')|(?P<op><=|>=|!=|<>|=|<|>)|(?P<word>[A-Za-z_][\w.]*)|(?P<sign>[()\[\],]))")


def parse(text: str) -> Pred | Node:
    """A predicate from its text form; AND binds closer than OR."""
    tokens, at = [], 0
    while text[at:].strip():
        if not (m := _TOKEN.match(text, at)):
            raise ValueError(f"cannot read {text[at:]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    i = 0

    def peek() -> tuple[str, str]:
        return tokens[i]

    def take(want: str | None = None) -> tuple[str, str]:
        nonlocal i
        t = tokens[i]
        if want is not None and t[1].upper() != want:
            raise ValueError(f"{want} expected, {t[1]!r} found")
        i += 1
        return t

    def value() -> Literal:
        kind, s = take()
        if kind == "num":
            return float(s) if re.search(r"[.eE]", s) else int(s)
        if kind == "str":
            return s[1:-1].replace("''", "'")
        if kind == "bytes":
            return bytes.fromhex(s[2:-1])
        if kind == "word" and s.upper() in ("NULL", "TRUE", "FALSE"):
            return {"NULL": None, "TRUE": True, "FALSE": False}[s.upper()]
        raise ValueError(f"a value expected, {s!r} found")

    def leaf() -> Pred | Node:
        kind, s = take()
        if s == "(":
            if peek()[1].upper() in ("AND", "OR") and tokens[i + 1][1] == ")":
                k = take()[1].lower()
                take(")")
                return Node(k, ())
            inner = disjunction()
            take(")")
            return inner
        if s == "[":
            field: str | int = int(take()[1])
            take("]")
        elif kind == "word":
            field = s
        else:
            raise ValueError(f"a field expected, {s!r} found")
        sign = take()[1].upper()
        sign = "!=" if sign == "<>" else sign
        op = next((k for k, v in OPS.items() if v == sign), None)
        if op is None:
            raise ValueError(f"an operator expected, {sign!r} found")
        if op not in ("in", "matches"):
            return Pred(field, op, (value(),))
        if peek()[1] != "(":
            return Pred(field, op, (value(),))
        take("(")
        values = [value()]
        while peek()[1] == ",":
            take()
            values.append(value())
        take(")")
        return Pred(field, op, tuple(values))

    def joined(word: str, part) -> Pred | Node:
        parts = [part()]
        while peek()[1].upper() == word:
            take()
            parts.append(part())
        return parts[0] if len(parts) == 1 else Node(word.lower(), tuple(parts))

    def conjunction() -> Pred | Node:
        return joined("AND", leaf)

    def disjunction() -> Pred | Node:
        return joined("OR", conjunction)

    out = disjunction()
    take("")
    return out


def label_matches(c: Column, label: str) -> Column:
    """Whether a comma-separated list of labels has this one."""
    return F.coalesce(F.array_contains(F.transform(F.split(c, ","), lambda x: F.trim(x)), label), F.lit(False))
