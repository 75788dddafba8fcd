"""Criteria as an immutable tree, bound to a catalog and compiled to one boolean Column.

A leaf is *field op constant*.  A positive leaf on a repeated field is true when some occurrence passes.
Under a negation every leaf is made two-valued first, so a missing field counts as "not true" and
``NOT`` is a plain complement; elsewhere leaves stay bare, which lets the scan use them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pattern import Pattern
from ..functions.values import num_or_zero, num_to_str, number_of
from ..plans.catalog import FILE, RECNUM, Field, FileDef

if TYPE_CHECKING:
    from .sets import RecordSet

RANGES: dict[str, tuple[str, str]] = {"RANGE": ("GE", "LE"), "RANGE_GT_LE": ("GT", "LE"), "RANGE_GE_LT": ("GE", "LT"), "RANGE_GT_LT": ("GT", "LT")}
COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "EQ": lambda c, v: c == v, "GT": lambda c, v: c > v, "LT": lambda c, v: c < v, "GE": lambda c, v: c >= v, "LE": lambda c, v: c <= v,
}
PATTERNS = ("LIKE", "UNLIKE")
FIELD_OPS = (*COMPARE, *RANGES, *PATTERNS, "PRESENT")


class PredicateError(ValueError):
    pass


class Criteria:
    """A boolean expression over leaves; combine with ``&``, ``|`` and ``~``."""

    def __and__(self, other: "Criteria") -> "Criteria":
        return _joined(And, self, other)

    def __or__(self, other: "Criteria") -> "Criteria":
        return _joined(Or, self, other)

    def __invert__(self) -> "Criteria":
        return self.operand if isinstance(self, Not) else Not(self)

    def splice(self, other: "Criteria", how: str = "AND") -> "Criteria":
        return self & other if how == "AND" else self | other

    def leaves(self) -> list["Leaf"]:
        return [self] if isinstance(self, Leaf) else [x for k in self.children() for x in k.leaves()]

    def children(self) -> tuple["Criteria", ...]:
        return ()

    def dump(self, depth: int = 0) -> str:
        """The tree, one line per node."""
        head = str(self) if isinstance(self, Leaf) else type(self).__name__.upper()
        return "\n".join(["  " * depth + head, *(k.dump(depth + 1) for k in self.children())])


@dataclass(frozen=True)
class And(Criteria):
    operands: tuple[Criteria, ...]

    def children(self) -> tuple[Criteria, ...]:
        return self.operands


@dataclass(frozen=True)
class Or(Criteria):
    operands: tuple[Criteria, ...]

    def children(self) -> tuple[Criteria, ...]:
        return self.operands


@dataclass(frozen=True)
class Not(Criteria):
    operand: Criteria

    def children(self) -> tuple[Criteria, ...]:
        return (self.operand,)


def _joined(kind: type, a: Criteria, b: Criteria) -> Criteria:
    flat = [x for k in (a, b) for x in (k.operands if isinstance(k, kind) else (k,))]
    return kind(tuple(flat))


@dataclass(frozen=True)
class Leaf(Criteria):
    op: str
    field: str | None = None
    values: tuple = ()
    force: str | None = None  # NUM or ALPHA
    members: "RecordSet | None" = None

    def __str__(self) -> str:
        return " ".join(str(x) for x in (self.field, self.force, self.op, *self.values) if x is not None)


def where(field: str, op: str, *values: Any) -> Criteria:
    """``where("A", "GT", 3)``.  ``NOT_`` before an operator complements it, ``A_`` or ``N_`` compares as
    strings or as numbers."""
    name, force = op.upper(), None
    if name.startswith(("A_", "N_")):
        force, name = {"A": "ALPHA", "N": "NUM"}[name[0]], name[2:]
    negative = name.startswith("NOT_")
    name = name[4:] if negative else name
    name = "RANGE" if name == "RANGE_GE_LE" else name
    if name == "NE":
        negative, name = not negative, "EQ"
    if name not in FIELD_OPS:
        raise PredicateError(f"no operator {op}")
    wanted = 2 if name in RANGES else 0 if name == "PRESENT" else 1
    if len(values) != wanted:
        raise PredicateError(f"{op} takes {wanted} operands")
    leaf = Leaf(name, field, tuple(values), force)
    return Not(leaf) if negative else leaf


def point(n: int) -> Criteria:
    """Record numbers from ``n`` on (negative: from 0)."""
    return Leaf("POINT$", values=(max(0, n),))


def single_record(n: int) -> Criteria:
    return Leaf("SINGLEREC", values=(n,))


def file_is(name: str) -> Criteria:
    return Leaf("FILE$", values=(name,))


def in_set(members: "RecordSet") -> Criteria:
    return Leaf("SET$", members=members)


ALL = Leaf("ALLRECS")
NONE = Leaf("NORECS")


# --- binding -------------------------------------------------------------------------------------


def is_numeric(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def as_number(x: Any) -> float | int:
    """Operand of a numeric comparison; an invalid string counts as 0, by the rules that values are read by."""
    return x if is_numeric(x) else number_of(str(x)) or 0


def as_text(x: Any) -> str:
    if isinstance(x, float) and x.is_integer() and abs(x) < 1e15:
        return str(int(x))
    return str(x)


def compares_numbers(f: Field, leaf: Leaf) -> bool:
    """The comparison-type rule: index type first, then the forcing, then the operand's type."""
    if leaf.op in PATTERNS:
        return False
    if f.index == "CHAR":
        return leaf.force == "NUM"
    if f.index == "NUM":
        return leaf.force != "ALPHA"
    return leaf.force == "NUM" or (leaf.force is None and bool(leaf.values) and is_numeric(leaf.values[0]))


def occurrence_test(f: Field, leaf: Leaf, kind: T.DataType) -> Callable[[Column], Column]:
    """The test of one occurrence, with operands typed so that no cast lands on the column."""
    if isinstance(kind, (T.TimestampType, T.DateType, T.BooleanType)) and leaf.op not in PATTERNS:
        operands = [F.lit(v) if isinstance(v, (date, datetime, bool)) else F.lit(str(v)).cast(kind) for v in leaf.values]
        convert = lambda c: c
    elif compares_numbers(f, leaf):
        numeric = isinstance(kind, T.NumericType)
        whole = isinstance(kind, T.IntegralType)
        operands = [F.lit(int(n)) if whole and float(n).is_integer() else F.lit(float(n)) for n in map(as_number, leaf.values)]
        convert = (lambda c: c) if numeric else num_or_zero
    else:
        operands = [as_text(v) for v in leaf.values]
        convert = (lambda c: c) if isinstance(kind, T.StringType) else (lambda c: num_to_str(c)) if isinstance(kind, T.NumericType) else (lambda c: c.cast("string"))
    if leaf.op in PATTERNS:
        pattern = Pattern.of(as_text(leaf.values[0]))
        return lambda c: pattern.matches(convert(c)) if leaf.op == "LIKE" else ~pattern.matches(convert(c))
    if leaf.op in RANGES:
        low, high = (COMPARE[x] for x in RANGES[leaf.op])
        return lambda c: low(convert(c), operands[0]) & high(convert(c), operands[1])
    return lambda c: COMPARE[leaf.op](convert(c), operands[0])


class Binder:
    """Compiles criteria for one file (or aligned group) and remembers the sets they refer to."""

    def __init__(self, file: FileDef, frame: DataFrame):
        self.file, self.frame = file, frame
        self.sets: list[tuple[RecordSet, str]] = []

    def column(self, node: Criteria, two_valued: bool = False) -> Column:
        if isinstance(node, Not):
            return ~self.column(node.operand, True)
        if isinstance(node, (And, Or)):
            out = self.column(node.operands[0], two_valued)
            for k in node.operands[1:]:
                out = out & self.column(k, two_valued) if isinstance(node, And) else out | self.column(k, two_valued)
            return out
        leaf = self.leaf(node)
        return F.coalesce(leaf, F.lit(False)) if two_valued and self.can_be_null(node) else leaf

    def can_be_null(self, leaf: Leaf) -> bool:
        return leaf.field is not None and leaf.op != "PRESENT"

    def leaf(self, leaf: Leaf) -> Column:
        if leaf.op in ("ALLRECS", "NORECS"):
            return F.lit(leaf.op == "ALLRECS")
        if leaf.op == "POINT$":
            return F.col(RECNUM) >= leaf.values[0]
        if leaf.op == "SINGLEREC":
            return F.lit(False) if leaf.values[0] < 0 else F.col(RECNUM) == leaf.values[0]
        if leaf.op == "FILE$":
            return F.col(FILE) == leaf.values[0]
        if leaf.op == "SET$":
            name = f"_in_set_{len(self.sets)}"
            self.sets.append((leaf.members, name))
            return F.coalesce(F.col(name), F.lit(False))
        f = self.file.field(leaf.field)
        if f.storage == "INVISIBLE":
            raise PredicateError(f"{f.name} is invisible: use the entries of its index")
        c = F.col(f"`{f.name}`")
        kind = self.frame.schema[f.name].dataType
        if isinstance(kind, T.ArrayType):
            if leaf.op == "PRESENT":
                return F.coalesce(F.size(c), F.lit(0)) > 0
            return F.exists(c, occurrence_test(f, leaf, kind.elementType))
        return c.isNotNull() if leaf.op == "PRESENT" else occurrence_test(f, leaf, kind)(c)


def set_conjuncts(node: Criteria) -> tuple[list[tuple["RecordSet", bool]], Criteria | None]:
    """Set criteria that stand at the top of an AND, with their sign, and the criteria that remain.

    The former become semi and anti joins; a set below an OR needs a membership flag instead.
    """
    parts = list(node.operands) if isinstance(node, And) else [node]
    sets, rest = [], []
    for p in parts:
        inner = p.operand if isinstance(p, Not) else p
        if isinstance(inner, Leaf) and inner.op == "SET$":
            sets.append((inner.members, not isinstance(p, Not)))
        else:
            rest.append(p)
    remaining = None if not rest else rest[0] if len(rest) == 1 else And(tuple(rest))
    return sets, remaining
