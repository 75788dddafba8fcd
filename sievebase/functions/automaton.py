"""Patterns as finite automata, for those that a backtracking matcher could take exponential time with.

A pattern's tree becomes a nondeterministic automaton over a few classes of characters, and that a
deterministic one.  As a Column, a value is first rewritten with one mark per character that names its
class; a fold over the marks then walks a table of transitions.  Time is linear in the value's length
whatever the pattern.  Where the deterministic automaton would have more than MAX_STATES states, the fold
carries the set of nondeterministic states instead, which is slower by their number but linear as well.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import bound

MAX_STATES = 2_000
#: Largest nondeterministic automaton (nested repeats multiply).
MAX_NODES = 50_000
#: First of the private characters that mark classes.
_MARK = 0xE000


class TooLarge(ValueError):
    pass


@dataclass
class Automaton:
    """Edges of a nondeterministic automaton: state -> [(test, state)]; a test of None needs no character."""

    edges: list[list[tuple[tuple | None, int]]]
    start: int
    end: int


def build(tree) -> Automaton:
    """The automaton of a parsed pattern."""
    from .pattern import Choice, Literal, Range, Wild

    edges: list[list[tuple[tuple | None, int]]] = []

    def state() -> int:
        if len(edges) >= MAX_NODES:
            raise TooLarge("the pattern's repeats multiply to too many states")
        edges.append([])
        return len(edges) - 1

    def after(node, at: int) -> int:
        """The state behind ``node`` when it begins at state ``at``."""
        if isinstance(node, tuple):
            for item in node:
                at = after(item, at)
            return at
        if isinstance(node, Literal):
            for c in node.text:
                to = state()
                edges[at].append((("range", ord(c), ord(c)), to))
                at = to
            return at
        if isinstance(node, (Wild, Range)):
            if node == Wild("*"):
                loop = state()
                edges[at].append((None, loop))
                edges[loop].append((("any",), loop))
                return loop
            to = state()
            test = ("range", ord(node.low), ord(node.high)) if isinstance(node, Range) else {"+": ("any",), "@": ("letter",), "#": ("range", 48, 57)}[node.kind]
            edges[at].append((test, to))
            return to
        assert isinstance(node, Choice)
        out = state()
        for k in range(1, node.most + 1):
            to = state()
            for member in node.members:
                edges[after(member, at)].append((None, to))
            at = to
            if k >= node.least:
                edges[at].append((None, out))
        return out

    start = state()
    return Automaton(edges, start, after(tree, start))


def classes(a: Automaton) -> list[tuple[int, int]]:
    """Intervals of code points, rising and complete, in which no test tells characters apart."""
    borders = {0, 0x110000}
    for out in a.edges:
        for test, _ in out:
            for low, high in spans(test):
                borders |= {low, high + 1}
    borders = sorted(borders)
    return [(low, high - 1) for low, high in zip(borders, borders[1:], strict=False)]


def spans(test: tuple | None) -> list[tuple[int, int]]:
    if test is None or test == ("any",):
        return []
    return [(65, 90), (97, 122)] if test == ("letter",) else [test[1:]]


def passes(test: tuple, low: int) -> bool:
    return test == ("any",) or any(a <= low <= b for a, b in spans(test))


@dataclass
class Tables:
    """Classes that behave alike share a number; intervals of each, and for each state and class what follows."""

    kinds: list[list[tuple[int, int]]]
    step: list[list]  # [state][kind]
    accepts: list[bool]
    start: object


def closure(a: Automaton, states) -> frozenset[int]:
    seen, todo = set(states), list(states)
    while todo:
        for test, to in a.edges[todo.pop()]:
            if test is None and to not in seen:
                seen.add(to)
                todo.append(to)
    return frozenset(seen)


def kinds_of(a: Automaton) -> list[list[tuple[int, int]]]:
    """The intervals of :func:`classes`, those that pass the same tests together."""
    tests = sorted({t for out in a.edges for t, _ in out if t is not None})
    grouped: dict[tuple, list[tuple[int, int]]] = {}
    for low, high in classes(a):
        grouped.setdefault(tuple(passes(t, low) for t in tests), []).append((low, high))
    return list(grouped.values())


def deterministic(a: Automaton, most: int = MAX_STATES) -> Tables:
    kinds = kinds_of(a)
    moves = [[closure(a, [to for test, to in out if test is not None and passes(test, k[0][0])]) for k in kinds] for out in a.edges]
    first = closure(a, [a.start])
    number, order, step = {first: 0}, [first], []
    for states in order:  # grows while it is walked
        row = []
        active = [moves[s] for s in states if any(moves[s])]
        for k in range(len(kinds)):
            to = frozenset().union(*(m[k] for m in active))
            if to not in number:
                if len(order) >= most:
                    raise TooLarge("too many deterministic states")
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        step.append(row)
    return Tables(kinds, step, [a.end in s for s in order], 0)


def marked(c: Column, kinds: list[list[tuple[int, int]]]) -> Column:
    """Each character replaced by the private character that names its kind."""
    # what isn't of any but the largest kind goes first, so that no mark is taken for a character
    rest = max(range(len(kinds)), key=lambda k: sum(high - low for low, high in kinds[k]))
    named = [k for k in range(len(kinds)) if k != rest]

    def members(numbers) -> str:
        return "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for k in numbers for low, high in kinds[k])

    c = F.regexp_replace(c, f"[^{members(named)}]" if named else r"[\s\S]", chr(_MARK + rest))
    for k in named:
        c = F.regexp_replace(c, f"[{members([k])}]", chr(_MARK + k))
    return c


def accepted(c: Column, tree) -> Column:
    """True where the whole value matches the pattern's tree (null: null)."""
    a = build(tree)
    kinds = kinds_of(a)
    if any(low <= _MARK + k <= high and low == high for ks in kinds for low, high in ks for k in range(len(kinds))):
        raise TooLarge("the pattern names a private character that marks classes")
    marks = F.filter(F.split(marked(c, kinds), ""), lambda m: m != "")
    kind = lambda m: F.ascii(m) - _MARK
    try:
        t = deterministic(a)
    except TooLarge:
        return F.when(c.isNotNull(), _walked_as_sets(a, kinds, marks, kind))
    n = len(kinds)
    table = _constant([x for row in t.step for x in row])
    last = F.aggregate(marks, F.lit(0), lambda s, m: F.get(table, s * n + kind(m)))
    return F.when(c.isNotNull(), F.get(_constant([int(x) for x in t.accepts]), last) == 1)


def _constant(numbers: list[int]) -> Column:
    """An array constant, folded by the optimiser."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>")


def _walked_as_sets(a: Automaton, kinds, marks: Column, kind) -> Column:
    """The fold over sets of states: flags of which are open, and each state's predecessors by kind."""
    from collections import defaultdict

    n = len(a.edges)
    closures = [closure(a, [s]) for s in range(n)]
    before: dict[tuple[int, int], set[int]] = defaultdict(set)
    for s in range(n):
        for test, to in a.edges[s]:
            if test is not None:
                for k, intervals in enumerate(kinds):
                    if passes(test, intervals[0][0]):
                        for x in closures[to]:
                            before[x, k].add(s)
    text = ";".join(",".join(map(str, sorted(before[x, k]))) for k in range(len(kinds)) for x in range(n))
    lists = F.transform(F.split(F.lit(text), ";"), lambda x: F.filter(F.split(x, ","), lambda y: y != "").cast("array<int>"))
    first = closures[a.start]
    open_ = _constant([int(s in first) for s in range(n)])
    states = F.sequence(F.lit(0), F.lit(n - 1))

    def step(flags: Column, m: Column) -> Column:
        return F.transform(states, lambda x: F.exists(F.get(lists, kind(m) * n + x), lambda p: F.get(flags, p) == 1).cast("int"))

    return bound(F.aggregate(marks, open_, step), lambda flags: F.get(flags, F.lit(a.end)) == 1)
