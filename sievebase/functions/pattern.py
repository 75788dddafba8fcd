"""The pattern language: parsed to a small tree, then written as a Java regular expression.

Tokens: ``*`` any run, ``+`` any character, ``@`` a letter, ``#`` a digit, ``(a,b)`` alternatives
(``,`` also at the top), ``/n(list)`` and ``/n-m(list)`` repetition, ``x-y`` a range of characters as
a whole member of a list, ``!c`` the character c itself, ``=hh`` a character by its hex code, and the
prefix ``NOCASE:``.  A pattern must match the whole string.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .automaton import accepted
from .values import nocase

NOCASE = "NOCASE:"
#: Largest repeat count (our choice).
MAX_REPEAT = 255
_SPECIAL = set("*+@#(),/-!=")


class PatternError(ValueError):
    def __init__(self, what: str, position: int):
        super().__init__(f"{what} at position {position}")
        self.position = position


@dataclass(frozen=True)
class Literal:
    text: str


@dataclass(frozen=True)
class Wild:
    kind: str  # one of * + @ #


@dataclass(frozen=True)
class Range:
    low: str
    high: str


@dataclass(frozen=True)
class Choice:
    members: tuple[tuple, ...]
    least: int = 1
    most: int = 1


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        c = self.peek()
        self.at += 1
        return c

    def members(self, nested: bool) -> Choice:
        out = [self.member(nested)]
        while self.peek() == ",":
            self.at += 1
            out.append(self.member(nested))
        return Choice(tuple(out))

    def member(self, nested: bool) -> tuple:
        start = self.at
        if nested and (found := self.range()):
            return (found,)
        self.at = start
        items: list = []
        while (c := self.peek()) and c not in ",)":
            if c in "*+@#":
                self.at += 1
                items.append(Wild(c))
            elif c == "(":
                items.append(self.group())
            elif c == "/":
                items.append(self.repeat())
            elif c == "-":
                raise PatternError("a stand-alone '-'", self.at)
            else:
                x = self.character()
                if items and isinstance(items[-1], Literal):
                    items[-1] = Literal(items[-1].text + x)
                else:
                    items.append(Literal(x))
        if self.peek() == ")" and not nested:
            raise PatternError("an unmatched ')'", self.at)
        return tuple(items)

    def range(self) -> Range | None:
        """``x-y`` if that is the whole member."""
        if not self.peek() or self.peek() in _SPECIAL - {"!", "="}:
            return None
        low = self.character()
        if self.peek() != "-":
            return None
        where = self.at
        self.at += 1
        if not self.peek() or self.peek() in _SPECIAL - {"!", "="}:
            raise PatternError("a range without an end", where)
        high = self.character()
        if self.peek() not in (",", ")"):
            raise PatternError("a range that is not a whole member", where)
        if low >= high:
            raise PatternError("a range that does not rise", where)
        return Range(low, high)

    def character(self) -> str:
        where, c = self.at, self.take()
        if c == "!":
            if not self.peek():
                raise PatternError("an escape of nothing", where)
            return self.take()
        if c == "=":
            digits = self.text[self.at : self.at + 2]
            if not re.fullmatch("[0-9A-Fa-f]{2}", digits):
                raise PatternError("a bad hex code", where)
            self.at += 2
            return chr(int(digits, 16))
        return c

    def group(self) -> Choice:
        where = self.at
        self.at += 1
        inner = self.members(nested=True)
        if self.take() != ")":
            raise PatternError("an unmatched '('", where)
        return inner

    def repeat(self) -> Choice:
        where = self.at
        m = re.compile(r"/([0-9]+)(?:-([0-9]+))?(?=\()").match(self.text, self.at)
        if not m:
            raise PatternError("a bad repeat count", where)
        least, most = int(m[1]), int(m[2] or m[1])
        if m[2] and most <= least or most > MAX_REPEAT or most == 0:
            raise PatternError("a bad repeat count", where)
        self.at = m.end()
        return Choice(self.group().members, least, most)


def parse(pattern: str) -> Choice:
    parser = _Parser(pattern)
    return parser.members(nested=False)


def _quoted(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z_\s])", r"\\\1", text) if text.isascii() else "".join(f"\\x{{{ord(c):x}}}" for c in text)


def _char(c: str) -> str:
    return f"\\x{{{ord(c):x}}}"


def to_regex(node: Choice | tuple | Literal | Wild | Range) -> str:
    if isinstance(node, Literal):
        return _quoted(node.text)
    if isinstance(node, Wild):
        return {"*": ".*", "+": ".", "@": "[A-Za-z]", "#": "[0-9]"}[node.kind]
    if isinstance(node, Range):
        return f"[{_char(node.low)}-{_char(node.high)}]"
    if isinstance(node, tuple):
        return "".join(map(to_regex, node))
    body = "(?:" + "|".join(to_regex(m) for m in node.members) + ")"
    return body if (node.least, node.most) == (1, 1) else f"{body}{{{node.least},{node.most}}}"


def flexible(node: Choice | tuple | Literal | Wild | Range) -> bool:
    """Whether strings of different lengths match."""
    if isinstance(node, Literal | Range):
        return False
    if isinstance(node, Wild):
        return node.kind == "*"
    if isinstance(node, tuple):
        return any(map(flexible, node))
    return node.least != node.most or any(map(flexible, node.members)) or len({length(m) for m in node.members}) > 1


def length(node: Choice | tuple | Literal | Wild | Range) -> int:
    """The length of the strings that match a node that isn't flexible (0 of one that is)."""
    if isinstance(node, Literal):
        return len(node.text)
    if isinstance(node, Wild | Range):
        return 1
    if isinstance(node, tuple):
        return sum(map(length, node))
    return node.most * length(node.members[0])


def ambiguous(tree: Choice) -> bool:
    """Whether some text could be divided among the parts in so many ways that backtracking is slow: a flexible
    member under a repeat, or three flexible parts in a row of which none is the last."""

    def repeated(node) -> bool:
        if isinstance(node, tuple):
            return any(map(repeated, node))
        if isinstance(node, Choice):
            return node.most > 1 and flexible(Choice(node.members)) or any(map(repeated, node.members))
        return False

    def parts(node) -> int:
        if isinstance(node, tuple):
            return sum(map(parts, node))
        return max(map(parts, node.members), default=0) + (node.least != node.most) if isinstance(node, Choice) else int(flexible(node))

    return repeated(tree) or any(parts(m[:-1] if m and m[-1] == Wild("*") else m) > 2 for m in tree.members)


@dataclass(frozen=True)
class Pattern:
    """A parsed pattern and how to apply it to a column."""

    source: str
    fold: bool
    tree: Choice

    @staticmethod
    def of(source: str) -> "Pattern":
        fold = source.startswith(NOCASE)
        body = source[len(NOCASE) :] if fold else source
        if fold:
            body = re.sub("[a-z]+", lambda m: m[0].upper(), body)
        return Pattern(source, fold, parse(body))

    @property
    def regex(self) -> str:
        """Java expression for ``rlike``; it is a find, so both ends are tied."""
        return rf"(?s)\A{to_regex(self.tree)}\z"

    def single(self) -> tuple | None:
        return self.tree.members[0] if len(self.tree.members) == 1 else None

    def prefix(self) -> str:
        """Literal that every match begins with."""
        only = self.single()
        return only[0].text if only and isinstance(only[0], Literal) else ""

    def matches(self, c: Column) -> Column:
        """True where the whole value matches.

        Literal, prefix, suffix and substring patterns become comparisons the scan can push down; a
        literal prefix before anything else is given as well, to prune with.  Anything that a backtracking
        matcher could take more than quadratic time with is matched by an automaton.
        """
        c = nocase(c) if self.fold else c
        only, run = self.single(), Wild("*")
        if only is not None:
            texts = [x.text for x in only if isinstance(x, Literal)]
            shape = tuple("*" if x == run else "t" if isinstance(x, Literal) else "?" for x in only)
            if shape == ():
                return c == ""
            if shape == ("t",):
                return c == texts[0]
            if shape == ("t", "*"):
                return c.startswith(texts[0])
            if shape == ("*", "t"):
                return c.endswith(texts[0])
            if shape == ("*", "t", "*"):
                return c.contains(texts[0])
            if shape == ("*",):
                return c.isNotNull()
        whole = accepted(c, self.tree) if ambiguous(self.tree) else c.rlike(self.regex)
        return c.startswith(self.prefix()) & whole if self.prefix() and not self.fold else whole


def from_other_dialect(pattern: str) -> str:
    """Rewrites ``?`` (any character) and ``"`` (escape) to this language's ``+`` and ``!``."""
    out, escaped = [], False
    for c in pattern:
        if escaped:
            out.append(c)
            escaped = False
        elif c == '"':
            out.append("!")
            escaped = True
        else:
            out.append("+" if c == "?" else c)
    return "".join(out)


def like(c: Column, pattern: str) -> Column:
    return Pattern.of(pattern).matches(c)


__all__ = ["Pattern", "PatternError", "from_other_dialect", "like", "parse", "to_regex"]
