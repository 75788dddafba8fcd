"""Text finds: ``COLOR = BLUE AND (MAKE = FORD OR MAKE = TOYOTA)`` to a criteria tree.

AND binds tighter than OR; a bare operand repeats the field and operator before it; unquoted numbers are
numbers, quoted ones strings; a quote inside quotes is doubled.
"""

from __future__ import annotations

import re
from typing import Any

from .predicate import ALL, NONE, Criteria, file_is, point, single_record, where

_TOKEN = re.compile(r"\s*(?:(?P<quoted>'(?:[^']|'')*')|(?P<op>\^=|>=|<=|<>|[=<>])|(?P<bracket>[()])|(?P<word>[^\s()=<>'^]+))")
_OPERATORS = {"=": "EQ", "EQ": "EQ", "NE": "NE", "^=": "NE", "<>": "NE", ">": "GT", "GT": "GT", "<": "LT", "LT": "LT", ">=": "GE", "GE": "GE", "<=": "LE", "LE": "LE"}
_FORCE = {"NUM": "N_", "ALPHA": "A_"}
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([Ee][+-]?\d+)?")


class ParseError(ValueError):
    pass


class _Reader:
    def __init__(self, text: str):
        self.text, self.at, self.last = text, 0, None

    def peek(self) -> tuple[str, str] | None:
        if not self.text[self.at :].strip():
            return None
        m = _TOKEN.match(self.text, self.at)
        if not m:
            raise ParseError(f"can't read {self.text[self.at :]!r}")
        return m.lastgroup, m[m.lastgroup]

    def take(self) -> tuple[str, str]:
        found = self.peek()
        if found is None:
            raise ParseError("the text ends too soon")
        self.at = _TOKEN.match(self.text, self.at).end()
        return found

    def keyword(self, *names: str) -> str | None:
        found = self.peek()
        if found and found[0] in ("word", "op") and found[1].upper() in names:
            return self.take()[1].upper()
        return None

    def operand(self) -> Any:
        kind, text = self.take()
        if kind == "quoted":
            return text[1:-1].replace("''", "'")
        if kind != "word":
            raise ParseError(f"an operand was expected, not {text!r}")
        if not _NUMBER.fullmatch(text):
            return text
        return int(text) if re.fullmatch(r"[+-]?\d+", text) else float(text)

    def pattern(self) -> str:
        """A quoted pattern, or the raw text up to a blank outside brackets."""
        if (found := self.peek()) and found[0] == "quoted":
            return self.operand()
        start = self.at = len(self.text) - len(self.text[self.at :].lstrip())
        depth = 0
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "!" and self.at + 1 < len(self.text):
                self.at += 2
                continue
            if c.isspace() and depth == 0 or c == ")" and depth == 0:
                break
            depth += (c == "(") - (c == ")")
            self.at += 1
        return self.text[start : self.at]

    def expression(self) -> Criteria:
        out = self.term()
        while self.keyword("OR"):
            out = out | self.term()
        return out

    def term(self) -> Criteria:
        out = self.factor()
        while self.keyword("AND"):
            out = out & self.factor()
        return out

    def factor(self) -> Criteria:
        if self.keyword("NOT"):
            return ~self.factor()
        if self.peek() == ("bracket", "("):
            self.take()
            inner = self.expression()
            if self.peek() != ("bracket", ")"):
                raise ParseError("')' was expected")
            self.take()
            return inner
        return self.condition()

    def condition(self) -> Criteria:
        for name, make in (("POINT$", point), ("SINGLEREC", single_record)):
            if self.keyword(name):
                return make(int(self.operand()))
        if self.keyword("FILE$"):
            return file_is(str(self.operand()))
        if name := self.keyword("ALLRECS", "NORECS"):
            return ALL if name == "ALLRECS" else NONE
        start = self.at
        kind, name = self.take()
        following = self.peek()
        starts = following and (following[0] == "op" or following[1].upper() in {*_OPERATORS, "IS", "NOT", "PRESENT", "LIKE", "UNLIKE", "IN"})
        if kind == "quoted" and starts:
            name = name[1:-1].replace("''", "'")
        elif not starts:  # an operand of the field and operator before
            if self.last is None:
                raise ParseError(f"an operator was expected after {name!r}")
            self.at = start
            field, op = self.last
            return where(field, op, self.pattern() if op.endswith("LIKE") else self.operand())
        self.keyword("IS")
        negative = bool(self.keyword("NOT"))
        made = self.comparison(name)
        return ~made if negative else made

    def comparison(self, field: str) -> Criteria:
        if self.keyword("PRESENT"):
            return where(field, "PRESENT")
        if op := self.keyword("LIKE", "UNLIKE"):
            self.last = (field, op)
            return where(field, op, self.pattern())
        if self.keyword("IN"):
            if not self.keyword("RANGE"):
                raise ParseError("RANGE was expected")
            self.keyword("FROM")
            low = self.operand()
            if not self.keyword("TO"):
                raise ParseError("TO was expected")
            return where(field, "RANGE", low, self.operand())
        op = self.keyword(*_OPERATORS) or "="
        force = _FORCE.get(self.keyword(*_FORCE) or "", "")
        self.last = (field, force + _OPERATORS[op])
        return where(field, self.last[1], self.operand())


def parse_find(text: str) -> Criteria:
    reader = _Reader(text)
    if reader.peek() is None:
        return ALL
    out = reader.expression()
    if reader.peek() is not None:
        raise ParseError(f"unexpected {reader.peek()[1]!r}")
    return out
