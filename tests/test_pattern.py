"""The regular expressions against a matcher that works on the token tree directly."""

import re
import time

import pytest
from hypothesis import HealthCheck, assume, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievebase.functions import automaton
from sievebase.functions import pattern as pattern_module
from sievebase.functions.automaton import deterministic
from sievebase.functions.pattern import Choice, Literal, Pattern, PatternError, Range, Wild, from_other_dialect, parse


def ends(node, text: str, starts: set[int]) -> set[int]:
    """All places where a match that begins at one of ``starts`` can end."""
    if isinstance(node, tuple):
        for item in node:
            starts = ends(item, text, starts)
        return starts
    if isinstance(node, Literal):
        return {i + len(node.text) for i in starts if text.startswith(node.text, i)}
    if isinstance(node, Range):
        return {i + 1 for i in starts if i < len(text) and node.low <= text[i] <= node.high}
    if isinstance(node, Wild):
        if node.kind == "*":
            return {j for i in starts for j in range(i, len(text) + 1)}
        fits = {"+": lambda c: True, "@": lambda c: c.isascii() and c.isalpha(), "#": lambda c: c.isascii() and c.isdigit()}[node.kind]
        return {i + 1 for i in starts if i < len(text) and fits(text[i])}
    assert isinstance(node, Choice)
    out, now = set(), starts
    for k in range(1, node.most + 1):
        now = set().union(*(ends(m, text, now) for m in node.members))
        if k >= node.least:
            out |= now
    return out


def matches(pattern: str, text: str) -> bool:
    return len(text) in ends(parse(pattern), text, {0})


def python_regex(pattern: str) -> str:
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), Pattern.of(pattern).regex.replace(r"\z", r"\Z"))


atoms = st.sampled_from(["a", "b", "1", "*", "+", "@", "#", "!*", "=41", "(a,b)", "(a-c,x)", "/2(a)", "/1-3(ab,1)", "(,a)", "(a*,(b,1)+)"])
patterns = st.lists(st.lists(atoms, max_size=4).map("".join), min_size=1, max_size=3).map(",".join)


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(patterns, st.text("ab1cxA* \n", max_size=6))
def test_regex_agrees_with_the_token_tree(pattern, text):
    assert bool(re.search(python_regex(pattern), text)) == matches(pattern, text)


def test_java_agrees_with_the_token_tree(spark):
    cases = [(p, t) for p in ["A*", "*B", "*A*", "A", "", "(A,X)*", "/2-3(#)", "(a-c)+", "A=2BB", "!*", "*,", "NOCASE:a*", "@#", "A+*C"] for t in ["", "A", "AB", "A\n", "a", "12", "123", "1234", "b9", "*", "A+B", "XYZ", "A1", "AxxC"]]
    frame = spark.createDataFrame([(t,) for t in dict.fromkeys(t for _, t in cases)], "t string")
    for p in dict.fromkeys(p for p, _ in cases):
        got = {r["t"] for r in frame.where(Pattern.of(p).matches(frame["t"])).collect()}
        fold = p.startswith("NOCASE:")
        body = p.removeprefix("NOCASE:").upper() if fold else p
        assert got == {t for q, t in cases if q == p and matches(body, t.upper() if fold else t)}, p


def walked(pattern: str, text: str) -> bool:
    """The deterministic automaton's verdict."""
    try:
        t = automaton.deterministic(automaton.build(parse(pattern)), 300)
    except automaton.TooLarge:
        assume(False)
    state = 0
    for c in text:
        kind = next(k for k, spans in enumerate(t.kinds) if any(low <= ord(c) <= high for low, high in spans))
        state = t.step[state][kind]
    return t.accepts[state]


nested = st.sampled_from(["/2-9(*a,*b)", "/1-3(a,ab)", "/2(*,1)", "/1-2(/1-2(a*,b),+)", "*", "a", "b", "(a,ab*)"])


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.too_slow, HealthCheck.filter_too_much])
@given(st.lists(st.one_of(atoms, nested), min_size=1, max_size=4).map("".join), st.text("ab1cxA* \n", max_size=7))
def test_automaton_agrees_with_the_token_tree(pattern, text):
    assert walked(pattern, text) == matches(pattern, text)


def test_automaton_columns_agree_with_the_token_tree(spark, monkeypatch):
    texts = ["", "ab", "abab", "abc", "ababc", "aabbc", "c", "bbbc", "x\nabc", "\U0001f600abc", "\ue000abc", "abababababc", "ab\n"]
    frame = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for p in ("/2-9(*a,*b)c", "/1-3(a,ab)/1-2(b,c)", "*a*b*c*", "/2(*,b)c", "NOCASE:/2-3(*A,B)C"):
        body = p.removeprefix("NOCASE:")
        want = [matches(body, t.upper() if p != body else t) for t in texts] + [None]
        assert pattern_module.ambiguous(Pattern.of(p).tree), p
        for most in (automaton.MAX_STATES, 1):  # table, then sets of states
            monkeypatch.setattr(automaton, "deterministic", lambda a, most=most: deterministic(a, most))
            assert [r["m"] for r in frame.select(Pattern.of(p).matches(frame["t"]).alias("m")).collect()] == want, p
    monkeypatch.undo()


def test_nested_repeats_take_linear_time(spark):
    frame = spark.range(1).select(F.expr("repeat('ab', 5000)").alias("t"))
    assert frame.where(Pattern.of("/2-9(*a,*b)c").matches(F.col("t"))).count() == 0
    began = time.time()
    assert frame.where(Pattern.of("/2-9(*a,*b)c").matches(F.col("t"))).count() == 0
    assert frame.where(Pattern.of("/2-9(*a,*b)").matches(F.col("t"))).count() == 1
    assert time.time() - began < 5


@pytest.mark.parametrize("bad", ["a-b", "(a", "a)", "/(a)", "/0(a)", "/3-2(a)", "/2-2(a)", "(b-a)", "(ab-c)", "=4", "!", "/999(a)"])
def test_bad_patterns_are_refused(bad):
    with pytest.raises(PatternError):
        parse(bad)


def test_other_dialect():
    assert from_other_dialect('a?"*b') == "a+!*b"
