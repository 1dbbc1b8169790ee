"""Disguised identifiers of any length of disguise, and time that stays in proportion to the text."""

import time

import pytest

from engramite.llm import pii


def spans(text):
    return {(k, text[a:b]) for k, a, b in pii.deobfuscate(text, pii.detect(text))}


@pytest.mark.parametrize("gap", [" ", "   ", "    ", "\t  \n  "])
def test_any_space(gap):
    for address in (f"jane{gap}(at){gap}example{gap}(dot){gap}com", f"jane{gap}[{gap}at{gap}]{gap}example{gap}[dot]{gap}com", f"jane{gap}at{gap}example{gap}dot{gap}com", f"jane{gap}@{gap}example.com"):
        assert ("email", address) in spans(f"write to: {address}; soon"), address
    number = gap.join("plus four nine one seven zero one two three four five six".split())
    assert ("phone", number) in spans(f"call: {number}; soon")


@pytest.mark.parametrize("parts", [1, 4, 6, 30])
def test_any_number_of_parts(parts):
    local = " dot ".join(f"p{k}" for k in range(parts))
    assert spans(f"it is {local} at example dot co dot uk, yes") >= {("email", f"{local} at example dot co dot uk")} or parts == 1


def test_chains_that_lead_nowhere_are_left_alone():
    assert spans("the dot on the dot and the point of the point is a dot punkt, at home") == set()
    assert spans("a list (at home) of things, one of them at work; see section 3 . 4 and 5") == set()


@pytest.mark.parametrize("text", ["w dot " * 20_000, "x" + " " * 100_000 + "y", "-" * 100_000, "_" * 100_000 + "at", "a @ " * 20_000, "one " * 2 + " " * 100_000, "( " * 50_000 + "at", ("one two" + " " * 50) * 2000])
def test_time_in_proportion(text):
    began = time.perf_counter()
    spans(f"{text} jane (at) example (dot) com five dot six")
    assert time.perf_counter() - began < 3
