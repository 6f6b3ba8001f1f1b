"""Reward scalars (R-01 .. R-03, R-10, R-11, R-14 .. R-16) and the
weighted rubric (R-04 .. R-06) as Column expressions."""
from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tests_passed(fraction_passed="fraction_passed") -> Column:
    """R-01."""
    return _c(fraction_passed).cast("double")


def no_syntax_error(syntax_ok="syntax_ok") -> Column:
    """R-02."""
    return F.when(_c(syntax_ok), F.lit(1.0)).otherwise(F.lit(0.0))


def clean_format(raw_completion="completion") -> Column:
    """R-03: 0 when the raw text contains three backticks."""
    return F.when(F.instr(_c(raw_completion), "```") > 0, F.lit(0.0)).otherwise(F.lit(1.0))


@dataclass(frozen=True)
class Component:
    """X-03: a named reward component; ``fn`` maps the verdict frame's
    columns to a value in [0, 1]."""
    name: str
    fn: Callable[[], Column]
    weight: float = 1.0


def default_components() -> list[Component]:
    """R-05: tests only."""
    return [Component("tests", lambda: tests_passed(), 1.0)]


def dense_components(completion_col: str = "completion", has_fence_col: str | None = None
                     ) -> list[Component]:
    """R-06: 0.8 tests, 0.1 syntax, 0.1 format."""
    fmt = ((lambda: F.when(F.col(has_fence_col), 0.0).otherwise(1.0)) if has_fence_col
           else (lambda: clean_format(completion_col)))
    return [Component("tests", lambda: tests_passed(), 0.8),
            Component("syntax", lambda: no_syntax_error(), 0.1),
            Component("format", fmt, 0.1)]


def rubric_reward(components: list[Component] | None) -> Column:
    """R-04: ``sum(w * v) / sum(w)``, 0 when the weights sum to 0; an empty
    list falls back to tests only. Every component counts in the sum, even
    one whose name repeats."""
    comps = components or default_components()
    wsum = sum(c.weight for c in comps)
    if wsum == 0:
        return F.lit(0.0)
    total = None
    for c in comps:
        term = F.lit(float(c.weight)) * c.fn()
        total = term if total is None else total + term
    return total / F.lit(float(wsum))


def rubric_breakdown(components: list[Component] | None) -> Column:
    """R-04 breakdown as ``map<string,double>``; a repeated name keeps its
    last value (Spark maps reject duplicate keys, H-6)."""
    comps = components or default_components()
    last: dict[str, Component] = {}
    for c in comps:
        last.pop(c.name, None)
        last[c.name] = c
    kv = []
    for name, c in last.items():
        kv += [F.lit(name), c.fn().cast("double")]
    return F.create_map(*kv)


def sort_distance(prompt, response) -> Column:
    """R-10: positions where the response equals the sorted prompt."""
    return F.size(F.filter(F.zip_with(_c(response), F.array_sort(_c(prompt)), lambda a, b: a == b),
                           lambda x: x)).cast("double")


def sort_inclusion_ordering(prompt, response) -> Column:
    """R-11: prompt items found in the response (each duplicate counts)
    plus adjacent response pairs with ``x <= y``."""
    r = _c(response)
    incl = F.size(F.filter(_c(prompt), lambda x: F.array_contains(r, x)))
    tail = F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0)))
    order = F.size(F.filter(F.zip_with(r, tail, lambda a, b: a <= b), lambda x: x))
    return (incl + order).cast("double")


# The pattern-based test names and the required set.
PATTERN_TESTS = (
    ("def ", "test_function_definition"),
    ("class ", "test_class_definition"),
    ("import ", "test_imports"),
    ("return ", "test_return_statements"),
)
LENGTH_TEST = (100, "test_code_length")
REQUIRED_TESTS = ("test_function_definition", "test_imports", "test_return_statements")


def pattern_tests(code) -> Column:
    """R-14: names of the pattern tests the code passes (array, in a fixed order)."""
    c = _c(code)
    items = [F.when(F.instr(c, pat) > 0, F.lit(name)) for pat, name in PATTERN_TESTS]
    items.append(F.when(F.length(c) > LENGTH_TEST[0], F.lit(LENGTH_TEST[1])))
    return F.array_compact(F.array(*items))


def all_required(tests) -> Column:
    """R-15: the required set is a subset of the passed tests."""
    return F.size(F.array_except(F.array(*[F.lit(t) for t in REQUIRED_TESTS]), _c(tests))) == 0


def diff_applies(code, prev_code) -> Column:
    """R-16: no previous valid state, or the code differs from it."""
    return _c(prev_code).isNull() | (_c(code) != _c(prev_code))
