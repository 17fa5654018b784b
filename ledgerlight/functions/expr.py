"""Column expressions of the engine, with the same results in both dialects that it is checked against."""

from __future__ import annotations

from itertools import combinations
from math import factorial

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(x: Column, y: Column) -> Column:
    """x / y; null, never 0 or infinity, where y is 0."""
    return F.try_divide(x.cast("double"), y.cast("double"))


def pct_change(new: Column, old: Column) -> Column:
    return safe_divide(new - old, old) * 100


def month_label(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def quarter_label(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))


def quarter_bounds(d: Column) -> tuple[Column, Column]:
    """First day of the date's quarter and of the next one."""
    first = F.trunc(d, "quarter")
    return first, F.add_months(first, 3)


def month_index(d: Column) -> Column:
    """Months since year 0: differences count month boundaries."""
    return F.year(d) * 12 + F.month(d)


def months_between_boundaries(a: Column, b: Column) -> Column:
    return month_index(b) - month_index(a)


def log10(x: Column) -> Column:
    return F.log10(x)


def round_to_int(x: Column) -> Column:
    """Cast that rounds half away from zero, as a cast of a decimal number does elsewhere."""
    return F.round(x, 0).cast("int")


def concat_skip_nulls(*parts: Column) -> Column:
    return F.concat_ws("", *parts)


def substring_from(x: Column, start: int, length: int) -> Column:
    """Positions from 1; a start of 0 or less takes away from the length."""
    end = start + length
    return F.substring(x, max(start, 1), max(0, end - max(start, 1)))


def in_half_open(d: Column, start, end) -> Column:
    """start <= d < end: the house style for windows."""
    return (d >= start) & (d < end)


def within_days_inclusive(d: Column, start: Column, days: int) -> Column:
    """start <= d <= start + days."""
    return (d >= start) & (d <= F.date_add(start, days))


def shapley_product(before: list[Column], after: list[Column]) -> list[Column]:
    """Effect of each factor on the change of their product, averaged over all orders of exchange.

    The average over orders equals a weighted sum over the sets of factors already exchanged: plain arithmetic, no function calls.
    """
    n = len(before)
    effects = []
    for i in range(n):
        others = [k for k in range(n) if k != i]
        total = F.lit(0.0)
        for size in range(n):
            weight = factorial(size) * factorial(n - size - 1) / factorial(n)
            for chosen in combinations(others, size):
                term = F.lit(weight)
                for k in others:
                    term = term * (after[k] if k in chosen else before[k])
                total = total + term
        effects.append((after[i] - before[i]) * total)
    return effects
