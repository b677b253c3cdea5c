"""Column expressions: parsing, keys, rates, rounding, labels. All are built-in functions; bad input gives null."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(text: Column) -> Column:
    """Text to double; thousands commas are dropped, NaN and anything unreadable become null."""
    number = F.regexp_replace(F.trim(text.cast("string")), ",", "").try_cast("double")
    return F.when(~F.isnan(number), number)


def parse_count(text: Column, suppressed: str = "*") -> Column:
    """A count; the mark of a suppressed value is null."""
    return to_number(F.nullif(F.trim(text), F.lit(suppressed)))


def parse_month(text: Column) -> Column:
    """'Jan 2023' or 'January 2023' to the first of the month."""
    text = F.trim(text)
    return F.coalesce(F.try_to_date(text, "MMM yyyy"), F.try_to_date(text, "MMMM yyyy"))


def month_start(date: Column) -> Column:
    return F.trunc(date.cast("date"), "MM")


def lag_key(date: Column, months: int = 1) -> Column:
    """The month whose signals belong to this month."""
    return F.add_months(date.cast("date"), -months)


def strip_suffix(name: Column, suffix: str = " County") -> Column:
    return F.trim(F.regexp_replace(name, f"{suffix}$", ""))


def normalize_key(name: Column) -> Column:
    """A join key without blanks."""
    return F.regexp_replace(name, " ", "")


def at_least(x: Column, low: float) -> Column:
    """max(x, low), null for null."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def rate(count: Column, population: Column) -> Column:
    """count / population, null where either is missing or the population is 0."""
    return F.try_divide(count.cast("double"), population.cast("double"))


def deviation(actual: Column, predicted: Column, floor: float = 1e-9) -> Column:
    """(actual - predicted) / max(predicted, floor)."""
    return (actual - predicted) / at_least(predicted, floor)


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.bround(100.0 * F.try_divide(part.cast("double"), whole.cast("double")), digits)


def month_angle(date: Column) -> Column:
    return F.month(date) * F.lit(2 * pi / 12)


def alert_label(value: Column, red: Column, yellow: Column) -> Column:
    """Red above red, Yellow above yellow, else Green; Gray without a value. A missing threshold is never passed."""
    never = F.lit(float("inf"))
    return (
        F.when(value.isNull(), "Gray").when(value > F.coalesce(red, never), "Red").when(value > F.coalesce(yellow, never), "Yellow").otherwise("Green")
    )
