"""Months as whole numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_number(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)
