"""Binding a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row.

    Columns that a lambda refers to are otherwise put into its body and evaluated
    for every element, and projections that are merged repeat them.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
