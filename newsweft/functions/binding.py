"""Bind an expression to a name inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    An expression that is referred to several times, above all from inside a
    higher-order function, would otherwise be evaluated at every reference.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
