"""Bind an expensive column once and use it many times in one expression.

Catalyst inlines aliases when it pushes a filter through a projection, so
`lower(text)` tested against eight words would run eight times. A lambda over a
one-element array evaluates it once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def holds(value: Column, test: Callable[[Column], Column]) -> Column:
    """Boolean form of `let`."""
    return F.exists(F.array(value), test)
