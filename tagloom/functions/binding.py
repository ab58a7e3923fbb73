"""Naming an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Array lambdas run their body per element and share no subexpressions, so
    an expression used twice in one is computed twice, and a row constant K
    times. Going through a one-element array pins it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
