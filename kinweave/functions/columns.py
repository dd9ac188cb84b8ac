"""Helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once.

    A column that is used inside a lambda function may be replaced by its own expression when the optimizer
    merges projections or pushes filters down, and is then evaluated again for each element. A bound variable stays one.
    """
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))
