"""Array helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times inside `body`.

    Expressions referenced inside a lambda are re-evaluated per element; binding them to a
    lambda variable first avoids that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
