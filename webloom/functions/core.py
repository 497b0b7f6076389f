"""Small helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Needed only inside higher-order functions, where an intermediate column cannot be introduced.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bound(value: Column | str, body: Callable[[Column], Column]) -> Column:
    """Like :func:`let`, but a plain column name needs no binding.

    Functions that mention their argument often go through this. A filter on a derived column is pushed down with
    the column's whole expression put in place of its name, so the expression must not be copied at every mention.
    """
    return body(F.col(value)) if isinstance(value, str) else let(value, body)


def ends_with_any(value: Column | str, endings: tuple[str, ...]) -> Column:
    def test(text: Column) -> Column:
        hit = F.lit(False)
        for ending in endings:
            hit = hit | F.endswith(text, F.lit(ending))
        return hit

    return bound(value, test)
