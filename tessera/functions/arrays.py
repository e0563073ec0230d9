"""Higher-order array functions (map, keep, reduce, any, all), all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def arr_map(c, fn) -> Column:
    return F.transform(_c(c), fn)


def arr_keep(c, fn) -> Column:
    return F.filter(_c(c), fn)


def arr_reduce(c, init, fn, finish=None) -> Column:
    init = init if isinstance(init, Column) else F.lit(init)
    return F.aggregate(_c(c), init, fn, finish) if finish else F.aggregate(_c(c), init, fn)


def arr_any(c, fn) -> Column:
    return F.exists(_c(c), fn)


def arr_all(c, fn) -> Column:
    return F.forall(_c(c), fn)


def as_double_array(c) -> Column:
    return _c(c).cast("array<double>")


def arr_norm(c) -> Column:
    """Euclidean norm of a numeric array."""
    return F.sqrt(arr_reduce(arr_map(as_double_array(c), lambda x: x * x), 0.0, lambda a, x: a + x))
