"""Argument checks shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def as_list(x) -> list:
    if x is None:
        return []
    if isinstance(x, (str, bytes)):
        return [x]
    if isinstance(x, Iterable):
        return list(x)
    return [x]


def require_columns(df: DataFrame, *cols) -> None:
    names = set(df.columns)
    missing = [c for c in cols if isinstance(c, str) and c not in names]
    if missing:
        raise ValueError(f"unknown column(s) {missing}; frame has {df.columns}")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
