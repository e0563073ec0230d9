"""Registry of named queries over the driver tables.

Each query is a function ``(spark, sf_dir) -> DataFrame``; most carry an
equivalent DuckDB SQL text over the same tables, the correctness oracle.
Every computed column is aliased to the same name on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.session import prepare_session
from tessera.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_ROUND = re.compile(r"(?<![A-Za-z0-9_])round\(", re.IGNORECASE)


def positive_zero_rounds(sql: str) -> str:
    """Wrap every ``round(...)`` of the oracle SQL as ``(round(...) + 0.0)``.

    DuckDB rounds a tiny negative value to -0.0; Spark's ``round`` goes through
    a decimal and gives 0.0. Adding +0.0 turns -0.0 into 0.0 and leaves every
    other value unchanged, so both engines print the same number."""
    out, i = [], 0
    while True:
        m = _ROUND.search(sql, i)
        if not m:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:m.start()])
        depth, j = 0, m.end() - 1
        while j < len(sql):
            if sql[j] == "(":
                depth += 1
            elif sql[j] == ")":
                depth -= 1
                if depth == 0:
                    break
            j += 1
        inner = positive_zero_rounds(sql[m.end():j])
        out.append(f"({sql[m.start():m.end()]}{inner}) + 0.0)")
        i = j + 1


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"query {key!r} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare_session(spark)
            return fn(Tables(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = positive_zero_rounds(sql.strip())
        return fn
    return deco


class Tables:
    """Attribute access to the driver tables: ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_table(self.spark, self.sf_dir, name)
