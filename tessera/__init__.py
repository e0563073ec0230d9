"""tessera: customer and tabular analytics as Spark DataFrame jobs.

Layout
------
operators/  table verbs, joins, windows, reshaping, profiling, customer value,
            statistics and models; every function takes and returns DataFrames
functions/  column-level scalar helpers (strings, regex, dates, maths, arrays)
sources/    table loading, delimited text, partitioned writes, JSON and HTML columns
plans/      the registry of named queries over the driver tables, each paired
            with an equivalent DuckDB SQL text used as the correctness oracle
streaming/  the one operator that can also run on a stream (bucketed sums)
"""

from tessera.session import build_session, prepare_session, scratch_dir  # noqa: F401

__all__ = ["build_session", "prepare_session", "scratch_dir"]
