"""Arrow batches of whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows and bytes of one batch; a batch is held several times over by executor and worker.
ROWS, BYTES = 1000, 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """The same frame; its session sends workers batches of at most ROWS rows from now on.

    Texts of thousands of characters make Spark's usual 10,000 rows tens of megabytes. The setting
    bounds memory and changes no result; a smaller one that is already set stays."""
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)):
        now = str(conf.get(name)).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return df
