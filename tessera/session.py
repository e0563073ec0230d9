"""Session settings and the shared scratch folder.

The library never invents cluster settings. ``prepare_session`` only pins the
few SQL settings whose value changes results (time zone, ANSI mode), and
``scratch_dir`` reads the shared folder the cluster names in
``spark.checkpoint.dir``; a private folder is created only when none is set,
which happens in local tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that change query results; fixed for every query in this package.
RESULT_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "tessera", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; a cluster passes its own builder."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", "16g")
         .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024)))
    for k, v in RESULT_SETTINGS.items():
        b = b.config(k, v)
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare_session(spark: SparkSession) -> SparkSession:
    for k, v in RESULT_SETTINGS.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written tables.

    Uses ``spark.checkpoint.dir`` (or the context's checkpoint dir) when the
    cluster sets one; only when unset (tests, local runs) makes a private one.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not d:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            d = tempfile.mkdtemp(prefix="tessera-ckpt-")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path under the shared scratch folder."""
    base = scratch_dir(spark).rstrip("/")
    return f"{base}/{name}-{os.getpid()}-{next(_COUNTER)}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that this run wrote under the scratch folder and does not need any more."""
    if not path.startswith(scratch_dir(spark).rstrip("/") + "/"):
        raise ValueError(f"{path} is not under the scratch folder")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _counter():
    i = 0
    while True:
        i += 1
        yield i


_COUNTER = _counter()
