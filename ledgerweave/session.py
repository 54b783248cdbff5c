"""Session settings and durable cuts of lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "ledgerweave") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the cluster's own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset on a local master (tests on one machine) a fresh temporary folder is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerweave-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


_scopes = threading.local()
#: Spark removes the shuffle files of a query when it ends, not when the driver next collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def temporary():
    """Tables that ``durable`` writes in this block are removed at its end, but for those written with ``outer``.

    What leaves the block must be such a table, so that nothing that is removed can be read again, even after a lost executor.
    """
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for spark, path in stack.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def durable(df: DataFrame, outer: int = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` but stays columnar, so later readers
    prune columns. The tables of one application lie in one folder named after it
    and can be removed together once its results are written; see ``temporary`` for an earlier removal. ``outer`` says how many of the
    blocks around it the table outlives.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerweave/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    scopes = _scopes.__dict__.get("stack", [])
    if len(scopes) > outer:
        scopes[-1 - outer].append((spark, path))
    kept = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if kept is None else spark.conf.set(_CLEANUP, kept)
    return spark.read.schema(df.schema).parquet(path)
