"""Session helpers: a tuned local session for tests/bench and checkpoint-dir handling."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "tillcycle") -> SparkSession:
    """Session used by tests and bench.  On a cluster, the submitter's
    session (with its own master / partition counts) is used instead."""
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.timestampType", "TIMESTAMP_NTZ")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "10g")
        # checkpoint files of frames no longer referenced are removed
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; it is read, never replaced.  Only
    when it is unset (local tests) a private scratch folder is created.
    """
    sc = spark.sparkContext
    current = sc.getConf().get("spark.checkpoint.dir", None) or \
        spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = sc._jsc.sc().getCheckpointDir()
        current = current.get() if current.isDefined() else None
    if not current:
        current = tempfile.mkdtemp(prefix="tillcycle-ckpt-")
    sc.setCheckpointDir(current)
    return current


def bounded_broadcast(df, max_rows: int = 100_000):
    """``df`` with a broadcast hint if it is counted to have at most
    ``max_rows`` rows, else as it is (a shuffle join, which AQE may split)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def cut_lineage(df):
    """Write ``df`` as a Parquet table into the shared checkpoint folder and
    read it back: computed once, survives lost executors, read column by
    column, and its size is known to the joins that follow."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex[:16]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark):
    """Within it the shuffle files of a write go when the write ends.  Otherwise they stay until
    the driver happens to collect its garbage, and writes that follow one another add up on disk."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)
