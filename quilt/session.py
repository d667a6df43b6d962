"""Session helpers: building a local session, checkpoint folder, materializing,
and broadcasting only behind a size check."""

from __future__ import annotations

import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of a side that may be broadcast when its row count is known exactly.
BROADCAST_MAX_BYTES = 128 << 20


LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.driver.memory": "16g",
}


def build_session(master: str | None = None, app: str = "quilt", conf: dict[str, str] | None = None) -> SparkSession:
    """Local session for tests and the bench (``conf`` overrides the local
    defaults); on a cluster the caller builds its own session."""
    master = master or os.environ.get("QUILT_MASTER", "local[8]")
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in {**LOCAL_DEFAULTS, **(conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Use the cluster's ``spark.checkpoint.dir``; only when it is unset (local
    tests) take a fresh folder of our own."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not sc.master.startswith("local"):
            # a machine-local folder would not survive the loss of an executor
            raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage")
        configured = tempfile.mkdtemp(prefix="quilt-ckpt-", dir="/tmp")
    # (a file: folder on a cluster may be a shared mount, as the cluster names it)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def persist(df: DataFrame) -> DataFrame:
    """Keep a DataFrame that is read many times (iterative training)."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder: one job computes
    the rows once and writes them; the result reads from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int, width: int = 8, limit: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint only when the side's size, ``rows`` of ``width`` values of
    8 bytes, is known to be small; otherwise leave the choice to AQE, which
    measures the side at run time."""
    return F.broadcast(df) if rows * width * 8 <= limit else df


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """Deal the rows to ``partitions`` partitions, for a CPU-heavy or often
    repeated stage over an input with fewer splits than cores; None leaves the
    input's own splits, which is right for large inputs. Nothing runs here."""
    return df.repartition(partitions) if partitions and not df.isStreaming else df
