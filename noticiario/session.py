"""Session settings, checked broadcasts and lineage cuts shared by all jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest optimizer size estimate for which a side may be broadcast.
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024

# SQL settings every job relies on. All can be changed on a live session.
SETTINGS = {
    # Article dates are compared as UTC instants.
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: coalesced shuffles, skewed joins, skewed writes.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Per-group caps (up to 2000 rows) are cut before the shuffle as well.
    "spark.sql.optimizer.windowGroupLimitThreshold": "5000",
    # Rewriting one department must leave the other partitions alone.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Seen URLs of a stream are kept on local disk with durable snapshots, not in
    # executor memory.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`SETTINGS` to a session somebody else created."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def session(app_name: str = "noticiario") -> SparkSession:
    """The active session, or a new one, with the settings applied."""
    return configure(SparkSession.builder.appName(app_name).getOrCreate())


def estimated_bytes(df: DataFrame) -> int:
    """Optimizer's size estimate of a plan; runs no job."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def is_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> bool:
    return estimated_bytes(df) <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast only when its estimated size is within ``limit``.

    Beyond the limit the frame is returned unhinted, so the join becomes a
    shuffle join that adaptive execution may still split where keys are skewed.
    """
    return F.broadcast(df) if is_small(df, limit) else df


def local_table(spark: SparkSession, rows: Sequence[dict], schema: pa.Schema) -> DataFrame:
    """Configuration rows as a local relation, whose size the optimizer knows exactly."""
    return spark.createDataFrame(pa.Table.from_pylist(list(rows), schema=schema))


def pin(df: DataFrame, label: str = "plan") -> DataFrame:
    """A configuration table with its content and exact size fixed, however large it is.

    Estimates of joined dimensions are far too high to allow a broadcast, and a plan may
    depend on a store that is written later. The table is stored in the shared folder;
    no row goes through the driver.
    """
    return shared_table(df, label)


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors can reach, as named by ``spark.checkpoint.dir``.

    A checkpoint folder set on the context serves as well. Only a local-mode
    session without either gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    return tempfile.mkdtemp(prefix="noticiario-")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path for ``label`` inside the shared folder."""
    return f"{shared_folder(spark)}/noticiario/{label}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the stored copy.

    Cuts the lineage of results that are read several times. A columnar copy is
    used instead of an RDD checkpoint so that later reads prune columns and get
    real size statistics. Zstandard keeps texts about a third smaller than the default.
    """
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
