"""Keys that were seen before, kept for good in buckets of their hashes.

A key is kept as two 64-bit hashes, 16 bytes whatever its length. The table is bucketed by
them, so a join reads the history where it lies and only new keys are shuffled. Each batch
of keys is a partition of its own under the number of the batch: a batch that is repeated
replaces itself, and is compared with earlier batches alone.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# At least as many as shuffle partitions, or the optimizer deals both sides anew.
BUCKETS = 256


def key_hashes(*keys: Column | str) -> list[Column]:
    """Two independent hashes of a key; null is a key as well."""
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    marked = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in columns]
    return [
        F.xxhash64(*marked).alias("_h1"), F.xxhash64(F.lit("otra"), *marked, F.lit("vez")).alias("_h2")
    ]


@dataclass(frozen=True)
class KeyStore:
    """Seen keys under ``path``; the number of buckets is fixed once keys are stored."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    @property
    def name(self) -> str:
        """Name in the session's catalog, which only points to the path."""
        table = f"claves_{hashlib.md5(self.path.encode()).hexdigest()}"
        if not self.spark.catalog.tableExists(table):
            # the folder must be there to be searched for batches of earlier sessions
            self.spark.range(0).write.mode("ignore").parquet(f"{self.path}/_claves")
            self.spark.sql(
                f"CREATE TABLE {table} (_h1 BIGINT, _h2 BIGINT, lote BIGINT) USING parquet "
                f"PARTITIONED BY (lote) CLUSTERED BY (_h1, _h2) SORTED BY (_h1) INTO {self.buckets} BUCKETS "
                "LOCATION '" + self.path.replace("'", "''") + "'"
            )
            self.spark.catalog.recoverPartitions(table)
        return table

    def seen(self, before: int | None = None) -> DataFrame:
        """Stored keys, those of batches before ``before`` if it is given."""
        table = self.name
        self.spark.catalog.refreshTable(table)
        stored = self.spark.table(table)
        return stored if before is None else stored.filter(F.col("lote") < before)

    def unseen(self, rows: DataFrame, *keys: str, before: int | None = None) -> DataFrame:
        """Rows whose key is not stored; the history is read in its buckets, unshuffled."""
        hashed = rows.select("*", *key_hashes(*keys))
        known = self.seen(before).select("_h1", "_h2")
        # a history that looks small must not be broadcast: it grows, and plans are kept
        return hashed.join(known.hint("merge"), ["_h1", "_h2"], "left_anti").drop("_h1", "_h2")

    def add(self, rows: DataFrame, *keys: str, batch: int) -> None:
        """Store the keys of ``rows`` as batch ``batch``, in place of an earlier try of it.

        Keys are sorted into their buckets, one file each. Equal keys are stored once.
        """
        new = rows.select(*key_hashes(*keys)).distinct().withColumn("lote", F.lit(batch).cast("bigint"))
        dealt = new.repartition(self.buckets, "_h1", "_h2")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").insertInto(self.name)
