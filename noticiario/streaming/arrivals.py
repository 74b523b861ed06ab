"""Incremental corpus: new article files join the stored corpus as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from noticiario import schema
from noticiario.operators.dedup import first_per_group
from noticiario.operators.filters import filter_date_range, filter_relevant
from noticiario.session import shared_table
from noticiario.sources.keys import KeyStore


def stream_articles(
    spark: SparkSession,
    root: str,
    row_type: StructType = schema.CORPUS,
    lo: str | None = None,
    hi: str | None = None,
    min_mentions: int = 0,
    files_per_batch: int | None = None,
    name_filter: str | None = None,
) -> DataFrame:
    """Rows of article files under ``root`` as a stream, in the window and relevant.

    Adds ``llegada``, the time at which the row was taken in; being the clock of
    the micro-batch it never runs backwards, so no row is late. Relevance needs a
    ``termino`` column and is skipped for a minimum of zero.
    """
    reader = spark.readStream.schema(row_type)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if name_filter is not None:
        reader = reader.option("pathGlobFilter", name_filter)
    rows = reader.parquet(root).withColumn("llegada", F.current_timestamp())
    if lo is not None and hi is not None:
        rows = filter_date_range(rows, lo, hi)
    if min_mentions > 0:
        rows = filter_relevant(rows, min_mentions)
    return rows


def stream_dedup(stream: DataFrame, delay: str = "7 days", key: str = "url") -> DataFrame:
    """First-seen row per URL across micro-batches.

    State is bounded by arrival time; article dates may be missing or years old
    and cannot bound it. A copy that arrives later than ``delay`` after the first
    is emitted again; :func:`write_first_seen` never forgets one.
    """
    return stream.withWatermark("llegada", delay).dropDuplicatesWithinWatermark([key])


def write_stream(
    stream: DataFrame, root: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Append the stream to a corpus partitioned by department.

    The folder must be its own: readers of a streamed folder see exactly the files
    the stream has committed, and no others.
    """
    columns = [field.name for field in schema.CORPUS.fields if field.name in stream.columns]
    writer = (
        stream.select(*columns).writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .partitionBy("departamento").outputMode("append")
    )
    return _start(writer.option("path", root), available_now)


def on_batch(
    stream: DataFrame,
    callback: Callable[[DataFrame, int], None],
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Call ``callback(batch, batch_id)`` for every micro-batch.

    A batch may be replayed after a failure with the same id.
    """
    writer = stream.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint)
    return _start(writer, available_now)


def first_seen_batch(
    batch: DataFrame, batch_id: int, root: str, store: KeyStore, key: str = "url",
    order: Sequence[Column] = (), salts: int = 16,
) -> None:
    """Append the rows of a micro-batch whose key was never stored, the first of each.

    Keys are cut inside the batch before the history is asked, first within map tasks, so
    a hot key costs no task more than others. Rows and keys are stored under the number of
    the batch, rows first: a batch that is repeated, after a failure at any point, sees the
    history of the batches before it, and replaces what it had stored.
    """
    columns = [field.name for field in schema.CORPUS.fields if field.name in batch.columns]
    total = [*order, F.col("llegada"), F.xxhash64(*columns), *[F.col(c) for c in columns if c != key]]
    firsts = first_per_group(batch, [key], total, salts=salts)
    new = shared_table(store.unseen(firsts, key, before=batch_id).select(*columns), "lote")
    (
        new.withColumn("lote", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("lote", "departamento").parquet(root)
    )
    store.add(new, key, batch=batch_id)


def write_first_seen(
    stream: DataFrame, root: str, store: KeyStore, checkpoint: str, available_now: bool = False,
    key: str = "url", order: Sequence[Column] = (),
) -> StreamingQuery:
    """Keep the first row of each key for good, over all batches and restarts.

    Unlike :func:`stream_dedup` nothing is forgotten and no state is held by executors: the
    history is a stored table of hashes that each batch reads in its buckets. ``order``
    ranks copies that arrive in one batch. The corpus is partitioned by batch and department.
    """
    def keep(batch: DataFrame, batch_id: int) -> None:
        first_seen_batch(batch, batch_id, root, store, key, order)

    return on_batch(stream, keep, checkpoint, available_now)


def _start(writer: DataStreamWriter, available_now: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if available_now else writer).start()
