"""Readers: stored corpora, pages and listing payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from noticiario import schema
from noticiario.functions import dates

# ── Corpus files ─────────────────────────────────────────────────────────────


def read_corpus(
    spark: SparkSession,
    root: str,
    tolerate_bad: bool = False,
    merge_schema: bool = False,
    row_type: T.StructType | None = None,
    with_file: bool = False,
) -> DataFrame:
    """All department partitions under ``root``; ``with_file`` adds ``archivo``.

    ``tolerate_bad`` skips unreadable files; :func:`bad_files` reports them. The
    columns are those of ``row_type``, which spares opening files, else those of one
    file, or with ``merge_schema`` or ``tolerate_bad`` of all readable files.
    """
    reader = spark.read.option("mergeSchema", merge_schema or tolerate_bad)
    if row_type is not None:
        reader = reader.schema(row_type)
    stored = reader.option("ignoreCorruptFiles", tolerate_bad).parquet(root)
    return stored.withColumn("archivo", F.col("_metadata.file_path")) if with_file else stored


def require_columns(df: DataFrame, required: Sequence[str] = tuple(schema.REQUIRED)) -> DataFrame:
    """The same frame, or an error that names the missing columns."""
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; present columns {df.columns}")
    return df


_INVENTORY = "path string, length bigint, modificationTime timestamp, content binary"
# A file without rows is no longer than this.
_EMPTY_BYTES = 1 << 20


def _listing(spark: SparkSession, root: str) -> DataFrame:
    """The Parquet files under ``root``; contents are read only if they are selected."""
    try:
        return (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.parquet")
            .load(root)
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _INVENTORY)


def _department() -> Column:
    folder = F.regexp_extract("path", r"departamento=([^/]*)/", 1)
    # Partition folders percent-encode special characters; a plus sign stays.
    return F.nullif(F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B"))), F.lit(""))


def corpus_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Stored corpus files: ``archivo, departamento, mb, modificado``.

    Only the file listing is read, no content. A folder that does not exist yet
    is an empty inventory.
    """
    return _listing(spark, root).select(
        F.col("path").alias("archivo"),
        _department().alias("departamento"),
        F.round(F.col("length") / 1048576, 1).alias("mb"),
        F.col("modificationTime").alias("modificado"),
    )


def stored_files(spark: SparkSession, root: str, marks: bool = False) -> DataFrame:
    """Stored corpus files by comparable paths: ``archivo, departamento, bytes``.

    With ``marks`` also ``valido``: whether a file short enough to hold no rows has the
    marks of its format at both ends. Only such files are opened; others are null.
    """
    files = _listing(spark, root)
    columns = [
        plain_path(F.col("path")).alias("archivo"), _department().alias("departamento"),
        F.col("length").alias("bytes"),
    ]
    if not marks:
        return files.select(*columns)
    ends = [F.substring("content", 1, 4), F.substring("content", -4, 4)]
    valid = (ends[0] == F.lit(b"PAR1")) & (ends[1] == F.lit(b"PAR1"))
    # the length filter reaches the listing, so long contents are never loaded
    return files.filter(F.col("length") <= _EMPTY_BYTES).select(*columns, valid.alias("valido"))


def bad_files(inventory: DataFrame, corpus: DataFrame, root: str | None = None) -> DataFrame:
    """Inventory files from which a tolerant read got no rows.

    With ``root`` files that are valid without rows are left out.
    """
    loaded = corpus.select(plain_path(F.col("archivo"), True).alias("_path")).distinct()
    if root is not None:
        empty = stored_files(corpus.sparkSession, root, marks=True).filter("valido")
        loaded = loaded.union(empty.select("archivo"))
    return (
        inventory.withColumn("_path", plain_path(F.col("archivo")))
        .join(loaded, "_path", "left_anti")
        .drop("_path")
    )


def plain_path(path: Column, encoded: bool = False) -> Column:
    """Path without scheme, as file listings give it.

    The file column of a reader is an address, percent-encoded once: ``encoded`` undoes it.
    """
    bare = F.regexp_replace(path, r"^[A-Za-z0-9]+:/+", "/")
    return F.url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))) if encoded else bare


# ── Pages ────────────────────────────────────────────────────────────────────


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored raw pages: ``page_id, url, html``."""
    return spark.read.schema(schema.PAGE).parquet(path)


# ── Listing payloads ─────────────────────────────────────────────────────────
#
# Each reader takes a table with a text column ``body`` (one stored response per
# row) and returns the other columns with ``pos, link, fecha``.


def _items(payloads: DataFrame, items: Column) -> DataFrame:
    others = [name for name in payloads.columns if name != "body"]
    return payloads.select(*others, F.posexplode(items).alias("pos", "item"))


def read_wp_posts(payloads: DataFrame) -> DataFrame:
    """REST listings ``[{"link", "date"}, …]``; posts without a link are dropped."""
    rows = _items(payloads, F.from_json("body", schema.WP_POSTS))
    return (
        rows.withColumn("link", F.col("item.link"))
        .withColumn("fecha", dates.iso_datetime(F.col("item.date")))
        .drop("item")
        .filter("link <> ''")
    )


def _first_key(item: Column, keys: Sequence[str]) -> Column:
    """First non-empty value among ``keys``; keys are case-sensitive."""
    values = [F.try_element_at(item, F.lit(key)) for key in keys]
    return F.coalesce(*[F.when(value != "", value) for value in values])


def read_queryly(
    payloads: DataFrame, formats: Sequence[str] = ("en_abbr_or_iso",)
) -> DataFrame:
    """Search-service listings ``{"items": [...], "metadata": {"total": n}}``.

    Date and link are looked up under their known names, an empty value falling
    through to the next. ``total`` is the number of results the service reports.
    Each response is parsed once; items become maps, in which names that differ
    only in case remain apart.
    """
    others = [name for name in payloads.columns if name != "body"]
    parsed = payloads.select(*others, F.from_json("body", schema.QUERYLY).alias("_response"))
    total = F.coalesce(F.col("_response.metadata.total"), F.lit(0).cast("long"))
    rows = parsed.select(
        *others, total.alias("total"), F.posexplode("_response.items").alias("pos", "item")
    )
    found = rows.select(
        *others, "total", "pos",
        _first_key(F.col("item"), ["link", "url", "permalink"]).alias("link"),
        _first_key(F.col("item"), ["pubdate", "date", "pubDate"]).alias("_shown"),
    ).filter("link IS NOT NULL")
    return found.withColumn("fecha", dates.parse_date(F.col("_shown"), formats)).drop("_shown")


def unwrap_jsonp(col: Column) -> Column:
    """JSON text inside ``JSON.parse('…');`` or inside ``callback({…});``.

    In the first form the text is a script string whose escapes are decoded.
    """
    quoted = F.regexp_extract(col, r"(?s)JSON\.parse\('(.+?)'\);", 1)
    # Re-quote the script string as a JSON string and let the JSON reader decode it.
    as_json = F.regexp_replace(quoted, r"\\'", "'")
    as_json = F.regexp_replace(as_json, r"\\x([0-9A-Fa-f]{2})", r"\\u00$1")
    as_json = F.regexp_replace(as_json, r'(?<!\\)((?:\\\\)*)"', r'$1\\"')
    decoded = F.from_json(
        F.concat(F.lit('["'), as_json, F.lit('"]')), "array<string>",
        {"allowUnquotedControlChars": "true"},
    )
    called = F.regexp_extract(col, r"(?s)\(\s*([{\[].*[}\]])\s*\)", 1)
    return F.when(quoted != "", F.get(decoded, F.lit(0))).otherwise(called)


def read_rss(payloads: DataFrame) -> DataFrame:
    """RSS feeds: ``guid`` as link, ``pubDate`` as date; items without guid dropped."""
    feed = F.from_xml(F.col("body"), schema.RSS_FEED, {"rowTag": "rss"})
    rows = _items(payloads.withColumn("_feed", feed), F.col("_feed.channel.item"))
    return (
        rows.withColumn("link", F.trim("item.guid"))
        .withColumn("fecha", dates.rfc2822(F.col("item.pubDate")))
        .drop("item", "_feed")
        .filter("link <> ''")
    )

