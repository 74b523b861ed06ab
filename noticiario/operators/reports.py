"""Aggregations behind the summaries, the error report and the health check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticiario.functions import text

# ── Corpus counts ────────────────────────────────────────────────────────────


def count_by(df: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Rows per value, most frequent first; nulls are not counted."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(n))
    return counts.orderBy(F.col(n).desc(), F.col(key))


def count_by_source(df: DataFrame) -> DataFrame:
    return count_by(df, "periodico")


def count_by_department(df: DataFrame) -> DataFrame:
    return count_by(df, "departamento")


def file_counts(df: DataFrame) -> DataFrame:
    """Articles per stored file, in file order; needs the ``archivo`` column."""
    return df.groupBy("archivo").agg(F.count("*").alias("n")).orderBy("archivo")


def term_coverage(df: DataFrame, terms: str = "terminos_encontrado") -> DataFrame:
    """Articles per term of the joined term lists."""
    return count_by(df.select(F.explode(F.split(terms, ", ")).alias("tema")), "tema")


def term_counts(df: DataFrame, topics: Sequence[str], term: str = "tema") -> DataFrame:
    """Articles per configured topic, in that order, zero where none was found.

    One conditional count per topic, so a topic with many rows stays in partial
    aggregation and the list of topics needs no join.
    """
    counts = df.agg(
        *[F.count_if(F.col(term) == topic).alias(f"_{i}") for i, topic in enumerate(topics)]
    )
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("pos"), F.lit(topic).alias("tema"), F.col(f"_{i}").alias("n"))
            for i, topic in enumerate(topics)
        ]
    )
    return counts.select(F.inline(rows))


def date_span(df: DataFrame, *keys: str) -> DataFrame:
    """Earliest and latest date, over all rows or per key."""
    return df.groupBy(*keys).agg(
        F.min("fecha").alias("desde"), F.max("fecha").alias("hasta")
    )


def dedup_stats(df: DataFrame, *keys: str) -> DataFrame:
    """Rows before deduplication, rows removed, rows left; null URLs count as one."""
    total, urls = F.count("*"), F.count_distinct("url")
    left = urls + F.max(F.col("url").isNull().cast("int"))
    stats = df.groupBy(*keys).agg(
        total.alias("total"), F.coalesce(left, F.lit(0)).alias("unicos")
    )
    return stats.select(
        *keys, "total", (F.col("total") - F.col("unicos")).alias("duplicados"), "unicos"
    )


def stage_counts(df: DataFrame, stages: dict[str, Column], *keys: str) -> DataFrame:
    """Rows that remain after each successive filter and rows it discards, one pass.

    ``stages`` maps a name to its keep condition, in order.
    """
    kept, aggregates = F.lit(True), [F.count("*").alias("total")]
    for name, condition in stages.items():
        before = kept
        kept = before & F.coalesce(condition, F.lit(False))
        aggregates += [
            F.count_if(kept).alias(f"{name}_quedan"),
            F.count_if(before & ~kept).alias(f"{name}_descartados"),
        ]
    return df.groupBy(*keys).agg(*aggregates)


def success_rate(links: DataFrame, downloaded: Column, *keys: str) -> DataFrame:
    """Links, downloads, failures and percentage of downloads."""
    counts = links.groupBy(*keys).agg(
        F.count("*").alias("enlaces"), F.count_if(downloaded).alias("descargados")
    )
    return counts.select(
        *keys, "enlaces", "descargados",
        (F.col("enlaces") - F.col("descargados")).alias("fallos"),
        F.round(F.col("descargados") / F.col("enlaces") * 100, 1).alias("pct"),
    )


# ── Errors ───────────────────────────────────────────────────────────────────

# Fixed values of the error report.
FIRST_PAGE = "PrimeraPagina"
TIMEOUT = "TimeoutError"
BLOCKED_FROM, MANY_FROM = 200, 50
NOTE_FIRST_PAGE = "primera página no cargó"
NOTE_BLOCKED = "posible bloqueo total"
NOTE_MANY = "muchos fallos"


def classify_error(kind: Column, message: Column) -> Column:
    """``TimeoutError`` for timeouts by type or by message, else the error type.

    The message test accepts any text holding ``28``, the transfer library's
    timeout code.
    """
    said = F.lower(F.coalesce(message, F.lit("")))
    timeout = (
        (kind == TIMEOUT) | said.contains("28")
        | said.contains("timeout") | said.contains("timed out")
    )
    return F.when(timeout, F.lit(TIMEOUT)).otherwise(kind)


def error_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("periodico", "tipo").agg(F.count("*").alias("n"))


def error_notes(counts: DataFrame) -> DataFrame:
    """Add a note to each counted (source, error type)."""
    n = F.col("n")
    note = (
        F.when(F.col("tipo") == FIRST_PAGE, NOTE_FIRST_PAGE)
        .when(n >= BLOCKED_FROM, NOTE_BLOCKED)
        .when(n >= MANY_FROM, NOTE_MANY)
        .otherwise("")
    )
    return counts.withColumn("nota", note)


def sort_errors(counts: DataFrame) -> DataFrame:
    """First-page errors first, then by count, then by source."""
    return counts.orderBy(
        F.when(F.col("tipo") == FIRST_PAGE, 0).otherwise(1), F.col("n").desc(), "periodico", "tipo"
    )


def error_totals(errors: DataFrame) -> DataFrame:
    return errors.agg(
        F.count("*").alias("eventos"), F.count_distinct("periodico").alias("periodicos")
    )


# ── Source health ────────────────────────────────────────────────────────────

# Fixed values of the health check.
STATUSES = ["OK", "Lento", "Sin_resultados", "Roto"]
SLOW_FROM_SECONDS = 60
HEALTH_DAYS = 90


def health_status(
    runs: DataFrame, slow_from: float = SLOW_FROM_SECONDS, days: int = HEALTH_DAYS
) -> DataFrame:
    """Add ``status`` and ``error`` to run records.

    ``runs``: ``id, termino, arts, tiempo_s, tipo, http_status, failure``. A run
    that failed is broken whatever it counted. ``days`` is the window the runs covered.
    """
    failed = F.col("failure").isNotNull()
    reachable = F.coalesce(F.col("http_status").between(200, 399), F.lit(False))
    status = (
        F.when(failed, "Roto")
        .when((F.col("arts") > 0) & (F.col("tiempo_s") >= slow_from), "Lento")
        .when(F.col("arts") > 0, "OK")
        .when(reachable, "Sin_resultados")
        .otherwise("Roto")
    )
    shown = F.coalesce(F.col("http_status").cast("string"), F.lit("None"))
    error = (
        F.when(failed, F.col("failure"))
        .when(F.col("arts") > 0, F.lit(None).cast("string"))
        .when(
            reachable,
            F.concat(
                F.lit(f"0 arts en {days} días para '"), F.col("termino"),
                F.lit("' (sitio HTTP "), shown, F.lit(" OK)"),
            ),
        )
        .otherwise(F.concat(F.lit("0 arts y sitio inaccesible (HTTP="), shown, F.lit(")")))
    )
    return runs.select(
        "id", status.alias("status"),
        F.when(failed, 0).otherwise(F.col("arts")).alias("arts"),
        F.round("tiempo_s", 1).alias("tiempo_s"),
        "tipo", "http_status", error.alias("error"),
    )


def health_summary(classified: DataFrame) -> DataFrame:
    """Total and runs per status in one row, zero where none."""
    return classified.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES],
    )


def health_by_type(classified: DataFrame) -> DataFrame:
    """Type by status matrix, zero-filled."""
    return (
        classified.groupBy("tipo")
        .agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES])
        .orderBy("tipo")
    )


def health_document(
    classified: DataFrame, lo: str, hi: str, seconds: float | None = None, day: str | None = None
) -> DataFrame:
    """The head of the report as one row: ``fecha, periodo, tiempo_total_s, resumen``.

    ``resumen`` has the runs in all and per status, and ``por_tipo``, a map of the same per
    type (as many entries as types). ``seconds`` is the time of the whole check, or else the
    sum of its runs; ``day`` the day of the check, or else today.
    """
    counted = lambda: [F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES]
    types = classified.filter("tipo IS NOT NULL").groupBy("tipo").agg(F.struct(*counted()).alias("n"))
    by_type = types.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tipo", "n")))).alias("por_tipo"))
    total = classified.agg(
        F.round(F.sum("tiempo_s") if seconds is None else F.max(F.lit(float(seconds))), 1).alias("tiempo_total_s"),
        F.count("*").alias("total"), *counted(),
    )
    fecha = F.date_format(F.current_date() if day is None else F.lit(day).cast("date"), "yyyy-MM-dd")
    return total.join(F.broadcast(by_type)).select(  # one row each
        fecha.alias("fecha"), F.lit(f"{lo} → {hi}").alias("periodo"), "tiempo_total_s",
        F.struct("total", *[s.lower() for s in STATUSES], "por_tipo").alias("resumen"),
    )


# ── Group progress ───────────────────────────────────────────────────────────


def group_progress(groups: DataFrame, stored: DataFrame) -> DataFrame:
    """Finished departments of each run group and its state.

    Departments are matched with stored ones by slug, as both are file names.
    """
    done = stored.select(text.slug(F.col("departamento")).alias("_slug")).distinct()
    marked = groups.withColumn("_slug", text.slug(F.col("departamento"))).join(
        done.withColumn("_done", F.lit(True)), "_slug", "left"
    )
    counts = marked.groupBy("grupo").agg(
        F.count_if("_done").alias("completados"), F.count("*").alias("total")
    )
    state = (
        F.when(F.col("completados") == F.col("total"), "LISTO")
        .when(F.col("completados") > 0, "EN CURSO")
        .otherwise("PENDIENTE")
    )
    return counts.withColumn("estado", state).orderBy("grupo")


def overall_progress(progress: DataFrame) -> DataFrame:
    return progress.agg(
        F.sum("completados").alias("completados"), F.sum("total").alias("total")
    )
