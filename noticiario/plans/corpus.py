"""Corpus building: searches, topic merge, backup, and the run over all departments.

Input is a candidate table: articles as the searches of the sources found them,

``fuente, termino, periodico, titulo, fecha, texto, url`` (+ tie-break columns),

and a search plan (:func:`noticiario.sources.registry.search_plan`). All
departments, topics and sources are built by one job: the plan is small and is
broadcast after a size check, so candidates are filtered where they are read.

Relevant rows are stored once, each with a number. Everything that is decided about
them, which copy of a URL stays, its terms, who needs a backup, is decided on an index
without titles and texts; the numbers of the rows that stay are then joined to the
stored rows, so texts are never aggregated and shuffled once at most.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticiario import schema
from noticiario.functions.text import DEFAULT_MIN_MENTIONS
from noticiario.operators import reports
from noticiario.operators.dedup import recent_first
from noticiario.operators.filters import effective_minimum, in_date_range, is_relevant
from noticiario.operators.joins import zero_result_sources
from noticiario.operators.sets import order_by_config
from noticiario.session import broadcast_if_small, is_small, pin, shared_table
from noticiario.sources.dimensions import FALLBACK, MIN_ARTICLES, TOPICS
from noticiario.sources.manifest import file_states, manifest, run_summary
from noticiario.sources.registry import BACKUP, LOCAL, STAND_IN, search_terms
from noticiario.sources.writers import existing_corpus, resume_plan, write_corpus

# How an intermediate result that is read twice is kept: a function of the frame.
# Stored once by default, so that candidates and their texts are scanned once. Another
# way must keep the generated row numbers as well.
Settle = Callable[[DataFrame], DataFrame]

# Number of a relevant row in the stored table.
_ROW = "_fila"
# Slices of a URL in the index, as one URL may hold a large share of the rows.
INDEX_SALTS = 16
# Bytes of text that one stored file of a department should hold.
FILE_BYTES = 256 * 1024 * 1024


def match_plan(
    candidates: DataFrame, plan: DataFrame, lo: str | None = None, hi: str | None = None
) -> DataFrame:
    """Candidates that belong to a search of the plan, in the window and relevant.

    Adds the plan columns. Dates are tested before the join and mentions after it,
    as the threshold belongs to the search.
    """
    rows = candidates
    if lo is not None and hi is not None:
        rows = rows.filter(in_date_range(F.col("fecha"), lo, hi))
    matched = rows.join(broadcast_if_small(plan), ["fuente", "termino"])
    return matched.filter(is_relevant(F.col("umbral"), F.col("territorio")))


def _with_stand_in(matched: DataFrame, plan: DataFrame, per: Sequence[str]) -> DataFrame:
    """Rows of the plan's own sources, plus the stand-in source's rows for each
    search in which a local source returned nothing.

    The stand-in is taken at most once per search.
    """
    own = F.col("origen") == LOCAL
    missing = zero_result_sources(
        plan.filter(own), matched.filter(own), [*per, "fuente"]
    )
    return _keep_needed(matched, missing.select(*per).distinct(), per, is_small(plan))


def _keep_needed(
    matched: DataFrame, needed: DataFrame, per: Sequence[str], small: bool
) -> DataFrame:
    """Without the stand-in rows of searches that are not in ``needed``.

    ``needed`` has at most one row per search of the plan, so it may be broadcast
    where the plan is small.
    """
    flagged = needed.withColumn("_needed", F.lit(True))
    return (
        matched.join(F.broadcast(flagged) if small else flagged, list(per), "left")
        .filter((F.col("origen") != STAND_IN) | F.col("_needed"))
        .drop("_needed")
    )


def first_found(tie: Sequence[str]) -> list[Column]:
    """Order in which the copies of a URL are found: topic, latest date, source."""
    return [F.col("tema_pos"), *recent_first(), F.col("fuente_pos"), *map(F.col, tie)]


# ── Narrow index, wide rows ──────────────────────────────────────────────────


def _numbered(rows: DataFrame, settle: Settle) -> DataFrame:
    return settle(rows.withColumn(_ROW, F.monotonically_increasing_id()))


def _index(stored: DataFrame, place: str, tie: Sequence[str]) -> DataFrame:
    """What decides about the stored rows, without their texts.

    A text among the tie columns enters as its hash, which breaks ties as repeatably.
    """
    fixed = [
        _ROW, place, "url", "fecha", "tema", "tema_pos", "fuente", "fuente_pos", "is_national",
        "origen",
    ]
    return stored.select(
        *fixed, F.coalesce(F.octet_length("texto"), F.lit(0)).cast("long").alias("_bytes"),
        *[F.xxhash64(n).alias("_texto") if n == "texto" else n for n in tie if n not in fixed],
    )


def _winners(
    index: DataFrame, place: str, tie: Sequence[str], salts: int = INDEX_SALTS
) -> DataFrame:
    """Row number of the first copy of each URL of a place, with the merged terms.

    Local copies come before those of backup sources. Columns: the row number, its
    bytes of text, ``_only_backup`` and ``terminos_encontrado``. A group is first cut
    in slices of its row numbers, so a hot URL is spread over tasks; a slice hands on
    one row and its few terms.
    """
    names = ["_texto" if name == "texto" else name for name in tie]
    backup = F.col("origen") == BACKUP
    order = F.struct(backup, *first_found(names), F.col(_ROW))
    slices = (
        index.withColumn("_slice", F.pmod(F.col(_ROW), F.lit(salts)))
        .groupBy(place, "url", "_slice")
        .agg(
            F.min_by(F.struct(_ROW, "_bytes"), order).alias("_first"), F.min(order).alias("_order"),
            F.min(backup).alias("_only_backup"),
            F.collect_set(F.when(~backup, F.col("tema"))).alias("_local"),
            F.collect_set(F.when(backup, F.col("tema"))).alias("_backup"),
        )
    )

    def terms(name: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))), ", ")

    merged = slices.groupBy(place, "url").agg(
        F.min_by("_first", "_order").alias("_first"), F.min("_only_backup").alias("_only_backup"),
        terms("_local").alias("_local"), terms("_backup").alias("_backup"),
    )
    found = F.when(F.col("_only_backup"), F.col("_backup")).otherwise(F.col("_local"))
    return merged.select(
        place, F.col(f"_first.{_ROW}").alias(_ROW), F.col("_first._bytes").alias("_bytes"),
        "_only_backup", F.when(F.col("url").isNotNull(), found).alias("terminos_encontrado"),
    )


def _picked(stored: DataFrame, winners: DataFrame, place: str) -> DataFrame:
    """The stored rows that won, with their terms; one join by row number."""
    terms = broadcast_if_small(winners.select(_ROW, "terminos_encontrado"))
    return stored.join(terms, _ROW).select(*schema.CANONICAL, "terminos_encontrado", place)


def _picked_by_file(stored: DataFrame, winners: DataFrame, place: str) -> DataFrame:
    """The same, dealt out as the rows are to be stored: about ``FILE_BYTES`` a task.

    Each place has as many slots as its texts need. Stored rows and winners are dealt by
    place and slot together and matched by a window over the row number there, since a
    join would deal them anew by row number and the write a second time by place.
    """
    slots = winners.groupBy(place).agg(
        F.greatest(F.ceil(F.sum("_bytes") / FILE_BYTES), F.lit(1)).alias("_slots")
    )
    slots = pin(slots, "slots")  # one row for each place of the plan
    tasks = int(slots.agg(F.sum("_slots")).first()[0] or 1)
    columns = [name for name in schema.CANONICAL]
    both = (
        stored.select(_ROW, place, *columns)
        .unionByName(winners.select(_ROW, place, "terminos_encontrado", F.lit(True).alias("_won")),
                     allowMissingColumns=True)
        .join(broadcast_if_small(slots), place)
        .withColumn("_slot", F.pmod(F.xxhash64(_ROW), F.col("_slots")))
    )
    same = Window.partitionBy(place, "_slot", _ROW)
    return (
        both.repartition(tasks, place, "_slot")
        .withColumn("terminos_encontrado", F.max("terminos_encontrado").over(same))
        .withColumn("_kept", F.max("_won").over(same))
        .filter(F.col("_kept") & F.col("_won").isNull())
        .select(*columns, "terminos_encontrado", place)
    )


# ── One search, several topics ───────────────────────────────────────────────


def search_sources(
    candidates: DataFrame,
    plan: DataFrame,
    lo: str | None = None,
    hi: str | None = None,
    settle: Settle = shared_table,
) -> DataFrame:
    """Articles of every search of the plan: canonical columns and their search.

    Includes the stand-in source where a local one found nothing; ``BACKUP`` rows
    of the plan are not searched.
    """
    plan = plan.filter(F.col("origen") != BACKUP)
    matched = _numbered(match_plan(candidates, plan, lo, hi), settle)
    return _with_stand_in(matched, plan, ["departamento", "tema"]).drop(_ROW)


def search_topics(
    candidates: DataFrame,
    plan: DataFrame,
    lo: str | None = None,
    hi: str | None = None,
    tie: Sequence[str] = ("fuente", "titulo"),
    settle: Settle = shared_table,
) -> DataFrame:
    """All topics of each department merged: one row per URL with its terms."""
    plan = plan.filter(F.col("origen") != BACKUP)
    stored = _numbered(match_plan(candidates, plan, lo, hi), settle)
    index = _with_stand_in(_index(stored, "departamento", tie), plan, ["departamento", "tema"])
    return _picked(stored, _winners(index, "departamento", tie), "departamento")


def municipality_corpus(
    candidates: DataFrame,
    municipalities: DataFrame,
    sources: DataFrame,
    topics: Sequence[str] = tuple(TOPICS),
    min_mentions: int = DEFAULT_MIN_MENTIONS,
    lo: str | None = None,
    hi: str | None = None,
    fallback: str | None = FALLBACK,
    tie: Sequence[str] = ("fuente", "titulo"),
    settle: Settle = shared_table,
) -> DataFrame:
    """Merged topics of each municipality, searched in the given sources.

    All municipalities share one source list, so terms and sources are joined one
    after the other instead of being multiplied into a plan. ``fallback`` stands in
    for searches in which a local source returned nothing, unless it is in the list.
    """
    listed = pin(sources.select(F.col("id").alias("fuente"), "is_national"))
    stands_in = fallback is not None and listed.filter(F.col("fuente") == fallback).isEmpty()
    reach = listed.withColumn("origen", F.lit(LOCAL))
    if stands_in:
        reach = reach.unionByName(
            reach.limit(1).select(
                F.lit(fallback).alias("fuente"), F.lit(True).alias("is_national"),
                F.lit(STAND_IN).alias("origen"),
            )
        )
    searches = search_terms(municipalities.select("municipio").distinct(), topics, "municipio")

    rows = candidates
    if lo is not None and hi is not None:
        rows = rows.filter(in_date_range(F.col("fecha"), lo, hi))
    minimum = effective_minimum(min_mentions, F.col("is_national"))
    joined = rows.join(broadcast_if_small(reach), "fuente").join(
        broadcast_if_small(searches), "termino"
    )
    stored = _numbered(joined.filter(is_relevant(minimum, F.col("territorio"))), settle)
    found = _index(stored.withColumn("fuente_pos", F.lit(0)), "municipio", tie)
    if stands_in:
        per = ["municipio", "tema"]
        local = ~F.col("is_national") & (F.col("origen") == LOCAL)
        active = found.filter(local).groupBy(*per).agg(F.count_distinct("fuente").alias("_n"))
        expected = listed.filter(~F.col("is_national")).count()
        needed = (
            searches.select(*per).join(active, per, "left")
            .filter(F.coalesce("_n", F.lit(0)) < expected).select(*per)
        )
        found = _keep_needed(found, needed, per, is_small(searches))
    return _picked(stored, _winners(found, "municipio", tie), "municipio")


# ── Departments with backup ──────────────────────────────────────────────────


def department_corpus(
    candidates: DataFrame,
    plan: DataFrame,
    lo: str | None = None,
    hi: str | None = None,
    min_articles: int = MIN_ARTICLES,
    use_backup: bool = True,
    tie: Sequence[str] = ("fuente", "titulo"),
    settle: Settle = shared_table,
) -> DataFrame:
    """Corpus of every department of the plan, topped up where it is thin.

    Local and backup rows are read in one scan: each URL keeps its first local copy with
    the local terms, or else its first backup copy with the backup terms. Backup-only
    URLs are then dropped for departments that have ``min_articles`` local ones.
    ``settle`` keeps the relevant rows; all decisions read an index of them, and the
    rows that stay are joined to it once.
    """
    stored, winners = _department_winners(
        candidates, plan, lo, hi, min_articles, use_backup, tie, settle
    )
    columns = [field.name for field in schema.CORPUS.fields]
    return _picked(stored, winners, "departamento").select(*columns)


def _department_winners(
    candidates: DataFrame, plan: DataFrame, lo: str | None, hi: str | None, min_articles: int,
    use_backup: bool, tie: Sequence[str], settle: Settle,
) -> tuple[DataFrame, DataFrame]:
    """The stored relevant rows of all departments, and which of them make the corpus."""
    if not use_backup:
        plan = plan.filter(F.col("origen") != BACKUP)
    stored = _numbered(match_plan(candidates, plan, lo, hi), settle)
    index = _index(stored, "departamento", tie)
    index = _with_stand_in(index, plan, ["departamento", "tema"])
    winners = _winners(index, "departamento", tie)
    if use_backup:
        winners = _drop_unneeded_backup(winners, min_articles, is_small(plan))
    return stored, winners


def _drop_unneeded_backup(grouped: DataFrame, min_articles: int, small: bool) -> DataFrame:
    """Without the backup-only URLs of departments with enough local articles."""
    enough = (
        grouped.groupBy("departamento")
        .agg(F.count_if(~F.col("_only_backup")).alias("_local"))
        .filter(F.col("_local") >= min_articles)
        .select("departamento", F.lit(True).alias("_enough"))
    )
    # At most one row per department of the plan.
    if small:
        enough = F.broadcast(enough)
    return (
        grouped.join(enough, "departamento", "left")
        .filter(~F.col("_only_backup") | F.col("_enough").isNull())
        .drop("_enough")
    )


def all_departments_corpus(
    candidates: DataFrame,
    departments: DataFrame,
    plan: DataFrame,
    root: str,
    lo: str | None = None,
    hi: str | None = None,
    min_articles: int = MIN_ARTICLES,
    use_backup: bool = True,
    force: bool = False,
    tie: Sequence[str] = ("fuente", "titulo"),
    settle: Settle = shared_table,
) -> DataFrame:
    """Build and store the departments that are not stored yet; return all of them.

    Intermediate results read twice are stored in the shared folder, so candidates
    are scanned once. Texts are shuffled once, by department and file, and stored as they
    arrive. The result is read back from ``root``; :func:`run_report` sums it up.
    """
    pending = resume_plan(departments, root, force).select("departamento")
    # Pinned, as the stored partitions it depends on change while they are written.
    todo = pin(plan.join(pending, "departamento", "left_semi"))
    stored, winners = _department_winners(
        candidates, todo, lo, hi, min_articles, use_backup, tie, settle
    )
    winners = shared_table(winners, "winners")  # narrow; read for the slots and for the rows
    write_corpus(_picked_by_file(stored, winners, "departamento"), root, dealt=True)
    return existing_corpus(departments, root).select(
        *[field.name for field in schema.CORPUS.fields]
    )


def run_report(
    departments: DataFrame, root: str, errors: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Closing summary of the departments stored under ``root``; reads no article."""
    spark = departments.sparkSession
    states = pin(file_states(spark, root), "states")
    return run_summary(departments, states, manifest(spark, root), errors)


def in_department_order(corpus: DataFrame, departments: DataFrame) -> DataFrame:
    """Rows by configured department order, then latest first."""
    latest = F.col("fecha").desc_nulls_last()
    return order_by_config(corpus, departments, "departamento", [latest, "url"]).drop("pos")


def search_report(
    found: DataFrame, merged: DataFrame, topics: Sequence[str] = tuple(TOPICS)
) -> dict[str, DataFrame]:
    """Summary of a search: rows per topic, duplicates, coverage, sources, dates.

    ``found`` is the result of :func:`search_sources`, ``merged`` that of
    :func:`search_topics` or :func:`department_corpus`.
    """
    return {
        "temas": reports.term_counts(found, topics),
        "duplicados": reports.dedup_stats(found),
        "cobertura": reports.term_coverage(merged),
        "periodicos": reports.count_by_source(merged),
        "fechas": reports.date_span(merged),
    }
