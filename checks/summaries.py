"""Checks of the counting reports, the error report and the health check."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.registered import query
from checks.views import HI, LO, SCORE, shown, with_views
from noticiario.functions import text
from noticiario.operators import dedup, filters, joins, reports, sets
from noticiario.plans.health import error_report, health_report
from noticiario.sources.dimensions import TOPICS

_STAMP = "strftime({0}({1}), '%Y-%m-%d %H:%M:%S')"

# ── Corpus counts ────────────────────────────────────────────────────────────


@query(
    "count_by_source",
    with_views(["articles"], "SELECT periodico, count(*) AS n FROM articles GROUP BY 1"),
)
def count_by_source(spark, sf):
    return reports.count_by_source(views.articles(spark, sf))


@query(
    "count_by_department",
    with_views(
        ["articles"],
        "SELECT departamento, count(*) AS n FROM articles WHERE departamento <> 'El' GROUP BY 1",
    ),
)
def count_by_department(spark, sf):
    rows = views.articles(spark, sf).withColumn(
        "departamento", F.nullif("departamento", F.lit("El"))
    )
    return reports.count_by_department(rows)


@query(
    "term_coverage",
    with_views(
        ["articles"],
        "SELECT tema, count(DISTINCT url) AS n FROM articles WHERE url IS NOT NULL GROUP BY 1",
    ),
)
def term_coverage(spark, sf):
    return reports.term_coverage(dedup.terms_by_url(views.articles(spark, sf)))


@query(
    "term_counts",
    with_views(
        ["articles", "topics"],
        "SELECT CAST(tema_pos AS INTEGER) AS pos, tema, (SELECT count(*) FROM articles a WHERE a.tema = t.tema) AS n "
        "FROM topics t UNION ALL SELECT 5, 'ausente', 0",
    ),
)
def term_counts(spark, sf):
    return reports.term_counts(views.articles(spark, sf), [*TOPICS, "ausente"])


@query(
    "date_span",
    with_views(
        ["articles"],
        f"SELECT periodico, {_STAMP.format('min', 'fecha')} AS desde, {_STAMP.format('max', 'fecha')} AS hasta "
        "FROM articles GROUP BY 1",
    ),
)
def date_span(spark, sf):
    spans = reports.date_span(views.articles(spark, sf), "periodico")
    return spans.select("periodico", shown("desde"), shown("hasta"))


@query(
    "dedup_stats",
    with_views(
        ["articles"],
        """SELECT departamento, count(*) AS total, count(*) - unicos AS duplicados, unicos FROM (
          SELECT *, (SELECT count(DISTINCT coalesce(url, '?')) FROM articles b WHERE b.departamento = a.departamento)
          AS unicos FROM articles a) GROUP BY departamento, unicos""",
    ),
)
def dedup_stats(spark, sf):
    return reports.dedup_stats(views.articles(spark, sf), "departamento")


@query(
    "stage_counts",
    with_views(
        ["articles"],
        f"""SELECT periodico, count(*) AS total, count(*) FILTER (f) AS fecha_quedan,
          count(*) FILTER (NOT f) AS fecha_descartados, count(*) FILTER (f AND r) AS relevancia_quedan,
          count(*) FILTER (f AND NOT r) AS relevancia_descartados FROM (
            SELECT periodico, fecha IS NULL OR fecha BETWEEN TIMESTAMP '2023-01-01'
              AND TIMESTAMP '2023-12-31 23:59:59' AS f, {SCORE} >= 3 AS r FROM articles) GROUP BY 1""",
    ),
)
def stage_counts(spark, sf):
    stages = {
        "fecha": filters.in_date_range(F.col("fecha"), LO, HI),
        "relevancia": filters.is_relevant(3, F.lower("departamento")),
    }
    return reports.stage_counts(views.articles(spark, sf), stages, "periodico")


@query(
    "success_rate",
    with_views(
        ["listing"],
        """SELECT periodico, termino, count(*) AS enlaces, count(fecha) AS descargados,
          count(*) - count(fecha) AS fallos, round(count(fecha) / count(*) * 100, 1) AS pct
          FROM listing GROUP BY ALL""",
    ),
)
def success_rate(spark, sf):
    done = F.col("fecha").isNotNull()
    return reports.success_rate(views.listing(spark, sf), done, "periodico", "termino")


# ── Order and limit ──────────────────────────────────────────────────────────


@query(
    "sort_recent",
    with_views(
        ["articles"],
        "SELECT doc_id, url, strftime(fecha, '%Y-%m-%d %H:%M:%S') AS fecha FROM articles",
    ),
)
def sort_recent(spark, sf):
    ordered = sets.sort_recent(views.articles(spark, sf), ["url", "doc_id"])
    return ordered.select("doc_id", "url", shown())


@query(
    "sort_counts",
    with_views(["errors"], "SELECT tipo, count(*) AS n FROM errors GROUP BY 1"),
)
def sort_counts(spark, sf):
    counts = views.errors(spark, sf).groupBy("tipo").agg(F.count("*").alias("n"))
    return sets.sort_counts(counts, "tipo")


@query(
    "order_by_config",
    with_views(
        ["articles", "departments"],
        "SELECT departamento, pos, count(*) AS n FROM articles JOIN departments USING (departamento) GROUP BY ALL",
    ),
)
def order_by_config(spark, sf):
    counts = reports.count_by_department(views.articles(spark, sf))
    return sets.order_by_config(counts, views.departments(spark), "departamento")


@query(
    "head",
    with_views(
        ["articles"],
        "SELECT doc_id, titulo FROM articles ORDER BY fecha DESC NULLS LAST, doc_id LIMIT 20",
    ),
)
def head(spark, sf):
    order = [F.col("fecha").desc_nulls_last(), F.col("doc_id")]
    return sets.head(views.articles(spark, sf), 20, order).select("doc_id", "titulo")


# ── Errors ───────────────────────────────────────────────────────────────────


@query(
    "classify_error",
    """SELECT event_id, CASE WHEN event_type = 'error' AND user_id % 2 = 0 OR contains(lower(props || event_type), '28')
      OR event_type = 'view' THEN 'TimeoutError' WHEN event_type = 'error' THEN 'ValueError' ELSE event_type END AS tipo
      FROM events""",
)
def classify_error(spark, sf):
    kind = (
        F.when((F.col("event_type") == "error") & (F.col("user_id") % 2 == 0), "TimeoutError")
        .when(F.col("event_type") == "error", "ValueError")
        .otherwise(F.col("event_type"))
    )
    message = F.when(F.col("event_type") == "view", "Request Timed Out").otherwise(F.col("props"))
    return views.read(spark, sf, "events").select(
        "event_id", reports.classify_error(kind, message).alias("tipo")
    )


_COUNTED = "SELECT periodico, tipo, count(*) AS n FROM errors GROUP BY ALL"
_NOTED = f"""SELECT *, CASE WHEN tipo = 'PrimeraPagina' THEN 'primera página no cargó'
  WHEN n >= 200 THEN 'posible bloqueo total' WHEN n >= 50 THEN 'muchos fallos' ELSE '' END AS nota FROM ({_COUNTED})"""


@query("error_counts", with_views(["errors"], _COUNTED))
def error_counts(spark, sf):
    return reports.error_counts(views.errors(spark, sf))


@query("error_notes", with_views(["errors"], _NOTED))
def error_notes(spark, sf):
    return reports.error_notes(reports.error_counts(views.errors(spark, sf)))


@query(
    "error_notes_by_type",
    with_views(
        ["errors"],
        _NOTED.replace("SELECT periodico, tipo, count(*)", "SELECT 'todos' AS periodico, tipo, count(*)"),
    ),
)
def error_notes_by_type(spark, sf):
    """One source with all errors, so that the higher notes occur."""
    rows = views.errors(spark, sf).withColumn("periodico", F.lit("todos"))
    return reports.error_notes(reports.error_counts(rows))


@query("sort_errors", with_views(["errors"], _COUNTED))
def sort_errors(spark, sf):
    return reports.sort_errors(reports.error_counts(views.errors(spark, sf)))


@query("error_report", with_views(["errors"], _NOTED))
def error_report_table(spark, sf):
    return error_report(views.errors(spark, sf))[0]


@query(
    "error_totals",
    with_views(["errors"], "SELECT count(*) AS eventos, count(DISTINCT periodico) AS periodicos FROM errors"),
)
def error_totals(spark, sf):
    return reports.error_totals(views.errors(spark, sf))


# ── Health ───────────────────────────────────────────────────────────────────

_HEALTH = """health AS (SELECT id, CASE WHEN failure IS NOT NULL THEN 'Roto'
    WHEN arts > 0 AND tiempo_s >= 60 THEN 'Lento' WHEN arts > 0 THEN 'OK'
    WHEN http_status BETWEEN 200 AND 399 THEN 'Sin_resultados' ELSE 'Roto' END AS status,
  CASE WHEN failure IS NOT NULL THEN 0 ELSE arts END AS arts, tiempo_s, tipo, http_status,
  CASE WHEN failure IS NOT NULL THEN failure WHEN arts > 0 THEN NULL
    WHEN http_status BETWEEN 200 AND 399
      THEN '0 arts en 90 días para ''' || termino || ''' (sitio HTTP ' || http_status || ' OK)'
    ELSE '0 arts y sitio inaccesible (HTTP=' || coalesce(CAST(http_status AS VARCHAR), 'None') || ')' END AS error
  FROM runs)"""
_BY_STATUS = """count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (status = 'Lento') AS lento,
  count(*) FILTER (status = 'Sin_resultados') AS sin_resultados, count(*) FILTER (status = 'Roto') AS roto"""


def _health_sql(body: str) -> str:
    return with_views(["runs"], "").rstrip() + f", {_HEALTH} {body}"


@query("health_status", _health_sql("SELECT * FROM health"))
def health_status(spark, sf):
    return health_report(views.runs(spark, sf))[0]


@query("health_summary", _health_sql(f"SELECT count(*) AS total, {_BY_STATUS} FROM health"))
def health_summary(spark, sf):
    return health_report(views.runs(spark, sf))[1]


@query("health_by_type", _health_sql(f"SELECT tipo, {_BY_STATUS} FROM health GROUP BY tipo"))
def health_by_type(spark, sf):
    return health_report(views.runs(spark, sf))[2]


# ── Progress over customers as departments, nations as groups ────────────────

_MARKED = """SELECT c_nationkey AS grupo, o_custkey IS NOT NULL AS hecho FROM customer
  LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') ON o_custkey = c_custkey"""
_PROGRESS = f"""SELECT *, CASE WHEN completados = total THEN 'LISTO' WHEN completados > 0 THEN 'EN CURSO'
  ELSE 'PENDIENTE' END AS estado FROM (SELECT grupo, count(*) FILTER (hecho) AS completados, count(*) AS total
  FROM ({_MARKED}) GROUP BY 1)"""


def _groups(spark, sf):
    return views.read(spark, sf, "customer").select(
        F.col("c_nationkey").alias("grupo"), F.col("c_name").alias("departamento")
    )


def _finished(spark, sf):
    orders = views.read(spark, sf, "orders").filter("o_orderstatus = 'F'")
    names = views.read(spark, sf, "customer").select("c_custkey", "c_name")
    return orders.join(names, F.col("o_custkey") == F.col("c_custkey")).select(
        F.upper("c_name").alias("departamento")
    )


@query("group_progress", _PROGRESS)
def group_progress(spark, sf):
    return reports.group_progress(_groups(spark, sf), _finished(spark, sf))


@query(
    "overall_progress",
    f"SELECT CAST(sum(completados) AS BIGINT) AS completados, CAST(sum(total) AS BIGINT) AS total FROM ({_PROGRESS})",
)
def overall_progress(spark, sf):
    return reports.overall_progress(reports.group_progress(_groups(spark, sf), _finished(spark, sf)))


@query(
    "pending_departments",
    "SELECT c_name AS departamento, c_nationkey AS grupo FROM customer WHERE c_custkey NOT IN "
    "(SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
)
def pending_departments(spark, sf):
    done = _finished(spark, sf).select(F.initcap("departamento").alias("departamento"))
    return joins.pending_departments(_groups(spark, sf), done)


@query(
    "orphan_files",
    "SELECT DISTINCT o_custkey AS n, lower(c_name) AS slug FROM orders JOIN customer ON o_custkey = c_custkey "
    "WHERE c_nationkey >= 5 UNION ALL SELECT s_suppkey, lower(s_name) FROM supplier",
)
def orphan_files(spark, sf):
    """Stored names, by slug, that no group of the first five nations expects.

    Names are stored for every customer with an order and for every supplier.
    """
    stored = views.read(spark, sf, "orders").select("o_custkey").distinct()
    customers = views.read(spark, sf, "customer")
    names = stored.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("n"), F.col("c_name").alias("name")
    )
    others = views.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("n"), F.col("s_name").alias("name"))
    inventory = names.unionByName(others).select("n", text.slug(F.col("name")).alias("slug"))
    expected = customers.filter("c_nationkey < 5").select(text.slug(F.col("c_name")).alias("slug"))
    return joins.orphan_files(inventory, expected, "slug")
