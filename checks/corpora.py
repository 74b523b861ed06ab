"""Checks of deduplication, unions and the corpus jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.registered import query
from checks.views import BACKUP, HI, LO, shown, with_views
from noticiario.operators import dedup, joins, sets
from noticiario.plans import corpus

_FECHA = "strftime(fecha, '%Y-%m-%d %H:%M:%S') AS fecha"
_RECENT = "fecha DESC NULLS LAST"


def _recent():
    return [*dedup.recent_first(), F.col("doc_id")]


# ── Deduplication ────────────────────────────────────────────────────────────


@query(
    "terms_by_url",
    with_views(
        ["articles"],
        "SELECT url, string_agg(DISTINCT tema, ', ' ORDER BY tema) AS terminos_encontrado FROM articles "
        "WHERE url IS NOT NULL GROUP BY url",
    ),
)
def terms_by_url(spark, sf):
    return dedup.terms_by_url(views.articles(spark, sf))


_FIRST = f"""SELECT doc_id, url, titulo, {_FECHA}, texto FROM articles
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY {_RECENT}, doc_id) = 1"""


@query("dedup_keep_first", with_views(["articles"], _FIRST))
def dedup_keep_first(spark, sf):
    first = dedup.dedup_keep_first(views.articles(spark, sf), _recent())
    return first.select("doc_id", "url", "titulo", shown(), "texto")


@query("dedup_keep_first_salted", with_views(["articles"], _FIRST))
def dedup_keep_first_salted(spark, sf):
    first = dedup.dedup_keep_first(views.articles(spark, sf), _recent(), salts=16)
    return first.select("doc_id", "url", "titulo", shown(), "texto")


@query(
    "dedup_titles",
    with_views(
        ["articles"],
        f"""SELECT doc_id, periodico, titulo FROM (
          SELECT *  REPLACE (CASE WHEN doc_id % 8 = 0 THEN NULL ELSE titulo END AS titulo) FROM articles)
          QUALIFY row_number() OVER (PARTITION BY periodico, titulo ORDER BY {_RECENT}, doc_id) = 1""",
    ),
)
def dedup_titles(spark, sf):
    titled = F.when(F.col("doc_id") % 8 != 0, F.col("titulo"))
    rows = views.articles(spark, sf).withColumn("titulo", titled)
    return dedup.dedup_titles(rows, _recent()).select("doc_id", "periodico", "titulo")


_MERGED = f"""SELECT f.doc_id, f.url, f.titulo, {_FECHA.replace('fecha,', 'f.fecha,')},
    t.terminos_encontrado FROM (SELECT * FROM articles
      QUALIFY row_number() OVER (PARTITION BY url ORDER BY tema_pos, {_RECENT}, doc_id) = 1) f
  LEFT JOIN (SELECT url, string_agg(DISTINCT tema, ', ' ORDER BY tema) AS terminos_encontrado
    FROM articles WHERE url IS NOT NULL GROUP BY url) t ON f.url = t.url"""


@query("merge_by_url", with_views(["articles"], _MERGED))
def merge_by_url(spark, sf):
    merged = dedup.merge_by_url(views.articles(spark, sf), [F.col("tema_pos"), *_recent()])
    return merged.select("doc_id", "url", "titulo", shown(), "terminos_encontrado")


@query("merge_by_url_salted", with_views(["articles"], _MERGED))
def merge_by_url_salted(spark, sf):
    order = [F.col("tema_pos"), *_recent()]
    merged = dedup.merge_by_url(views.articles(spark, sf), order, salts=16)
    return merged.select("doc_id", "url", "titulo", shown(), "terminos_encontrado")


@query("attach_terms", with_views(["articles"], _MERGED))
def attach_terms(spark, sf):
    """The same as three separate steps."""
    rows = views.articles(spark, sf)
    first = dedup.dedup_keep_first(rows, [F.col("tema_pos"), *_recent()])
    merged = dedup.attach_terms(first, dedup.terms_by_url(rows))
    return merged.select("doc_id", "url", "titulo", shown(), "terminos_encontrado")


# ── Unions and differences ───────────────────────────────────────────────────


@query(
    "union_sources",
    """SELECT source AS periodico, split_part(text, chr(10), 1) AS titulo,
        CASE WHEN doc_id % 3 <> 0 THEN '2023-05-01 15:30:00' END AS fecha, text AS texto,
        CAST(NULL AS VARCHAR) AS url FROM documents
      UNION ALL SELECT 'web', NULL, NULL, html, url FROM pages""",
)
def union_sources(spark, sf):
    docs = views.read(spark, sf, "documents").select(
        F.col("source").alias("periodico"), F.col("text").alias("texto"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("titulo"),
        F.when(F.col("doc_id") % 3 == 0, "ayer").otherwise("2023-05-01T10:30:00-05:00").alias("fecha"),
    )
    pages = views.read(spark, sf, "pages").select(
        F.lit("web").alias("periodico"), F.col("html").alias("texto"), "url"
    )
    return sets.union_sources([docs, pages]).withColumn("fecha", shown())


@query(
    "union_backup",
    with_views(
        ["articles"],
        f"""SELECT doc_id, url, {_FECHA}, periodico FROM articles
          QUALIFY row_number() OVER (PARTITION BY url
            ORDER BY periodico IN ('src18', 'src19'), {_RECENT}, doc_id) = 1""",
    ),
)
def union_backup(spark, sf):
    rows = views.articles(spark, sf)
    national = F.col("periodico").isin(*BACKUP)
    both = sets.union_backup(rows.filter(~national), rows.filter(national), tie=[F.col("doc_id")])
    return both.select("doc_id", "url", shown(), "periodico")


@query(
    "union_departments",
    with_views(["articles"], "SELECT doc_id, departamento, url, titulo, texto FROM articles"),
)
def union_departments(spark, sf):
    rows = views.articles(spark, sf).select("doc_id", "departamento", "url", "titulo", "texto")
    parts = [rows.filter(F.col("departamento") == name) for name in views.DEPARTMENTS]
    return sets.union_departments(parts)


@query(
    "difference",
    "SELECT DISTINCT c_custkey AS clave FROM customer EXCEPT SELECT user_id FROM events",
)
def difference(spark, sf):
    customers = views.read(spark, sf, "customer").select(F.col("c_custkey").alias("clave"))
    users = views.read(spark, sf, "events").select(F.col("user_id").alias("clave"))
    return sets.difference(customers, users, "clave")


# ── Plan joins ───────────────────────────────────────────────────────────────


@query(
    "backup_candidates",
    with_views(
        ["routing"],
        """SELECT r.departamento, b.fuente FROM routing r CROSS JOIN (VALUES ('s3'), ('s10')) AS b(fuente)
          WHERE NOT list_contains(r.periodicos, b.fuente)""",
    ),
)
def backup_candidates(spark, sf):
    routes = views.routing(spark, sf)
    spare = F.array(F.lit("s3"), F.lit("s10"))
    wanted = routes.select("departamento", F.explode(spare).alias("fuente"))
    used = routes.select("departamento", F.explode("periodicos").alias("fuente"))
    return joins.backup_candidates(wanted, used, ["departamento", "fuente"])


@query(
    "zero_result_sources",
    with_views(
        ["sources", "requested"],
        "SELECT id AS fuente, is_national FROM sources WHERE NOT is_national AND id NOT IN "
        "(SELECT id FROM requested WHERE id NOT LIKE '%3')",
    ),
)
def zero_result_sources(spark, sf):
    planned = views.sources(spark, sf).select(F.col("id").alias("fuente"), "is_national")
    results = views.requested(spark, sf).filter("id NOT LIKE '%3'").select(F.col("id").alias("fuente"))
    return joins.zero_result_sources(planned, results)


# ── Jobs ─────────────────────────────────────────────────────────────────────


@query(
    "search_sources",
    with_views(
        ["found"],
        f"""SELECT departamento, tema, periodico, titulo, {_FECHA}, texto, url FROM found WHERE origen <> 2""",
    ),
)
def search_sources(spark, sf):
    found = corpus.search_sources(views.articles(spark, sf).drop("departamento", "tema", "tema_pos"),
                                  views.plan(spark), LO, HI)
    return found.select("departamento", "tema", "periodico", "titulo", shown(), "texto", "url")


_TERMS = "string_agg(DISTINCT tema, ', ' ORDER BY tema)"


@query(
    "search_topics",
    with_views(["found"], "").rstrip()
    + f""", local AS (SELECT * FROM found WHERE origen <> 2),
    terms AS (SELECT departamento, url, {_TERMS} AS terminos_encontrado FROM local WHERE url IS NOT NULL GROUP BY ALL),
    firsts AS (SELECT * FROM local QUALIFY row_number() OVER (PARTITION BY departamento, url
      ORDER BY tema_pos, {_RECENT}, fuente_pos, doc_id) = 1)
    SELECT f.periodico, f.titulo, strftime(f.fecha, '%Y-%m-%d %H:%M:%S') AS fecha, f.texto, f.url,
      t.terminos_encontrado, f.departamento
    FROM firsts f LEFT JOIN terms t ON f.departamento = t.departamento AND f.url = t.url""",
)
def search_topics(spark, sf):
    found = corpus.search_topics(views.articles(spark, sf).drop("departamento", "tema", "tema_pos"),
                                 views.plan(spark), LO, HI, tie=["doc_id"])
    return found.withColumn("fecha", shown())


DEPARTMENT_SQL = with_views(["found"], "").rstrip() + f""", ranked AS (
      SELECT *, row_number() OVER (PARTITION BY departamento, url
        ORDER BY origen = 2, tema_pos, {_RECENT}, fuente_pos, doc_id) AS rn FROM found),
    local_terms AS (SELECT departamento, url, {_TERMS} AS terms FROM found WHERE origen <> 2 GROUP BY ALL),
    backup_terms AS (SELECT departamento, url, {_TERMS} AS terms FROM found WHERE origen = 2 GROUP BY ALL),
    enough AS (SELECT departamento FROM ranked WHERE rn = 1 AND origen <> 2 GROUP BY 1 HAVING count(*) >= 50)
    SELECT f.periodico, f.titulo, strftime(f.fecha, '%Y-%m-%d %H:%M:%S') AS fecha, f.texto, f.url,
      CASE WHEN f.url IS NOT NULL THEN CASE WHEN f.origen = 2 THEN b.terms ELSE l.terms END END AS terminos_encontrado,
      f.departamento
    FROM ranked f
    LEFT JOIN local_terms l ON f.departamento = l.departamento AND f.url = l.url
    LEFT JOIN backup_terms b ON f.departamento = b.departamento AND f.url = b.url
    WHERE rn = 1 AND (f.origen <> 2 OR f.departamento NOT IN (SELECT departamento FROM enough))"""


@query("department_corpus", DEPARTMENT_SQL)
def department_corpus(spark, sf):
    built = corpus.department_corpus(
        views.articles(spark, sf).drop("departamento", "tema", "tema_pos"),
        views.plan(spark), LO, HI, tie=["doc_id"],
    )
    return built.withColumn("fecha", shown())


# All sources but the one that stands in.
_LISTED = [name for name in views.REGISTRY if name != views.FALLBACK]
_LISTED_SQL = ", ".join(f"'{name}'" for name in _LISTED)
_NATIONAL_SQL = ", ".join(f"'{name}'" for name in views.NATIONAL)
_LOCAL_COUNT = len(set(_LISTED) - set(views.NATIONAL))


@query(
    "municipality_corpus",
    with_views(["articles", "departments", "topics"], "").rstrip()
    + f""", reached AS (SELECT * FROM articles WHERE (fecha IS NULL OR fecha BETWEEN TIMESTAMP '2023-01-01'
        AND TIMESTAMP '2023-12-31 23:59:59') AND fuente IN ({_LISTED_SQL}, 'src19')
        AND {views.SCORE} >= CASE WHEN fuente IN ({_NATIONAL_SQL}) THEN 1 ELSE 4 END),
    active AS (SELECT departamento, tema FROM reached WHERE fuente NOT IN ({_NATIONAL_SQL}) GROUP BY ALL
      HAVING count(DISTINCT fuente) = {_LOCAL_COUNT}),
    hits AS (SELECT * FROM reached r WHERE fuente <> 'src19' OR NOT EXISTS (SELECT 1 FROM active a
      WHERE a.departamento = r.departamento AND a.tema = r.tema)),
    terms AS (SELECT departamento, url, {_TERMS} AS terminos_encontrado FROM hits WHERE url IS NOT NULL GROUP BY ALL),
    firsts AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY departamento, url
      ORDER BY tema_pos, {_RECENT}, doc_id) = 1)
    SELECT f.periodico, f.titulo, strftime(f.fecha, '%Y-%m-%d %H:%M:%S') AS fecha, f.texto, f.url,
      t.terminos_encontrado, f.departamento AS municipio
    FROM firsts f LEFT JOIN terms t ON f.departamento = t.departamento AND f.url = t.url""",
)
def municipality_corpus(spark, sf):
    places = views.departments(spark).select(F.col("departamento").alias("municipio"))
    listed = views.registry(spark).filter(F.col("id").isin(_LISTED))
    built = corpus.municipality_corpus(
        views.articles(spark, sf).drop("departamento", "tema", "tema_pos"), places,
        listed, views.TOPICS, 4, LO, HI, fallback="src19", tie=["doc_id"],
    )
    return built.withColumn("fecha", shown())


@query(
    "search_report",
    with_views(["found", "topics"], "").rstrip()
    + f""", local AS (SELECT * FROM found WHERE origen <> 2),
    firsts AS (SELECT * FROM local QUALIFY row_number() OVER (PARTITION BY departamento, url
      ORDER BY tema_pos, {_RECENT}, fuente_pos, doc_id) = 1),
    merged AS (SELECT DISTINCT departamento, url, tema FROM local WHERE url IS NOT NULL)
    SELECT 'temas' AS parte, tema AS clave, (SELECT count(*) FROM local l WHERE l.tema = t.tema) AS n,
      NULL AS desde, NULL AS hasta FROM topics t
    UNION ALL SELECT 'cobertura', tema, count(*), NULL, NULL FROM merged GROUP BY tema
    UNION ALL SELECT 'periodicos', periodico, count(*), NULL, NULL FROM firsts GROUP BY periodico
    UNION ALL SELECT 'duplicados', unnest(['total', 'unicos', 'duplicados']),
      unnest([n, u, n - u]), NULL, NULL FROM (SELECT count(*) AS n,
        count(DISTINCT coalesce(url, '?')) AS u FROM local)
    UNION ALL SELECT 'fechas', NULL, NULL, strftime(min(fecha), '%Y-%m-%d %H:%M:%S'),
      strftime(max(fecha), '%Y-%m-%d %H:%M:%S') FROM firsts""",
)
def search_report(spark, sf):
    """All parts of the report: topics, coverage, sources, duplicates and dates."""
    candidates = views.articles(spark, sf).drop("departamento", "tema", "tema_pos")
    plan = views.plan(spark)
    found = corpus.search_sources(candidates, plan, LO, HI)
    merged = corpus.search_topics(candidates, plan, LO, HI, tie=["doc_id"])
    parts = corpus.search_report(found, merged)
    keyed = {"temas": "tema", "cobertura": "tema", "periodicos": "periodico"}
    rows = [parts[p].select(F.lit(p).alias("parte"), F.col(k).alias("clave"), "n") for p, k in keyed.items()]
    counts = ["total", "unicos", "duplicados"]
    rows.append(parts["duplicados"].unpivot([], counts, "clave", "n").withColumn("parte", F.lit("duplicados")))
    rows.append(parts["fechas"].select(F.lit("fechas").alias("parte"), shown("desde"), shown("hasta")))
    return sets.union_all(rows)
