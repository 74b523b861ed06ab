"""Checks of the stored corpus, its reports and the streaming jobs.

Each query writes to a fresh place in the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.corpora import DEPARTMENT_SQL
from checks.registered import query
from checks.views import HI, LO, shown, with_views
from noticiario import schema
from noticiario.operators import dedup, reports, sets
from noticiario.plans import consolidate, corpus, progress
from noticiario.plans.health import health_report, write_health_document
from noticiario.session import estimated_bytes, shared_path
from noticiario.sources import manifest, readers, writers
from noticiario.sources.keys import KeyStore
from noticiario.streaming import arrivals

_RECENT = "fecha DESC NULLS LAST"
_FECHA = "strftime(fecha, '%Y-%m-%d %H:%M:%S') AS fecha"


def corpus_rows(spark, sf):
    """The articles in corpus shape; the topic stands for the merged terms."""
    return views.articles(spark, sf).withColumn("terminos_encontrado", F.col("tema"))


def stored(spark, sf, rows=None):
    root = shared_path(spark, "check")
    writers.write_corpus(corpus_rows(spark, sf) if rows is None else rows, root)
    return root


@query(
    "write_and_read_corpus",
    with_views(
        ["articles"],
        f"SELECT periodico, titulo, {_FECHA}, texto, url, tema AS terminos_encontrado, departamento FROM articles",
    ),
)
def write_and_read_corpus(spark, sf):
    rows = readers.read_corpus(spark, stored(spark, sf))
    return readers.require_columns(rows).withColumn("fecha", shown())


@query(
    "write_replaces_departments",
    with_views(
        ["articles"],
        "SELECT departamento, count(*) AS n, count(*) FILTER (url IS NULL) AS sin_url FROM articles "
        "WHERE departamento <> 'Der' OR fecha IS NOT NULL GROUP BY 1",
    ),
)
def write_replaces_departments(spark, sf):
    """A second write replaces one department and leaves the others."""
    root = stored(spark, sf)
    rows = corpus_rows(spark, sf)
    writers.write_corpus(rows.filter("departamento = 'Der' AND fecha IS NOT NULL"), root)
    return readers.read_corpus(spark, root, row_type=schema.CORPUS).groupBy("departamento").agg(
        F.count("*").alias("n"), F.count_if(F.col("url").isNull()).alias("sin_url")
    )


@query(
    "read_corpus_skips_bad_files",
    with_views(
        ["articles"],
        "SELECT departamento, count(*) AS n FROM articles GROUP BY 1 UNION ALL SELECT 'X', 0",
    ),
)
def read_corpus_skips_bad_files(spark, sf):
    """Articles stored beside files that are no Parquet; those are reported."""
    root = stored(spark, sf)
    broken = f"{root}/departamento=X/x.parquet"
    corpus_rows(spark, sf).select("titulo").write.text(broken)
    rows = readers.read_corpus(
        spark, root, tolerate_bad=True, row_type=schema.CORPUS, with_file=True
    )
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    listed = files.select(F.col("path").alias("archivo"))
    bad = readers.bad_files(listed, rows).select(
        F.regexp_extract("archivo", "departamento=([^/]*)/", 1).alias("departamento"),
        F.lit(0).cast("bigint").alias("n"),
    ).distinct()
    return rows.groupBy("departamento").agg(F.count("*").alias("n")).unionByName(bad)


@query(
    "corpus_inventory",
    with_views(["articles"], "SELECT DISTINCT departamento, true AS con_datos FROM articles"),
)
def corpus_inventory(spark, sf):
    files = readers.corpus_inventory(spark, stored(spark, sf))
    return files.groupBy("departamento").agg(
        (F.min(F.col("mb").isNotNull() & F.col("modificado").isNotNull())).alias("con_datos")
    )


@query(
    "file_counts",
    with_views(["articles"], "SELECT departamento, count(*) AS n FROM articles GROUP BY 1"),
)
def file_counts(spark, sf):
    """Articles per file, added up to departments as files may be split."""
    counts = reports.file_counts(readers.read_corpus(spark, stored(spark, sf), with_file=True))
    name = F.url_decode(F.regexp_extract("archivo", "departamento=([^/]*)/", 1))
    return counts.groupBy(F.url_decode(name).alias("departamento")).agg(F.sum("n").alias("n"))


@query(
    "resume_plan",
    with_views(["articles"], "SELECT DISTINCT departamento FROM articles WHERE departamento NOT IN ('The', 'El')"),
)
def resume_plan(spark, sf):
    rows = corpus_rows(spark, sf)
    root = stored(spark, sf, rows.filter("departamento IN ('The', 'El')"))
    return writers.resume_plan(rows.select("departamento").distinct(), root)


def behind_the_manifest(spark, sf, rows):
    """A store in which one department was replaced by another writer, and an empty one added."""
    root = stored(spark, sf, rows)
    columns = [field.name for field in schema.CORPUS.fields]
    dated = rows.filter("departamento = 'Der' AND fecha IS NOT NULL").select(*columns)
    (dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("departamento").parquet(root))
    rows.limit(0).select(*columns).drop("departamento").write.parquet(f"{root}/departamento=Vacio")
    return root


@query(
    "resume_plan_damaged",
    "SELECT unnest(['Der', 'Nuevo']) AS departamento",
)
def resume_plan_damaged(spark, sf):
    """A department whose committed files are gone is built again, an empty one is not."""
    rows = corpus_rows(spark, sf)
    root = behind_the_manifest(spark, sf, rows)
    more = spark.range(2).select(F.when(F.col("id") == 0, "Vacio").otherwise("Nuevo").alias("departamento"))
    return writers.resume_plan(rows.select("departamento").union(more).distinct(), root)


@query(
    "file_states",
    with_views(
        ["articles"],
        """SELECT departamento, 'bien' AS estado, count(*) AS filas FROM articles
          WHERE departamento <> 'Der' OR fecha IS NOT NULL GROUP BY 1
        UNION ALL SELECT 'Der', 'falta', count(*) FROM articles WHERE departamento = 'Der'
        UNION ALL SELECT 'Vacio', 'vacio', 0""",
    ),
)
def file_states_query(spark, sf):
    """Sound, missing and empty files, with the rows they hold or held."""
    root = behind_the_manifest(spark, sf, corpus_rows(spark, sf))
    states = manifest.file_states(spark, root)
    return states.groupBy("departamento", "estado").agg(F.sum("filas").alias("filas"))


@query(
    "run_summary",
    with_views(["articles"], "").rstrip()
    + f""", errors AS (SELECT ['The', 'Fuera'][user_id % 4 + 1] AS departamento FROM events WHERE event_type = 'error'),
    rows AS (SELECT pos, d.departamento, (SELECT count(*) FROM articles a WHERE a.departamento = d.departamento) AS articulos,
        (SELECT count(*) FROM errors e WHERE e.departamento = d.departamento) AS errores,
        (SELECT min(fecha) FROM articles a WHERE a.departamento = d.departamento) AS desde,
        (SELECT max(fecha) FROM articles a WHERE a.departamento = d.departamento) AS hasta
      FROM (SELECT * FROM (VALUES (1, 'The'), (2, 'De la'), (3, 'Der'), (4, 'El'), (5, 'Fuera')) AS t(pos, departamento)) d)
    SELECT pos, departamento, articulos, errores, CASE WHEN errores > 0 THEN 'con error' WHEN articulos > 0
        THEN 'con datos' ELSE 'sin datos' END AS estado, strftime(desde, '%Y-%m-%d %H:%M:%S') AS desde,
      strftime(hasta, '%Y-%m-%d %H:%M:%S') AS hasta FROM rows
    UNION ALL SELECT NULL, CAST(count(*) FILTER (articulos > 0) AS VARCHAR), CAST(sum(articulos) AS BIGINT),
      count(*) FILTER (errores > 0), CAST(count(*) AS VARCHAR), strftime(min(desde), '%Y-%m-%d %H:%M:%S'),
      strftime(max(hasta), '%Y-%m-%d %H:%M:%S') FROM rows""",
)
def run_summary_query(spark, sf):
    """Departments with data, without and failed, and the totals, from the manifest alone."""
    root = stored(spark, sf)
    places = views.departments(spark).select("pos", "departamento")
    places = places.union(places.filter("pos = 1").select(F.lit(5), F.lit("Fuera")))
    named = F.get(F.array(F.lit("The"), F.lit("Fuera")), (F.col("user_id") % 4).cast("int"))
    errors = views.read(spark, sf, "events").filter("event_type = 'error'").select(named.alias("departamento"))
    parts = corpus.run_report(places, root, errors)
    total = parts["total"].select(
        F.col("con_datos").cast("string").alias("departamento"), "articulos", F.col("con_error").alias("errores"),
        F.col("departamentos").cast("string").alias("estado"), "desde", "hasta",
    )
    both = sets.union_all([parts["departamentos"].drop("archivos"), total])
    return both.withColumns({name: F.date_format(name, "yyyy-MM-dd HH:mm:ss") for name in ("desde", "hasta")})


@query(
    "existing_corpus",
    with_views(["articles"], "SELECT departamento, url, titulo FROM articles WHERE departamento IN ('De la', 'El')"),
)
def existing_corpus(spark, sf):
    wanted = views.departments(spark).filter("departamento IN ('De la', 'El')")
    return writers.existing_corpus(wanted, stored(spark, sf)).select("departamento", "url", "titulo")


@query("all_departments_corpus", DEPARTMENT_SQL)
def all_departments_corpus(spark, sf):
    """Two departments are built first, the run then adds the others."""
    candidates = views.articles(spark, sf).drop("departamento", "tema", "tema_pos")
    root, plan = shared_path(spark, "check"), views.plan(spark)
    names = views.departments(spark)
    some = names.filter("pos <= 2")
    corpus.all_departments_corpus(candidates, some, plan, root, LO, HI, tie=["doc_id"])
    built = corpus.all_departments_corpus(candidates, names, plan, root, LO, HI, tie=["doc_id"])
    return built.withColumn("fecha", shown())


_SLUG = "CASE departamento WHEN 'De la' THEN 1 WHEN 'Der' THEN 2 WHEN 'El' THEN 3 ELSE 4 END"


def _clean_sql(before: str, after: str) -> str:
    slug = _SLUG
    return with_views(["articles"], "").rstrip() + f""", blanked AS (SELECT * REPLACE (
        CASE WHEN doc_id % 9 = 0 THEN '  ' ELSE texto END AS texto) FROM articles)
      SELECT departamento, url, titulo, {_FECHA}, texto FROM (SELECT * FROM blanked WHERE {before}
        QUALIFY row_number() OVER (PARTITION BY url ORDER BY {slug}, fecha DESC NULLS LAST, periodico, titulo, texto) = 1)
      WHERE {after}"""


def _blanked(spark, sf):
    blank = F.when(F.col("doc_id") % 9 == 0, "  ").otherwise(F.col("texto"))
    return corpus_rows(spark, sf).withColumn("texto", blank)


_FILLED = r"NOT regexp_matches(texto, '^\s*$')"


@query("consolidate", _clean_sql("true", _FILLED))
def consolidate_query(spark, sf):
    stored_rows = readers.read_corpus(spark, stored(spark, sf, _blanked(spark, sf)), tolerate_bad=True)
    order = consolidate.file_order(["periodico", "titulo", "texto"])
    cleaned = consolidate.clean(stored_rows, order)
    return cleaned.select("departamento", "url", "titulo", shown(), "texto")


@query("consolidate_content_first", _clean_sql(_FILLED, "true"))
def consolidate_content_first(spark, sf):
    stored_rows = readers.read_corpus(spark, stored(spark, sf, _blanked(spark, sf)), tolerate_bad=True)
    order = consolidate.file_order(["periodico", "titulo", "texto"])
    cleaned = consolidate.clean(stored_rows, order, content_first=True)
    return cleaned.select("departamento", "url", "titulo", shown(), "texto")


@query(
    "consolidate_report",
    _clean_sql("departamento <> 'Der' OR fecha IS NOT NULL", _FILLED).rsplit("SELECT departamento, url", 1)[0]
    + f""", present AS (SELECT * FROM blanked WHERE departamento <> 'Der' OR fecha IS NOT NULL),
    cleaned AS (SELECT * FROM (SELECT * FROM present QUALIFY row_number() OVER (PARTITION BY url
      ORDER BY {_SLUG}, fecha DESC NULLS LAST, periodico, titulo, texto) = 1) WHERE {_FILLED})
    SELECT 'duplicados' AS parte, unnest(['total', 'unicos', 'duplicados']) AS clave, unnest([n, u, n - u]) AS n,
      NULL AS desde, NULL AS hasta FROM (SELECT count(*) AS n, count(DISTINCT coalesce(url, '?')) AS u FROM present)
    UNION ALL SELECT 'fechas', NULL, NULL, strftime(min(fecha), '%Y-%m-%d %H:%M:%S'),
      strftime(max(fecha), '%Y-%m-%d %H:%M:%S') FROM cleaned
    UNION ALL SELECT 'departamentos', departamento, count(*), NULL, NULL FROM cleaned GROUP BY departamento
    UNION ALL SELECT 'archivos', departamento, count(*), NULL, NULL FROM present GROUP BY departamento
    UNION ALL SELECT 'omitidos', 'Der falta', NULL, NULL, NULL
    UNION ALL SELECT 'vacios', 'Vacio', NULL, NULL, NULL""",
)
def consolidate_report(spark, sf):
    """Counts, dates, files, and what was passed over."""
    root = behind_the_manifest(spark, sf, _blanked(spark, sf))
    order = consolidate.file_order(["periodico", "titulo", "texto"])
    parts = consolidate.consolidation_report(spark, root, order=order)
    name = F.url_decode(F.url_decode(F.regexp_extract("archivo", "departamento=([^/]*)/", 1)))
    files = parts["archivos"].groupBy(name.alias("clave")).agg(F.sum("n").alias("n"))
    shown_parts = {
        "duplicados": parts["duplicados"].unpivot([], ["total", "unicos", "duplicados"], "clave", "n"),
        "fechas": parts["fechas"].select(shown("desde"), shown("hasta")),
        "departamentos": parts["departamentos"].withColumnRenamed("departamento", "clave"),
        "archivos": files,
        "omitidos": parts["omitidos"].select(F.concat_ws(" ", "departamento", "estado").alias("clave")).distinct(),
        "vacios": parts["vacios"].select(F.col("departamento").alias("clave")),
    }
    return sets.union_all([df.withColumn("parte", F.lit(part)) for part, df in shown_parts.items()])


@query(
    "write_health_report",
    with_views(
        ["runs"],
        "SELECT id, tipo, CASE WHEN failure IS NOT NULL THEN 0 ELSE arts END AS arts, tiempo_s FROM runs "
        "UNION ALL SELECT NULL, 'resumen', count(*), NULL FROM runs",
    ),
)
def write_health_report(spark, sf):
    """The JSON report read back: run lines and the total of the summary."""
    path = shared_path(spark, "check")
    health_report(views.runs(spark, sf), path)
    lines = spark.read.schema(
        "id bigint, status string, arts int, tiempo_s double, tipo string, http_status int, error string"
    ).json(f"{path}/scrapers")
    summary = spark.read.schema("total bigint, ok bigint, roto bigint").json(f"{path}/resumen")
    runs = lines.select("id", "tipo", F.col("arts").cast("bigint"), "tiempo_s")
    total = summary.select(F.lit("resumen").alias("tipo"), F.col("total").alias("arts"))
    return runs.unionByName(total, allowMissingColumns=True)


_GROUPS = "(VALUES (1, 'The'), (1, 'De la'), (2, 'Der'), (2, 'El'), (3, 'Fuera')) AS d(grupo, departamento)"


@query(
    "health_document",
    with_views(["runs"], "").rstrip()
    + """, shown AS (SELECT tipo, CASE WHEN failure IS NOT NULL THEN 'roto' WHEN arts > 0 AND tiempo_s >= 60 THEN 'lento'
        WHEN arts > 0 THEN 'ok' WHEN http_status BETWEEN 200 AND 399 THEN 'sin_resultados' ELSE 'roto' END AS s,
        round(tiempo_s, 1) AS tiempo_s FROM runs),
    whole AS (SELECT NULL AS tipo, * EXCLUDE (tipo) FROM shown)
    SELECT tipo, '2024-02-01' AS fecha, '2023-11-01 → 2024-01-31' AS periodo,
      round((SELECT sum(tiempo_s) FROM shown), 1) AS tiempo_total_s, (SELECT count(*) FROM shown) AS total,
      count(*) FILTER (s = 'ok') AS ok, count(*) FILTER (s = 'lento') AS lento,
      count(*) FILTER (s = 'sin_resultados') AS sin_resultados, count(*) FILTER (s = 'roto') AS roto
    FROM (SELECT * FROM shown UNION ALL SELECT * FROM whole) GROUP BY tipo""",
)
def health_document(spark, sf):
    """The head of the report read back: a row for each type and one for all runs."""
    path = shared_path(spark, "check")
    write_health_document(views.runs(spark, sf), path, "2023-11-01", "2024-01-31", day="2024-02-01")
    counts = "ok bigint, lento bigint, sin_resultados bigint, roto bigint"
    head = spark.read.schema(
        "fecha string, periodo string, tiempo_total_s double, "
        f"resumen struct<total: bigint, {counts.replace(' bigint', ': bigint')}, "
        f"por_tipo: map<string, struct<{counts.replace(' bigint', ': bigint')}>>>"
    ).json(f"{path}/reporte")
    names = ["ok", "lento", "sin_resultados", "roto"]
    common = ["fecha", "periodo", "tiempo_total_s", F.col("resumen.total").alias("total")]
    by_type = head.select(*common, F.explode("resumen.por_tipo").alias("tipo", "n"))
    return by_type.select("tipo", "fecha", "periodo", "tiempo_total_s", "total", *[f"n.{n}" for n in names]).unionByName(
        head.select(F.lit(None).cast("string").alias("tipo"), *common, *[f"resumen.{n}" for n in names])
    )


@query(
    "progress_report",
    with_views(["articles"], "").rstrip()
    + f""", done AS (SELECT d.*, d.departamento IN (SELECT departamento FROM articles) AS hay FROM {_GROUPS}),
    groups AS (SELECT grupo, count(*) FILTER (hay) AS completados, count(*) AS total FROM done GROUP BY 1)
    SELECT 'grupos' AS parte, CAST(grupo AS VARCHAR) AS clave, completados, total,
      CASE WHEN completados = total THEN 'LISTO' WHEN completados > 0 THEN 'EN CURSO' ELSE 'PENDIENTE' END AS estado
      FROM groups
    UNION ALL SELECT 'total', NULL, CAST(sum(completados) AS BIGINT), CAST(sum(total) AS BIGINT), NULL FROM groups
    UNION ALL SELECT 'pendientes', departamento, NULL, NULL, NULL FROM done WHERE NOT hay
    UNION ALL SELECT 'no_reconocidos', 'Ajeno', NULL, NULL, NULL
    UNION ALL SELECT 'archivos', departamento, NULL, NULL, NULL FROM articles GROUP BY departamento
    UNION ALL SELECT 'archivos', 'Ajeno', NULL, NULL, NULL""",
)
def progress_report(spark, sf):
    """All parts: groups, total, pending departments, unknown ones and files."""
    rows = corpus_rows(spark, sf)
    strange = rows.withColumn("departamento", F.lit("Ajeno"))
    root = stored(spark, sf, rows.unionByName(strange))
    places = views.departments(spark).select("pos", "departamento")
    places = places.unionByName(places.filter("pos = 1").select(F.lit(5).alias("pos"), F.lit("Fuera").alias("departamento")))
    groups = places.select(F.floor((F.col("pos") + 1) / 2).cast("int").alias("grupo"), "departamento")
    parts = progress.progress_report(spark, groups, root)
    shown_parts = [
        parts["grupos"].select(F.lit("grupos").alias("parte"), F.col("grupo").cast("string").alias("clave"),
                               "completados", "total", "estado"),
        parts["total"].withColumn("parte", F.lit("total")),
        *[parts[p].select(F.lit(p).alias("parte"), F.col("departamento").alias("clave")).distinct()
          for p in ("pendientes", "no_reconocidos", "archivos")],
    ]
    return sets.union_all(shown_parts)


# ── Streaming ────────────────────────────────────────────────────────────────


# Stored bytes of documents whose articles fill one arriving file, and micro-batches they come in.
_FILE_BYTES = 16 << 20
_BATCHES = 3


def _arriving_files(spark, sf):
    """How many files the articles fill; the more documents, the more files, none larger."""
    return max(_BATCHES, -(-estimated_bytes(views.read(spark, sf, "documents")) // _FILE_BYTES))


def _article_stream(spark, sf, name_filter):
    """Article files arriving in three micro-batches; files, and so tasks, are bounded."""
    folder, files = shared_path(spark, "arrivals"), _arriving_files(spark, sf)
    rows = views.articles(spark, sf)
    rows.repartition(files, "doc_id").write.parquet(folder)
    return arrivals.stream_articles(
        spark, folder, rows.schema, LO, HI, min_mentions=3, files_per_batch=-(-files // _BATCHES),
        name_filter=name_filter,
    ).withColumn("terminos_encontrado", F.col("tema"))


_HITS = f"""WHERE (fecha IS NULL OR fecha BETWEEN TIMESTAMP '2023-01-01' AND TIMESTAMP '2023-12-31 23:59:59')
  AND {views.SCORE} >= 3"""


@query(
    "stream_articles",
    with_views(
        ["articles"],
        f"SELECT departamento, url, titulo, {_FECHA}, texto FROM articles {_HITS}",
    ),
)
def stream_articles(spark, sf):
    root = shared_path(spark, "stream")
    stream = _article_stream(spark, sf, "*.parquet")
    arrivals.write_stream(stream, root, shared_path(spark, "checkpoint"), True).awaitTermination()
    rows = readers.read_corpus(spark, root, row_type=schema.CORPUS)
    return rows.select("departamento", "url", "titulo", shown(), "texto")


@query(
    "stream_dedup",
    with_views(["articles"], f"SELECT DISTINCT url FROM articles {_HITS}"),
)
def stream_dedup(spark, sf):
    root = shared_path(spark, "stream")
    stream = arrivals.stream_dedup(_article_stream(spark, sf, "*.parquet"))
    arrivals.write_stream(stream, root, shared_path(spark, "checkpoint"), True).awaitTermination()
    return readers.read_corpus(spark, root, row_type=schema.CORPUS).select("url")


@query(
    "stream_first_seen",
    with_views(
        ["articles"],
        f"""SELECT departamento, url, titulo, {_FECHA}, texto FROM articles {_HITS}
          QUALIFY row_number() OVER (PARTITION BY url ORDER BY doc_id % 3, {_RECENT}, doc_id) = 1""",
    ),
)
def stream_first_seen(spark, sf):
    """Batches in a known order; the first row of each URL stays, later batches add none."""
    folder, root = shared_path(spark, "arrivals"), shared_path(spark, "stream")
    rows = views.articles(spark, sf).withColumn("terminos_encontrado", F.col("tema"))
    store = KeyStore(spark, shared_path(spark, "keys"), buckets=16)
    checkpoint = shared_path(spark, "checkpoint")
    order = [*dedup.recent_first(), F.col("doc_id")]
    for part in range(3):
        rows.filter(F.col("doc_id") % 3 == part).write.mode("append").parquet(folder)
        stream = arrivals.stream_articles(spark, folder, rows.schema, LO, HI, min_mentions=3, name_filter="*.parquet")
        arrivals.write_first_seen(stream, root, store, checkpoint, True, order=order).awaitTermination()
    kept = readers.read_corpus(spark, root, row_type=schema.CORPUS)
    return kept.select("departamento", "url", "titulo", shown(), "texto")


@query(
    "stream_on_batch",
    with_views(["articles"], f"SELECT periodico, count(*) AS n FROM articles {_HITS} GROUP BY 1"),
)
def stream_on_batch(spark, sf):
    """Each batch adds its own counts under its batch id, so a replay overwrites."""
    root = shared_path(spark, "batches")

    def count(batch, batch_id):
        reports.count_by_source(batch).write.mode("overwrite").parquet(f"{root}/lote={batch_id}")

    stream = _article_stream(spark, sf, "*.parquet")
    arrivals.on_batch(stream, count, shared_path(spark, "checkpoint"), True).awaitTermination()
    counts = spark.read.schema("periodico string, n bigint, lote int").parquet(root)
    return counts.groupBy("periodico").agg(F.sum("n").alias("n"))
