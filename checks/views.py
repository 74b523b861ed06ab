"""News-corpus tables projected from the test tables, in Spark and as SQL.

The test tables hold no news corpus. Each view below is a fixed projection of one
of them, written twice: as a DataFrame for the queries, as a common table
expression for the comparison SQL.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticiario.session import local_table
from noticiario.sources.dimensions import TOPICS
from noticiario.sources.registry import search_plan

LO, HI = "2023-01-01", "2023-12-31"
LIST_LO, LIST_HI = "2024-01-10", "2024-01-20"


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def shown(column: str = "fecha"):
    """A timestamp as text, so that no reader's time zone matters."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


# ── Articles ─────────────────────────────────────────────────────────────────


def articles(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    places = {"en": "The", "fr": "De la", "de": "Der"}
    place = F.lit("El")
    for lang, name in places.items():
        place = F.when(F.col("lang") == lang, name).otherwise(place)
    topic = F.get(F.array(*map(F.lit, TOPICS)), (i % 5).cast("int"))
    hours = (i * 37 % 500) * 24 + i % 24
    fecha = F.timestamp_micros(F.lit(1672531200000000) + hours * 3600000000)
    url = (
        F.when(i % 50 == 7, None)
        .when(i % 10 == 3, "https://news.example.com/hot")
        .otherwise(F.concat(F.lit("https://news.example.com/"), F.floor(i / 3)))
    )
    df = read(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("fuente"), F.col("source").alias("periodico"),
        place.alias("departamento"), topic.alias("tema"), (i % 5).cast("int").alias("tema_pos"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("titulo"), F.col("text").alias("texto"),
        url.alias("url"), F.when(i % 11 != 0, fecha).alias("fecha"),
    )
    return df.withColumn("termino", F.concat_ws(" ", "departamento", "tema"))


# ── Listings ─────────────────────────────────────────────────────────────────


def number(column: str = "props"):
    """The number inside the JSON properties of an event."""
    return F.regexp_extract(column, r"([0-9]+)", 1).cast("int")


def listing(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.unix_seconds(F.col("ts").cast("timestamp"))
    shifted = F.timestamp_seconds(ts + (F.col("event_id") % 5 - 2) * 43200)
    return read(spark, sf, "events").select(
        F.col("event_type").alias("periodico"),
        F.concat(F.lit("u"), F.col("user_id") % 10).alias("termino"),
        (F.floor((F.lit(1706745600) - ts) / 7200) + 1).cast("int").alias("page"),
        F.col("event_id").cast("int").alias("pos"),
        F.concat(
            F.lit("https://news.example.com/"), F.col("user_id"), F.lit("/"), number() % 20
        ).alias("link"),
        F.when(F.col("event_id") % 13 != 0, shifted).alias("fecha"),
    )


# ── Logs ─────────────────────────────────────────────────────────────────────


def errors(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ["PrimeraPagina", "TimeoutError", "ConnectionError", "ValueError"]))
    return read(spark, sf, "events").filter("event_type = 'error'").select(
        F.concat(F.lit("p"), F.col("user_id") % 27).alias("periodico"),
        F.get(kinds, number() % 4).alias("tipo"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    k, user = number(), F.col("user_id")
    kinds = F.array(*map(F.lit, ["html_static", "wp_api", "playwright", "queryly_api"]))
    codes = F.array(*map(F.lit, [200, 301, 404]))
    return read(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("u"), user, F.lit(" conflicto")).alias("termino"),
        (k % 5).cast("int").alias("arts"),
        F.round(F.col("value") * 10, 1).alias("tiempo_s"),
        F.get(kinds, (user % 4).cast("int")).alias("tipo"),
        F.get(codes, k % 4).alias("http_status"),
        F.when(k % 17 == 0, F.concat(F.lit("ValueError: "), k)).alias("failure"),
    )


# ── Dimensions ───────────────────────────────────────────────────────────────


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """A registry with one source per supplier."""
    kinds = F.array(*map(F.lit, ["html_static", "wp_api", "playwright", "queryly_api"]))
    key = F.col("s_suppkey")
    return (
        read(spark, sf, "supplier")
        .join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.concat(F.lit("s"), key).alias("id"), F.col("s_name").alias("nombre"),
            F.col("r_name").alias("region"), F.get(kinds, (key % 4).cast("int")).alias("tipo"),
            (key % 50 == 0).alias("is_national"),
        )
    )


def routing(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer as a department with none to three sources."""
    key = F.col("c_custkey")
    ids = F.transform(
        F.sequence(F.lit(1), F.lit(3)),
        lambda n: F.concat(F.lit("s"), (key * 7 + n * 3) % 12),
    )
    return read(spark, sf, "customer").select(
        F.col("c_name").alias("departamento"),
        F.slice(ids, F.lit(1), (key % 4).cast("int")).alias("periodicos"),
    )


def requested(spark: SparkSession, sf: str) -> DataFrame:
    """Source ids asked for, some unknown to the registry."""
    return read(spark, sf, "events").select(F.concat(F.lit("s"), F.col("user_id")).alias("id"))


# Small configuration of the department searches over the documents.
REGISTRY = [f"src{n}" for n in range(20)] + ["src98"]
NATIONAL = ["src18", "src19"]
BACKUP = ["src19", "src18"]
FALLBACK = "src19"
DEPARTMENTS = ["The", "De la", "Der", "El"]
ROUTING = {
    "The": ["src0", "src1", "src2", "src3", "src4", "src18"],
    "De la": ["src6", "src98", "src7"],
    "Der": [],
    "El": ["src5", "unknown", "src8"],
}
THRESHOLDS = {"The": 3, "De la": 2}

_S, _I = pa.string(), pa.int32()


def departments(spark: SparkSession) -> DataFrame:
    rows = [{"pos": n, "departamento": name} for n, name in enumerate(DEPARTMENTS, 1)]
    return local_table(spark, rows, pa.schema([("pos", _I), ("departamento", _S)]))


def registry(spark: SparkSession) -> DataFrame:
    rows = [{"id": name, "is_national": name in NATIONAL} for name in REGISTRY]
    return local_table(spark, rows, pa.schema([("id", _S), ("is_national", pa.bool_())]))


def plan(spark: SparkSession) -> DataFrame:
    routes = [{"departamento": d, "periodicos": ids} for d, ids in ROUTING.items()]
    limits = [{"departamento": d, "min_menciones": n} for d, n in THRESHOLDS.items()]
    return search_plan(
        departments(spark),
        local_table(spark, routes, pa.schema([("departamento", _S), ("periodicos", pa.list_(_S))])),
        local_table(spark, limits, pa.schema([("departamento", _S), ("min_menciones", _I)])),
        registry(spark),
        TOPICS, BACKUP, FALLBACK,
    )


# ── The same as SQL ──────────────────────────────────────────────────────────

_TOPIC_LIST = "[" + ", ".join(f"'{t}'" for t in TOPICS) + "]"
_KINDS = "['html_static', 'wp_api', 'playwright', 'queryly_api']"
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)"


def _plan_values() -> str:
    rows = []
    for place, ids in ROUTING.items():
        limit = THRESHOLDS.get(place, 3)
        searches = [(s, pos, 0) for pos, s in enumerate(ids)]
        if FALLBACK not in ids:
            searches.append((FALLBACK, len(ids), 1))
        searches += [(s, pos, 2) for pos, s in enumerate([b for b in BACKUP if b not in ids])]
        for source, pos, origin in searches:
            if source in REGISTRY:
                least = 1 if source in NATIONAL else limit
                rows.append(f"('{place}', '{source}', {pos}, {least}, {origin})")
    return ", ".join(rows)


SQL = {
    "articles": f"""
        SELECT *, departamento || ' ' || tema AS termino FROM (
          SELECT doc_id, source AS fuente, source AS periodico,
            CASE lang WHEN 'en' THEN 'The' WHEN 'fr' THEN 'De la' WHEN 'de' THEN 'Der'
              ELSE 'El' END AS departamento,
            {_TOPIC_LIST}[doc_id % 5 + 1] AS tema, CAST(doc_id % 5 AS INTEGER) AS tema_pos,
            split_part(text, chr(10), 1) AS titulo, text AS texto,
            CASE WHEN doc_id % 50 = 7 THEN NULL
              WHEN doc_id % 10 = 3 THEN 'https://news.example.com/hot'
              ELSE 'https://news.example.com/' || (doc_id // 3) END AS url,
            CASE WHEN doc_id % 11 <> 0 THEN TIMESTAMP '2023-01-01 00:00:00'
              + to_hours(CAST((doc_id * 37 % 500) * 24 + doc_id % 24 AS INTEGER)) END AS fecha
          FROM documents)""",
    "listing": f"""
        SELECT event_type AS periodico, 'u' || (user_id % 10) AS termino,
          CAST((1706745600 - s) // 7200 + 1 AS INTEGER) AS page,
          CAST(event_id AS INTEGER) AS pos,
          'https://news.example.com/' || user_id || '/' || (k % 20) AS link,
          CASE WHEN event_id % 13 <> 0 THEN
            make_timestamp((s + (event_id % 5 - 2) * 43200) * 1000000) END AS fecha
        FROM (SELECT *, epoch_us(CAST(ts AS TIMESTAMP)) // 1000000 AS s, {_K} AS k FROM events)""",
    "errors": f"""
        SELECT 'p' || (user_id % 27) AS periodico,
          ['PrimeraPagina', 'TimeoutError', 'ConnectionError', 'ValueError'][{_K} % 4 + 1] AS tipo
        FROM events WHERE event_type = 'error'""",
    "runs": f"""
        SELECT event_id AS id, 'u' || user_id || ' conflicto' AS termino,
          CAST(k % 5 AS INTEGER) AS arts, round(value * 10, 1) AS tiempo_s,
          {_KINDS}[user_id % 4 + 1] AS tipo, [200, 301, 404][k % 4 + 1] AS http_status,
          CASE WHEN k % 17 = 0 THEN 'ValueError: ' || k END AS failure
        FROM (SELECT *, {_K} AS k FROM events)""",
    "sources": f"""
        SELECT 's' || s_suppkey AS id, s_name AS nombre, r_name AS region,
          {_KINDS}[s_suppkey % 4 + 1] AS tipo, s_suppkey % 50 = 0 AS is_national
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "routing": """
        SELECT c_name AS departamento,
          list_transform(range(1, c_custkey % 4 + 1),
            lambda n: 's' || ((c_custkey * 7 + n * 3) % 12)) AS periodicos
        FROM customer""",
    "requested": "SELECT 's' || user_id AS id FROM events",
    "topics": "SELECT unnest(" + _TOPIC_LIST + ") AS tema, unnest([0, 1, 2, 3, 4]) AS tema_pos",
    "plan": f"""
        SELECT * FROM (VALUES {_plan_values()})
          AS t(departamento, fuente, fuente_pos, umbral, origen)""",
    "departments": "SELECT * FROM (VALUES "
    + ", ".join(f"({n}, '{d}')" for n, d in enumerate(DEPARTMENTS, 1))
    + ") AS t(pos, departamento)",
}

# Mentions of the lower-cased place in the text plus two if the title has it.
SCORE = """((length(lower(texto)) - length(replace(lower(texto), lower(departamento), '')))
  // length(departamento) + CASE WHEN contains(lower(titulo), lower(departamento)) THEN 2 ELSE 0 END)"""

SQL["matched"] = f"""
    SELECT a.*, p.fuente_pos, p.umbral, p.origen FROM articles a
    JOIN plan p ON a.departamento = p.departamento AND a.fuente = p.fuente
    WHERE (fecha IS NULL OR fecha BETWEEN TIMESTAMP '2023-01-01' AND TIMESTAMP '2023-12-31 23:59:59')
      AND {SCORE.replace('departamento', 'a.departamento')} >= umbral"""
SQL["needed"] = f"""
    SELECT DISTINCT p.departamento, t.tema FROM plan p CROSS JOIN topics t
    WHERE p.origen = 0 AND p.fuente NOT IN ('{NATIONAL[0]}', '{NATIONAL[1]}')
      AND NOT EXISTS (SELECT 1 FROM matched m WHERE m.origen = 0
        AND m.departamento = p.departamento AND m.tema = t.tema AND m.fuente = p.fuente)"""
SQL["found"] = """
    SELECT m.* FROM matched m WHERE m.origen <> 1 OR EXISTS (
      SELECT 1 FROM needed n WHERE n.departamento = m.departamento AND n.tema = m.tema)"""

NEEDS = {
    "matched": ["articles", "plan"],
    "needed": ["plan", "topics", "matched"],
    "found": ["matched", "needed"],
}


def with_views(names: list[str], body: str) -> str:
    """``body`` preceded by the views it names and those they build on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    tables = ",\n".join(f"{name} AS ({SQL[name]})" for name in ordered)
    return f"WITH {tables}\n{body}"
