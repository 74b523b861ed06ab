"""Default dimension rows: sources, routing, thresholds, groups, topics.

All of these are inputs: every job takes the tables as arguments, so other
territories, sources or topics only need other rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from noticiario.session import local_table

# ── Fixed values ─────────────────────────────────────────────────────────────

TOPICS = ["conflicto", "comunidades", "derechos", "violencia", "corrupcion"]

DATE_FROM = "2023-01-01"
DATE_TO = "2023-12-31"

# id, display name, region, type, base address
SOURCES = [
    ("eldiario", "El Diario", "eje_cafetero_antioquia", "html_static", "https://www.eldiario.com.co"),
    ("elcolombiano", "El Colombiano", "eje_cafetero_antioquia", "html_static", "https://www.elcolombiano.com"),
    ("bcnoticias", "BC Noticias", "eje_cafetero_antioquia", "html_static", "https://www.bcnoticias.com.co"),
    ("elquindiano", "El Quindiano", "eje_cafetero_antioquia", "wp_api", "https://elquindiano.com"),
    ("elpais", "El País Cali", "suroccidente", "queryly_api", "https://www.elpais.com.co"),
    ("diariooccidente", "Diario Occidente", "suroccidente", "html_static", "https://occidente.co"),
    ("diariodelsur", "Diario del Sur", "suroccidente", "html_static", "https://www.diariodelsur.com.co"),
    ("diariodelcauca", "Diario del Cauca", "suroccidente", "wp_api", "https://diariodelcauca.com.co"),
    ("choco7dias", "Chocó 7 Días", "suroccidente", "wp_api", "https://choco7dias.com"),
    ("llanoalmundo", "Llano al Mundo", "orinoquia_amazonia", "wp_api", "https://llanoalmundo.com"),
    ("diariodecasanare", "Diario de Casanare", "orinoquia_amazonia", "wp_api", "https://www.diariodecasanare.com"),
    ("lavozdelcinaruco", "La Voz del Cinaruco", "orinoquia_amazonia", "wp_api", "https://lavozdelcinaruco.com"),
    ("elmorichal", "El Morichal", "orinoquia_amazonia", "wp_api", "https://elmorichal.com"),
    ("miputumayo", "Mi Putumayo", "orinoquia_amazonia", "wp_api", "https://miputumayo.com.co"),
    ("eltiempo", "El Tiempo", "central", "html_static", "https://www.eltiempo.com"),
    ("larepublica", "La República", "central", "playwright", "https://www.larepublica.co"),
    ("portafolio", "Portafolio", "central", "html_static", "https://www.portafolio.co"),
    ("publimetro", "Publimetro", "central", "playwright", "https://www.publimetro.co"),
    ("verdadabierta", "Verdad Abierta", "nacional", "wp_api", "https://verdadabierta.com"),
    ("elheraldo", "El Heraldo", "caribe", "playwright", "https://www.elheraldo.co"),
    ("eluniversal", "El Universal", "caribe", "queryly_api", "https://www.eluniversal.com.co"),
    ("elpilon", "El Pilón", "caribe", "playwright", "https://elpilon.com.co"),
    ("elmeridiano", "El Meridiano", "caribe", "playwright", "https://elmeridiano.co"),
    ("vanguardia", "Vanguardia", "nororiente", "queryly_api", "https://www.vanguardia.com"),
    ("tronchandosinfronteras", "Trochando Sin Fronteras", "nororiente", "html_static", "https://trochandosinfronteras.info"),
    ("enlacetelevision", "Enlace Television", "nororiente", "playwright", "https://enlacetelevision.com"),
    ("corrillos", "Corrillos", "nororiente", "html_static", "https://www.corrillos.com.co"),
]

# Sources with national coverage, those that back up thin corpora, and the one
# that stands in for a local source without results.
NATIONAL = ["eltiempo", "verdadabierta"]
BACKUP = ["eltiempo", "verdadabierta"]
FALLBACK = "eltiempo"
MIN_ARTICLES = 50

# Department -> its local sources, in search order.
ROUTING = {
    "Antioquia": ["elcolombiano"],
    "Risaralda": ["eldiario"],
    "Caldas": ["bcnoticias"],
    "Quindío": ["elquindiano"],
    "Valle del Cauca": ["elpais", "diariooccidente"],
    "Nariño": ["diariodelsur"],
    "Cauca": ["diariodelcauca"],
    "Chocó": ["choco7dias"],
    "Meta": ["llanoalmundo"],
    "Casanare": ["diariodecasanare"],
    "Arauca": ["lavozdelcinaruco", "tronchandosinfronteras"],
    "Vichada": [],
    "Putumayo": [],
    "Cundinamarca": ["eltiempo", "larepublica", "portafolio", "publimetro"],
    "Atlántico": [],
    "Bolívar": [],
    "Cesar": ["elpilon"],
    "Córdoba": ["elmeridiano"],
    "Santander": ["enlacetelevision", "corrillos", "eltiempo"],
    "Sucre": ["elmeridiano"],
    "Norte de Santander": ["enlacetelevision", "corrillos", "eltiempo"],
    "Magdalena": ["elpilon"],
    "Boyacá": ["eltiempo"],
    "Tolima": ["eltiempo", "bcnoticias"],
    "Huila": ["diariodelcauca", "diariodelsur"],
    "La Guajira": ["elpilon"],
    "Caquetá": ["llanoalmundo"],
    "Guaviare": ["llanoalmundo"],
    "Amazonas": [],
    "Guainía": [],
    "Vaupés": ["eltiempo"],
    "San Andrés y Providencia": ["eltiempo"],
}

# Department -> mentions it requires; a department that is not listed needs three.
MIN_MENTIONS = {
    "Antioquia": 3,
    "Cundinamarca": 3,
    "Valle del Cauca": 3,
    "Atlántico": 3,
    "Bolívar": 3,
    "Santander": 3,
    "Risaralda": 2,
    "Caldas": 2,
    "Quindío": 2,
    "Nariño": 2,
    "Cauca": 2,
    "Chocó": 2,
    "Meta": 2,
    "Casanare": 2,
    "Arauca": 2,
    "Vichada": 2,
    "Putumayo": 2,
    "Cesar": 2,
    "Córdoba": 2,
    "Sucre": 2,
    "Norte de Santander": 2,
    "Magdalena": 2,
    "Boyacá": 2,
    "Tolima": 2,
    "Huila": 2,
    "La Guajira": 2,
    "Caquetá": 2,
    "Guaviare": 2,
    "Amazonas": 2,
    "Guainía": 2,
    "Vaupés": 2,
    "San Andrés y Providencia": 2,
}

# Run groups in order.
GROUPS = [
    ["Antioquia", "Chocó", "Vichada"],
    ["Valle del Cauca", "Arauca", "Atlántico"],
    ["Caldas", "Meta", "Bolívar"],
    ["Risaralda", "Caquetá", "Putumayo"],
    ["Quindío", "Guaviare", "Amazonas"],
    ["Santander", "Cesar", "Boyacá"],
    ["Norte de Santander", "Magdalena", "Guainía"],
    ["Cundinamarca", "La Guajira", "Cauca"],
    ["Córdoba", "Nariño", "Vaupés"],
    ["Sucre", "Huila", "San Andrés y Providencia"],
    ["Casanare", "Tolima"],
]

# ── As tables ────────────────────────────────────────────────────────────────

_S, _I = pa.string(), pa.int32()


def sources_table(spark: SparkSession) -> DataFrame:
    names = ["id", "nombre", "region", "tipo", "base"]
    rows = [dict(zip(names, row), is_national=row[0] in NATIONAL) for row in SOURCES]
    fields = [(name, _S) for name in names] + [("is_national", pa.bool_())]
    return local_table(spark, rows, pa.schema(fields))


def routing_table(spark: SparkSession, routing: dict[str, list[str]] = ROUTING) -> DataFrame:
    rows = [{"departamento": name, "periodicos": ids} for name, ids in routing.items()]
    return local_table(spark, rows, pa.schema([("departamento", _S), ("periodicos", pa.list_(_S))]))


def thresholds_table(spark: SparkSession) -> DataFrame:
    rows = [{"departamento": name, "min_menciones": n} for name, n in MIN_MENTIONS.items()]
    return local_table(spark, rows, pa.schema([("departamento", _S), ("min_menciones", _I)]))


def groups_table(spark: SparkSession) -> DataFrame:
    rows = [
        {"grupo": number, "pos": place, "departamento": name}
        for number, names in enumerate(GROUPS, 1)
        for place, name in enumerate(names, 1)
    ]
    return local_table(
        spark, rows, pa.schema([("grupo", _I), ("pos", _I), ("departamento", _S)])
    )


def departments_table(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """Departments in the order they are to be reported."""
    names = [n for group in GROUPS for n in group] if names is None else names
    rows = [{"pos": place, "departamento": name} for place, name in enumerate(names, 1)]
    return local_table(spark, rows, pa.schema([("pos", _I), ("departamento", _S)]))
