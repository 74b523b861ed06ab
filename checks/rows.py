"""Checks of projections, dates, URLs and row filters."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import functions as F

from checks import views
from checks.registered import query
from checks.views import HI, LO, SCORE, shown, with_views
from noticiario.functions import dates, markup, text, urls
from noticiario.operators import columns, extract, filters
from noticiario.sources import readers, registry
from noticiario.sources.dimensions import TOPICS
from noticiario.sources.rules import RULES

FECHA_SQL = "strftime(fecha, '%Y-%m-%d %H:%M:%S') AS fecha"

# ── Canonical shape and constants ────────────────────────────────────────────


@query(
    "to_canonical",
    "SELECT source AS periodico, CAST(NULL AS VARCHAR) AS titulo, CAST(NULL AS VARCHAR) AS fecha, "
    "text AS texto, CAST(NULL AS VARCHAR) AS url FROM documents",
)
def to_canonical(spark, sf):
    docs = views.read(spark, sf, "documents")
    shaped = columns.to_canonical(
        docs.select(F.col("text").alias("texto"), F.col("source").alias("periodico"), "lang")
    )
    return shaped.withColumn("fecha", shown())


@query("tag", "SELECT s_name, 'Meta' AS departamento, 'Granada' AS municipio FROM supplier")
def tag(spark, sf):
    names = views.read(spark, sf, "supplier").select("s_name")
    return columns.tag(names, {"departamento": "Meta", "municipio": "Granada"})


@query(
    "search_terms",
    with_views(
        ["topics"],
        "SELECT c_name, tema, tema_pos, c_name || ' ' || tema AS termino, lower(c_name) AS territorio "
        "FROM customer CROSS JOIN topics",
    ),
)
def search_terms(spark, sf):
    names = views.read(spark, sf, "customer").select("c_name")
    return registry.search_terms(names, TOPICS, "c_name")


@query(
    "territory",
    "SELECT o_orderkey, lower('Norte ' || o_orderstatus || ' de ' || o_orderpriority) AS territorio, "
    "'' AS una_palabra FROM orders",
)
def territory(spark, sf):
    orders = views.read(spark, sf, "orders")
    term = F.concat(
        F.lit(" Norte  "), F.col("o_orderstatus"), F.lit(" de "), F.col("o_orderpriority"),
        F.lit("\tconflicto "),
    )
    return orders.select(
        "o_orderkey", text.territory(term).alias("territorio"),
        text.territory(F.col("o_orderstatus")).alias("una_palabra"),
    )


@query(
    "slug",
    with_views(
        ["articles"],
        r"SELECT doc_id, replace(regexp_replace(strip_accents(lower(titulo)), '[^\x00-\x7F]', '', 'g'), "
        "' ', '_') AS slug FROM articles",
    ),
)
def slug(spark, sf):
    return views.articles(spark, sf).select("doc_id", text.slug(F.col("titulo")).alias("slug"))


# ── Dates ────────────────────────────────────────────────────────────────────


def _month(names):
    listed = F.array(*[F.lit(n) for n in names])
    return F.get(listed, F.month("o_orderdate") - 1)


_ES, _ES3, _EN3 = list(dates.MONTHS_ES), list(dates.MONTHS_ES_ABBR), list(dates.MONTHS_EN_ABBR)


def _day():
    return F.dayofmonth("o_orderdate")


def _year():
    return F.year("o_orderdate")


def _iso():
    return F.date_format("o_orderdate", "yyyy-MM-dd")


def _write(pattern, **parts):
    """Text from a pattern with the named column parts."""
    pieces = []
    for piece in pattern.split("|"):
        pieces.append(parts[piece] if piece in parts else F.lit(piece))
    return F.concat(*[p.cast("string") for p in pieces])


def _date_texts():
    """Text of the order date in each format."""
    return {
        "es_month_day": _write("Publicado |m| |d|, |y", m=_month(_ES), d=_day(), y=_year()),
        "es_day_de_month": _write("martes |d| de |m|, |y", m=_month(_ES), d=_day(), y=_year()),
        "es_text": F.when(
            F.col("o_orderkey") % 2 == 0,
            _write("|d| de |m| |y", m=_month(_ES), d=_day(), y=_year()),
        ).otherwise(_write("|m| |d| |y", m=_month(_ES), d=_day(), y=_year())),
        "es_abbr": _write("El |d| |m| |y", m=F.upper(_month(_ES3)), d=_day(), y=_year()),
        "es_positional": _write("|m| |d|, |y", m=_month(_ES), d=_day(), y=_year()),
        "es_positional_de": _write("|m| |d| de |y", m=_month(_ES), d=_day(), y=_year()),
        "iso_date": _write("|t|T10:30:00-05:00", t=_iso()),
        "iso_datetime": _write("|t|T10:30:00-05:00", t=_iso()),
        "iso_datetime_short_offset": _write("|t|T10:30:00-05:00", t=_iso()),
        "to_utc_naive": _write("|t|T10:30:00-05:00", t=_iso()),
        "en_abbr": _write(
            "|m| |d|, |y| 10:30 AM", m=F.initcap(_month(_EN3)),
            d=F.lpad(_day().cast("string"), 2, "0"), y=_year(),
        ),
        "en_abbr_or_iso": _write("|m| |d|, |y", m=_month(_EN3), d=_day(), y=_year()),
        "es_as_en": _write("|m| |d|, |y", m=_month(_ES3), d=_day(), y=_year()),
        "rfc2822": _write(
            "Tue, |d| |m| |y| 10:00:00 -0500", m=F.initcap(_month(_EN3)), d=_day(), y=_year()
        ),
        "slash_crumb": _write("sitio › |t", t=F.date_format("o_orderdate", "yyyy/MM/dd")),
        "bullet_dmy": _write("Judicial • |t", t=F.date_format("o_orderdate", "dd/MM/yyyy")),
    }


def _date_query(name: str, clock: str) -> None:
    sql = (
        "SELECT o_orderkey, CASE WHEN o_orderkey % 17 <> 0 THEN "
        f"strftime(o_orderdate, '%Y-%m-%d') || ' {clock}' END AS fecha FROM orders"
    )

    @query(f"date_{name}", sql)
    def parse(spark, sf):
        impossible = F.col("o_orderkey") % 17 == 0
        raw = F.when(impossible, "febrero 30, 2024").otherwise(_date_texts()[name])
        orders = views.read(spark, sf, "orders").withColumn(
            "o_orderdate", F.col("o_orderdate").cast("date")
        )
        parsed = orders.select("o_orderkey", dates.FORMATS[name](raw).alias("fecha"))
        return parsed.select("o_orderkey", shown())


# The time of day each format keeps of the written text.
for _name, _clock in {
    "es_month_day": "00:00:00", "es_day_de_month": "00:00:00", "es_text": "00:00:00",
    "es_abbr": "00:00:00", "es_positional": "00:00:00", "es_positional_de": "00:00:00",
    "iso_date": "00:00:00", "iso_datetime": "10:30:00",
    "iso_datetime_short_offset": "00:00:00", "to_utc_naive": "15:30:00",
    "en_abbr": "00:00:00", "en_abbr_or_iso": "00:00:00", "es_as_en": "00:00:00",
    "rfc2822": "10:00:00", "slash_crumb": "00:00:00", "bullet_dmy": "00:00:00",
}.items():
    _date_query(_name, _clock)


_LENIENT = ["EEE, dd MMM yyyy HH:mm:ss", "MMMM d, yyyy", "d MMMM yyyy h:mm a", "yyyyMMdd", "yyyyMMdd'T'HHmmss",
            "MM/dd/yyyy HH:mm", "yyyy/MM/dd", "EEE MMM d HH:mm:ss yyyy"]
# Hours and minutes that each form keeps of 22:41:07, moved by its offset.
_LENIENT_SQL = "['03:41:07', '00:00:00', '22:41:00', '00:00:00', '22:41:07', '22:41:00', '00:00:00', '22:41:07']"


@query(
    "date_lenient",
    f"""SELECT o_orderkey, strftime(o_orderdate + to_days(CASE WHEN o_orderkey % 8 = 0 THEN 1 ELSE 0 END), '%Y-%m-%d')
      || ' ' || {_LENIENT_SQL}[o_orderkey % 8 + 1] AS fecha FROM orders""",
)
def date_lenient(spark, sf):
    """Eight forms of a date, told apart by their shape."""
    moment = F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL '22:41:07' HOUR TO SECOND")
    key = F.col("o_orderkey") % len(_LENIENT)
    written = F.lit(None).cast("string")
    for k, form in enumerate(_LENIENT):
        text = F.concat(F.date_format(moment, form), F.lit(" -0500" if k == 0 else ""))
        written = F.when(key == k, text).otherwise(written)
    parsed = views.read(spark, sf, "orders").select("o_orderkey", dates.to_utc_naive(written).alias("fecha"))
    return parsed.select("o_orderkey", shown())


@query(
    "date_es_relative",
    "SELECT o_orderkey, strftime(TIMESTAMP '2026-01-01' - to_hours(CAST(24 * (o_orderkey % 40) * "
    "[365, 30, 7, 1][o_orderkey % 4 + 1] AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS fecha FROM orders",
)
def date_es_relative(spark, sf):
    key = F.col("o_orderkey")
    unit = F.get(F.array(*map(F.lit, ["años", "meses", "semanas", "días"])), (key % 4).cast("int"))
    raw = F.concat_ws(" ", key % 40, unit, F.lit("ago"))
    parsed = views.read(spark, sf, "orders").select(
        "o_orderkey", dates.es_relative(raw, "2026-01-01 00:00:00").alias("fecha")
    )
    return parsed.select("o_orderkey", shown())


@query(
    "date_positional_text",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-') || lpad(CAST(o_orderkey % 40 AS VARCHAR), 2, '0') "
    "AS dia FROM orders",
)
def date_positional_text(spark, sf):
    orders = views.read(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    raw = _write("|m| |d| de |y", m=_month(_ES), d=F.col("o_orderkey") % 40, y=_year())
    return orders.select("o_orderkey", dates.es_positional_text(raw).alias("dia"))


@query(
    "parse_date_first_format",
    "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE "
    "strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' END AS fecha FROM orders",
)
def parse_date_first_format(spark, sf):
    orders = views.read(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    raw = (
        F.when(F.col("o_orderkey") % 3 == 0, _iso())
        .when(F.col("o_orderkey") % 3 == 1, _write("|d| |m| |y", m=_month(_ES3), d=_day(), y=_year()))
        .otherwise("basura")
    )
    parsed = orders.select(
        "o_orderkey", dates.parse_date(raw, ["iso_date", "es_abbr"]).alias("fecha")
    )
    return parsed.select("o_orderkey", shown())


# ── Pages and links ──────────────────────────────────────────────────────────

ANCHORS = extract.ExtractRule(
    item=r"<a\b[^>]*>", link=extract.href_of(), base="https://news.example.com", rooted=True
)
_LINKS_SQL = """
  SELECT page_id, pos - 1 AS pos, hrefs[pos] AS href FROM (
    SELECT page_id, hrefs, unnest(range(1, len(hrefs) + 1)) AS pos FROM (
      SELECT page_id, [replace(trim(h), '&amp;', '&') FOR h IN
        regexp_extract_all(html, '<a\\b[^>]*?\\bhref="([^"]*)"', 1)] AS hrefs FROM pages))
  WHERE hrefs[pos] <> ''"""


@query(
    "read_pages",
    "SELECT page_id, url, html FROM pages",
)
def read_pages(spark, sf):
    return readers.read_pages(spark, f"{sf}/pages.parquet")


@query(
    "extract_links",
    "SELECT page_id, CAST(pos AS INTEGER) AS pos, CASE WHEN starts_with(href, '/') THEN 'https://news.example.com' || href "
    f"ELSE href END AS link, CAST(NULL AS VARCHAR) AS fecha FROM ({_LINKS_SQL})",
)
def extract_links(spark, sf):
    pages = views.read(spark, sf, "pages").select("page_id", "html")
    return extract.extract_links(pages, ANCHORS).withColumn("fecha", shown())


def _hrefs(spark, sf):
    pages = views.read(spark, sf, "pages").select("page_id", "html")
    plain = extract.ExtractRule(item=ANCHORS.item, link=ANCHORS.link)
    return extract.extract_links(pages, plain).select("page_id", "pos", F.col("link").alias("href"))


@query(
    "absolutise",
    "SELECT page_id, CAST(pos AS INTEGER) AS pos, CASE WHEN starts_with(href, 'http') THEN href ELSE 'https://b.example' || href "
    "END AS siempre, CASE WHEN starts_with(href, '/') THEN 'https://b.example' || href ELSE href END "
    f"AS con_barra FROM ({_LINKS_SQL})",
)
def absolutise(spark, sf):
    return _hrefs(spark, sf).select(
        "page_id", "pos",
        urls.absolutise(F.col("href"), "https://b.example").alias("siempre"),
        urls.absolutise_rooted(F.col("href"), "https://b.example").alias("con_barra"),
    )


@query(
    "url_tests",
    """SELECT page_id, starts_with(url, 'https://') AS prefijo, contains(url, 'example.com') AS dominio,
      contains(url, '/en/') OR contains(url, '?page=') AS excluido,
      starts_with(url, 'http') AND NOT contains(url, 'example.net') AS externo FROM pages""",
)
def url_tests(spark, sf):
    url = F.col("url")
    return views.read(spark, sf, "pages").select(
        "page_id",
        urls.has_prefix(url, "https://").alias("prefijo"),
        urls.in_domain(url, "example.com").alias("dominio"),
        urls.is_excluded(url, ["/en/", "?page="]).alias("excluido"),
        urls.is_external(url, "example.net").alias("externo"),
    )


@query(
    "url_is_article",
    """SELECT o_orderkey, o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0
      AND year(o_orderdate) + o_orderkey % 40 - 20 BETWEEN 2000 AND 2030 AS articulo,
      o_orderkey % 5 <> 0 AS dos_partes FROM orders""",
)
def url_is_article(spark, sf):
    key = F.col("o_orderkey")
    year = F.year(F.col("o_orderdate").cast("date")) + key % 40 - 20
    path = F.concat(
        F.when(key % 5 == 0, "http://x").otherwise(""), F.lit("/economia/"), year, F.lit("/nota"),
        F.when(key % 3 == 0, "").otherwise("/texto/"),
    )
    return views.read(spark, sf, "orders").select(
        "o_orderkey", urls.is_article(path, 4, 2).alias("articulo"),
        urls.is_article(path, 2).alias("dos_partes"),
    )


@query(
    "extract_site_listing",
    "SELECT o_custkey AS page_id, CAST(o_orderkey AS VARCHAR) AS nota, CASE WHEN o_orderkey % 7 = 0 "
    "THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 10:30:00' END AS fecha FROM orders",
)
def extract_site_listing(spark, sf):
    """Result pages in one site's markup, written from the orders and read back."""
    orders = views.read(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    shown_date = F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(
        F.concat(F.lit('<time class="c-article__date" datetime="'), _iso(), F.lit('T10:30:00-0500">x</time>'))
    )
    html = F.concat(
        F.lit('<main><article class="c-article c-article--big"><h3><a class="page-link" href="/nota/'),
        F.col("o_orderkey"), F.lit('">N</a></h3>'), shown_date,
        F.lit('</article><article class="c-article"><a class="page-link" href="http://otro.example/">x</a>'
              '</article></main>'),
    )
    pages = orders.select(F.col("o_custkey").alias("page_id"), html.alias("html"))
    rows = extract.extract_links(pages, RULES["portafolio"])
    return rows.select(
        "page_id", F.regexp_extract("link", "^https://www.portafolio.co/nota/([0-9]+)$", 1).alias("nota"),
        shown(),
    )


# ── Elements with their own ends: one query for each kind of markup ──────────

_DAY_SQL = "strftime(o_orderdate, '%Y-%m-%d') || ' {}' AS fecha"


def _site(spark, sf, source, *parts):
    """Pages written from the orders and read by the rule of ``source``."""
    orders = views.read(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    pages = orders.select("o_orderkey", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("html"))
    return extract.extract_links(pages, RULES[source]).withColumn("fecha", shown())


@query(
    "extract_column_listing",
    """SELECT o_orderkey, 0 AS pos, 'https://www.corrillos.com.co/n/' || o_orderkey AS link,
      year(o_orderdate) || '-08-13 00:00:00' AS fecha FROM orders
    UNION ALL SELECT o_orderkey, 2, 'https://www.corrillos.com.co/lado/' || o_orderkey, NULL FROM orders
      WHERE o_orderkey % 4 = 0""",
)
def extract_column_listing(spark, sf):
    """A column that ends before the side's items; an item without a link takes none."""
    key = F.col("o_orderkey")
    return _site(
        spark, sf, "corrillos", '<body><div class="', F.when(key % 4 == 0, "otra").otherwise("col-md-12 x col-lg-8"),
        '"><div><article><div><h2 class="post-title"><a href="https://www.corrillos.com.co/n/', key,
        '">N</a></h2></div><span class="post-meta-date"> agosto 13 de ', F.year("o_orderdate"),
        '</span></article></div><article><h2 class="post-title">sin enlace</h2></article></div><div><article>'
        '<h2 class="post-title"><a href="https://www.corrillos.com.co/lado/', key, '">L</a></h2></article></div>',
    )


@query(
    "extract_innermost_listing",
    f"SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 1 THEN 1 ELSE 0 END AS INTEGER) AS pos, "
    f"'https://elpilon.com.co/judicial/' || o_orderkey AS link, {_DAY_SQL.format('10:30:00')} "
    "FROM orders WHERE o_orderkey % 3 <> 0",
)
def extract_innermost_listing(spark, sf):
    """The innermost element around a date; where that has no link there is no row."""
    key = F.col("o_orderkey")
    other = '<div><time datetime="2020-01-01T00:00:00-05:00">x</time><p>sin enlace</p></div>'
    return _site(
        spark, sf, "elpilon", '<div><a href="/menu/uno">m</a>', F.when(key % 3 == 1, other).otherwise(""),
        '<div>', F.when(key % 3 == 0, "<div>").otherwise(""), '<time datetime="', _iso(), 'T10:30:00-05:00">x</time>',
        F.when(key % 3 == 0, "</div>").otherwise(""), '<div><h3><a href="/judicial">s</a><a href="/judicial/', key,
        '">N</a></h3></div></div></div>',
    )


@query(
    "extract_fallback_listing",
    f"""SELECT o_orderkey, 0 AS pos, 'https://elmeridiano.co/nota/' || o_orderkey AS link, {_DAY_SQL.format('00:00:00')}
      FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT o_orderkey, 1, 'https://elmeridiano.co/dos/' || o_orderkey, NULL FROM orders WHERE o_orderkey % 2 = 1
    UNION ALL SELECT o_orderkey, 0, 'https://elmeridiano.co/pie/enlace', NULL FROM orders WHERE o_orderkey % 2 = 1""",
)
def extract_fallback_listing(spark, sf):
    """Marked anchors, or, on pages without any, all with an address of two parts."""
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    return _site(
        spark, sf, "elmeridiano", '<a href="/uno">u</a><a href="/pie/enlace">p</a><a class="',
        F.when(key % 2 == 0, "border x block rounded-lg").otherwise("border block"), '" href="/',
        F.when(key % 2 == 0, "nota").otherwise("dos"), "/", key, '"><p>Judicial</p><p>Judicial ',
        F.when(key % 2 == 0, F.concat(F.lit("\u2022 "), day)).otherwise(""), "</p></a>",
    )


@query(
    "extract_heading_listing",
    f"""SELECT o_orderkey, 0 AS pos, 'https://www.las2orillas.co/' || o_orderkey || '/' AS link,
      year(o_orderdate) || '-08-13 00:00:00' AS fecha FROM orders WHERE o_orderkey % 5 > 1""",
)
def extract_heading_listing(spark, sf):
    """The link in an item's heading counts, not others of the item."""
    key = F.col("o_orderkey")
    path = F.when(key % 5 == 1, "tag/").otherwise("")
    link = F.concat(F.lit('<a href="https://www.las2orillas.co/'), path, key, F.lit('/">N</a>'))
    return _site(
        spark, sf, "las2orillas", '<article class="mg-posts-sec-post"><h4 class="entry-title">',
        F.when(key % 5 == 0, "sin enlace").otherwise(link),
        '</h4><a href="https://www.las2orillas.co/otro/">o</a><span class="mg-blog-date"><a>agosto 13, ',
        F.year("o_orderdate"), '</a></span></article><footer><h4 class="entry-title">'
        '<a href="https://www.las2orillas.co/pie/">p</a></h4></footer>',
    )


_NAMES = [(name, char) for name, char in sorted(html5.items()) if name.endswith(";")]


def _list_sql(values):
    return "['" + "','".join(v.replace("'", "''") for v in values) + "']"


@query(
    "unescape_references",
    f"""SELECT doc_id, replace(replace(text, '&', '+'), 'e', {_list_sql(c for _, c in _NAMES)}[1 + doc_id % {len(_NAMES)}])
      || chr(CAST(8192 + doc_id % 900 AS INTEGER)) || chr(CAST(65536 + doc_id * 7919 % 1048576 AS INTEGER))
      || chr(CAST(65536 + doc_id * 7919 % 1048576 AS INTEGER)) AS texto FROM documents""",
)
def unescape_references(spark, sf):
    """Every name of the table in whole texts, numbers of both kinds, and surrogate pairs."""
    i = F.col("doc_id")
    names = F.from_json(F.lit(json.dumps([name for name, _ in _NAMES])), "array<string>")
    beyond = i * 7919 % 1048576
    written = F.concat(
        F.replace(F.replace("text", F.lit("&"), F.lit("+")), F.lit("e"),
                  F.concat(F.lit("&"), F.get(names, i % len(_NAMES)))),
        F.lit("&#"), 8192 + i % 900, F.lit(";&#x"), F.hex(65536 + beyond), F.lit(";&#"),
        55296 + F.floor(beyond / 1024), F.lit(";&#"), 56320 + beyond % 1024, F.lit(";"),
    )
    return views.read(spark, sf, "documents").select("doc_id", markup.unescape(written).alias("texto"))


# The references in the text of the given pages.
_ENTITY_SQL = "text"
for _entity, _char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("middot", "·"), ("copy", "©"), ("nbsp", "\u00a0"), ("#39", "'"), ("#x27", "'")):
    _quoted = _char.replace("'", "''")
    _ENTITY_SQL = f"replace({_ENTITY_SQL}, '&{_entity};', '{_quoted}')"
_ENTITY_SQL = f"replace({_ENTITY_SQL}, '&amp;', '&')"

PAGE_SQL = rf"""
  SELECT page_id, trim({_ENTITY_SQL.replace('text', "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}) AS titulo,
    CAST(NULL AS VARCHAR) AS fecha,
    regexp_replace(regexp_replace(regexp_replace(
      {_ENTITY_SQL.replace('text', "regexp_replace(lines, '<[^>]*>', '', 'g')")},
      '[ \t\x0B\f\r\x{{00A0}}]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS texto
  FROM (SELECT page_id, html,
      regexp_replace(regexp_replace(main, '\s+', ' ', 'g'),
        '(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr|section|article|blockquote)>', chr(10), 'g') AS lines
    FROM (SELECT page_id, html, CASE WHEN article <> '' THEN article WHEN body <> '' THEN body ELSE clean END AS main
      FROM (SELECT *, regexp_extract(clean, '(?is)<article\b[^>]*>(.*)</article>', 1) AS article,
          regexp_extract(clean, '(?is)<body\b[^>]*>(.*)</body>', 1) AS body
        FROM (SELECT page_id, html, regexp_replace(html,
          '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<header\b.*?</header>|<footer\b.*?</footer>|<aside\b.*?</aside>|<form\b.*?</form>',
          ' ', 'g') AS clean FROM pages))))"""


@query("extract_articles", PAGE_SQL)
def extract_articles(spark, sf):
    pages = views.read(spark, sf, "pages").select("page_id", "html")
    return extract.extract_articles(pages).withColumn("fecha", shown())


# ── Payloads ─────────────────────────────────────────────────────────────────



def _time():
    return F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")


def _link():
    return F.concat(F.lit("https://w.example/"), F.col("event_id"))


_TS_SQL = "strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"


@query(
    "read_wp_posts",
    f"""SELECT event_id, 0 AS pos, 'https://w.example/' || event_id AS link, {_TS_SQL} AS fecha FROM events
      UNION ALL SELECT event_id, 2, 'https://w.example/' || event_id || '/b', NULL FROM events""",
)
def read_wp_posts(spark, sf):
    post = lambda link, date: F.struct(link.alias("link"), date.alias("date"))
    none = F.lit(None).cast("string")
    body = F.to_json(F.array(post(_link(), _time()), post(none, _time()), post(F.concat(_link(), F.lit("/b")), F.lit("x"))))
    payloads = views.read(spark, sf, "events").select("event_id", body.alias("body"))
    return readers.read_wp_posts(payloads).withColumn("fecha", shown())


_QUERYLY_SQL = """
  SELECT event_id, event_id % 7 AS total, 0 AS pos, '/n/' || event_id AS link,
    strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d') || ' 00:00:00' AS fecha FROM events
  UNION ALL SELECT event_id, event_id % 7, 1, '/u/' || event_id, '2024-04-22 00:00:00' FROM events"""


def _queryly_body():
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")
    return F.concat(
        F.lit('{"items":[{"link":"/n/'), F.col("event_id"), F.lit('","pubdate":"'), day,
        F.lit('","title":"it is a \\"day\\" (1)"},{"link":"","url":"/u/'), F.col("event_id"),
        F.lit('","pubdate":"","pubDate":"Apr 22, 2024"},{"title":"no link"}],"metadata":{"total":'),
        F.col("event_id") % 7, F.lit("}}"),
    )


@query("read_queryly", _QUERYLY_SQL)
def read_queryly(spark, sf):
    payloads = views.read(spark, sf, "events").select("event_id", _queryly_body().alias("body"))
    return readers.read_queryly(payloads).withColumn("fecha", shown())


@query("unwrap_jsonp", _QUERYLY_SQL)
def unwrap_jsonp(spark, sf):
    """Both wrappers around the same payload, unwrapped and read."""
    escaped = F.replace(F.replace(_queryly_body(), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    wrapped = F.when(
        F.col("event_id") % 2 == 0,
        F.concat(F.lit("var r = JSON.parse('"), escaped, F.lit("'); end();")),
    ).otherwise(
        F.concat(F.lit("try{ searchPage.resultcallback("), _queryly_body(), F.lit("); } catch(e){}"))
    )
    payloads = views.read(spark, sf, "events").select(
        "event_id", readers.unwrap_jsonp(wrapped).alias("body")
    )
    return readers.read_queryly(payloads).withColumn("fecha", shown())


@query(
    "read_rss",
    f"""SELECT event_id, 0 AS pos, 'https://w.example/' || event_id AS link, {_TS_SQL} AS fecha FROM events
      UNION ALL SELECT event_id, 2, 'https://w.example/' || event_id || '/c', NULL FROM events""",
)
def read_rss(spark, sf):
    date = F.date_format(F.col("ts").cast("timestamp"), "dd MMM yyyy HH:mm:ss")
    body = F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>t</title><item><guid isPermaLink="false">'),
        _link(), F.lit("</guid><pubDate>Tue, "), date, F.lit(" +0000</pubDate></item><item><pubDate>x</pubDate>"
        "</item><item><guid>"), _link(), F.lit("/c</guid></item></channel></rss>"),
    )
    payloads = views.read(spark, sf, "events").select("event_id", body.alias("body"))
    return readers.read_rss(payloads).withColumn("fecha", shown())


# ── Filters ──────────────────────────────────────────────────────────────────

_RANGE = "fecha BETWEEN TIMESTAMP '2023-01-01' AND TIMESTAMP '2023-12-31 23:59:59'"


@query(
    "filter_date_range",
    with_views(["articles"], f"SELECT doc_id, {FECHA_SQL} FROM articles WHERE fecha IS NULL OR {_RANGE}"),
)
def filter_date_range(spark, sf):
    kept = filters.filter_date_range(views.articles(spark, sf), LO, HI)
    return kept.select("doc_id", shown())


@query(
    "filter_date_range_dated",
    with_views(["articles"], f"SELECT doc_id, {FECHA_SQL} FROM articles WHERE {_RANGE}"),
)
def filter_date_range_dated(spark, sf):
    kept = filters.filter_date_range(views.articles(spark, sf), LO, HI, keep_null=False)
    return kept.select("doc_id", shown())


@query(
    "mention_score",
    with_views(["articles"], f"SELECT doc_id, departamento, {SCORE} AS puntaje FROM articles"),
)
def mention_score(spark, sf):
    score = text.mention_score(F.col("texto"), F.col("titulo"), F.lower("departamento"))
    return views.articles(spark, sf).select("doc_id", "departamento", score.alias("puntaje"))


@query(
    "mention_score_empty_territory",
    with_views(
        ["articles"], "SELECT doc_id, length(texto) + 1 + 2 AS puntaje FROM articles"
    ),
)
def mention_score_empty_territory(spark, sf):
    score = text.mention_score(F.col("texto"), F.col("titulo"), text.territory(F.col("tema")))
    return views.articles(spark, sf).select("doc_id", score.alias("puntaje"))


@query(
    "filter_relevant",
    with_views(
        ["articles"],
        f"SELECT doc_id, periodico, titulo, texto, url FROM articles WHERE {SCORE} >= 3",
    ),
)
def filter_relevant(spark, sf):
    kept = filters.filter_relevant(views.articles(spark, sf), 3)
    return kept.select("doc_id", "periodico", "titulo", "texto", "url")


@query(
    "filter_relevant_national",
    with_views(
        ["articles"],
        f"SELECT doc_id FROM articles WHERE CASE WHEN periodico IN ('src18', 'src19') THEN {SCORE} >= 1 "
        f"WHEN periodico IN ('src0', 'src1') THEN true ELSE {SCORE} >= 3 END",
    ),
)
def filter_relevant_national(spark, sf):
    """Threshold 1 for national sources; a threshold of 0 keeps everything."""
    asked = F.when(F.col("periodico").isin("src0", "src1"), 0).otherwise(3)
    least = filters.effective_minimum(asked, F.col("periodico").isin("src18", "src19"))
    return filters.filter_relevant(views.articles(spark, sf), least).select("doc_id")


@query(
    "drop_empty_text",
    "SELECT conv_id, turn, text AS texto FROM conversations WHERE turn % 3 <> 1 AND turn % 5 <> 4 "
    r"AND NOT regexp_matches(text, '^\s*$')",
)
def drop_empty_text(spark, sf):
    turn = F.col("turn")
    rows = views.read(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.when(turn % 3 == 1, " \n \t").when(turn % 5 == 4, F.lit(None)).otherwise(F.col("text")).alias("texto"),
    )
    return filters.drop_empty_text(rows)


# ── Registry ─────────────────────────────────────────────────────────────────


@query("available_sources", with_views(["sources"], "SELECT id FROM sources"))
def available_sources(spark, sf):
    return registry.available_sources(views.sources(spark, sf))


@query("available_regions", with_views(["sources"], "SELECT DISTINCT region FROM sources"))
def available_regions(spark, sf):
    return registry.available_regions(views.sources(spark, sf))


@query("sources_by_region", with_views(["sources"], "SELECT id FROM sources WHERE region = 'ASIA'"))
def sources_by_region(spark, sf):
    return registry.sources_by_region(views.sources(spark, sf), "ASIA")


@query("sources_by_type", with_views(["sources"], "SELECT id FROM sources WHERE tipo = 'wp_api'"))
def sources_by_type(spark, sf):
    return registry.sources_by_type(views.sources(spark, sf), "wp_api")


@query(
    "valid_sources",
    with_views(["requested", "sources"], "SELECT id FROM requested WHERE id IN (SELECT id FROM sources)"),
)
def valid_sources(spark, sf):
    return registry.valid_sources(views.requested(spark, sf), views.sources(spark, sf))


@query(
    "unknown_sources",
    with_views(["requested", "sources"], "SELECT id FROM requested WHERE id NOT IN (SELECT id FROM sources)"),
)
def unknown_sources(spark, sf):
    return registry.unknown_sources(views.requested(spark, sf), views.sources(spark, sf))


@query(
    "select_sources_region",
    with_views(["sources"], "SELECT id, nombre FROM sources WHERE region = 'EUROPE'"),
)
def select_sources_region(spark, sf):
    return registry.select_sources(views.sources(spark, sf), region="EUROPE").select("id", "nombre")


@query(
    "select_sources_list",
    with_views(["sources"], "SELECT id, nombre FROM sources WHERE id IN ('s1', 's3', 's7')"),
)
def select_sources_list(spark, sf):
    chosen = registry.select_sources(views.sources(spark, sf), ["s1", "s3", "s7", "zz"], "ASIA")
    return chosen.select("id", "nombre")


@query("select_sources_all", with_views(["sources"], "SELECT id, nombre FROM sources"))
def select_sources_all(spark, sf):
    return registry.select_sources(views.sources(spark, sf)).select("id", "nombre")


@query(
    "route",
    with_views(
        ["routing"],
        "SELECT c_name AS departamento, CAST(pos - 1 AS INTEGER) AS fuente_pos, periodicos[pos] AS fuente FROM customer "
        "JOIN routing ON c_name = departamento CROSS JOIN LATERAL (SELECT unnest(range(1, len(periodicos) + 1)) AS pos) "
        "UNION ALL SELECT departamento, NULL, NULL FROM routing WHERE len(periodicos) = 0",
    ),
)
def route(spark, sf):
    names = views.read(spark, sf, "customer").select(F.col("c_name").alias("departamento"))
    return registry.route(names, views.routing(spark, sf))


@query(
    "attach_thresholds",
    "SELECT c_name AS departamento, CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 3 END AS min_menciones FROM customer",
)
def attach_thresholds(spark, sf):
    customers = views.read(spark, sf, "customer")
    limits = customers.filter("c_custkey % 5 = 0").select(
        F.col("c_name").alias("departamento"), F.lit(2).alias("min_menciones")
    )
    return registry.attach_thresholds(customers.select(F.col("c_name").alias("departamento")), limits)
