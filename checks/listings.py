"""Checks of listing rules, link deduplication and listing joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.rows import PAGE_SQL
from checks.registered import query
from checks.views import LIST_HI, LIST_LO, shown, with_views
from noticiario.operators import dedup, joins, listing, sets
from noticiario.plans.listings import candidates_from_pages, replay_source
from noticiario.session import shared_path
from noticiario.sources.keys import KeyStore
from noticiario.sources.rules import LISTINGS, ListingRule

_COLUMNS = "periodico, termino, page, pos, link"
_LO, _HI = f"TIMESTAMP '{LIST_LO}'", f"TIMESTAMP '{LIST_HI}'"
_OLDER = f"coalesce(fecha < {_LO}, false)"
_NEWER = f"coalesce(fecha > {_HI}, false)"
_KEPT = f"(fecha IS NULL OR fecha BETWEEN {_LO} AND {_HI})"
_GROUP = "PARTITION BY periodico, termino"
_BEFORE = f"OVER ({_GROUP} ORDER BY page, pos ROWS UNBOUNDED PRECEDING)"


def columns(df):
    return df.select("periodico", "termino", "page", "pos", "link")


@query(
    "classify_listing",
    with_views(
        ["listing"],
        f"""SELECT {_COLUMNS}, CASE WHEN fecha IS NULL THEN 'sin_fecha' WHEN fecha > {_HI} THEN 'posterior'
          WHEN fecha >= {_LO} THEN 'en_rango' ELSE 'anterior' END AS estado FROM listing""",
    ),
)
def classify_listing(spark, sf):
    rows = listing.classify_listing(views.listing(spark, sf), LIST_LO, LIST_HI)
    return rows.select("periodico", "termino", "page", "pos", "link", "estado")


@query(
    "filter_listing",
    with_views(
        ["listing"],
        f"SELECT {_COLUMNS}, strftime(fecha, '%Y-%m-%d %H:%M:%S') AS fecha FROM listing WHERE {_KEPT}",
    ),
)
def filter_listing(spark, sf):
    rows = listing.filter_listing(views.listing(spark, sf), LIST_LO, LIST_HI)
    return rows.select("periodico", "termino", "page", "pos", "link", shown())


@query(
    "cut_at_first_older",
    with_views(
        ["listing"],
        f"""SELECT {_COLUMNS} FROM (SELECT *, max(CASE WHEN {_OLDER} AND link NOT LIKE '%7' THEN 1 ELSE 0 END)
          {_BEFORE} AS stopped FROM listing) WHERE stopped = 0""",
    ),
)
def cut_at_first_older(spark, sf):
    accepted = ~F.col("link").endswith("7")
    return columns(listing.cut_at_first_older(views.listing(spark, sf), LIST_LO, accepted))


@query(
    "replay_listing",
    with_views(
        ["listing"],
        f"""SELECT {_COLUMNS} FROM (SELECT *, max(CASE WHEN {_OLDER} THEN 1 ELSE 0 END) {_BEFORE} AS stopped FROM listing)
          WHERE stopped = 0 AND {_KEPT}
          QUALIFY row_number() OVER (PARTITION BY periodico, termino, link ORDER BY page, pos) = 1""",
    ),
)
def replay_listing(spark, sf):
    return columns(listing.replay(views.listing(spark, sf), LIST_LO, LIST_HI))


# Thinned so that runs of pages without kept rows occur: the last digit of the
# position decides whether a row is there, has a link, and passes the link test.
_SPARSE_SQL = """sparse AS (SELECT periodico, termino, page, pos, fecha,
  CASE WHEN page % 29 <> 20 THEN link END AS link, link LIKE '%1' OR link LIKE '%4' AS ok FROM listing)"""


def sparse(spark, sf):
    link = F.col("link")
    return views.listing(spark, sf).select(
        "periodico", "termino", "page", "pos", "fecha",
        F.when(F.col("page") % 29 != 20, link).alias("link"),
        (link.endswith("1") | link.endswith("4")).alias("ok"),
    )


def _empty_pages_sql(counts: str, ended: str = "false") -> str:
    body = f"""pages AS (SELECT periodico, termino, page, count(link) AS links,
        count(*) FILTER (link IS NOT NULL AND ok AND {_KEPT}) AS kept,
        count(*) FILTER (link IS NOT NULL AND ok AND {_NEWER}) AS newer
      FROM sparse GROUP BY ALL),
    flagged AS (SELECT *, {counts} AS counts, {ended} AS ended FROM pages),
    runs AS (SELECT *, sum(CASE WHEN counts THEN 0 ELSE 1 END) OVER ({_GROUP} ORDER BY page) AS run FROM flagged),
    lengths AS (SELECT *, sum(CASE WHEN counts THEN 1 ELSE 0 END) OVER (PARTITION BY periodico, termino, run ORDER BY page)
      AS n FROM runs),
    stops AS (SELECT periodico, termino, least(min(page) FILTER (n >= 3), min(page) FILTER (ended) - 1) AS stop
      FROM lengths GROUP BY ALL)
    SELECT {', '.join('s.' + c for c in _COLUMNS.split(', '))} FROM sparse s
    JOIN stops USING (periodico, termino) WHERE link IS NOT NULL AND (stop IS NULL OR page <= stop)"""
    return with_views(["listing"], "").rstrip() + f", {_SPARSE_SQL}, {body}"


@query("stop_after_empty_pages", _empty_pages_sql("links > 0 AND kept = 0 AND newer = 0"))
def stop_after_empty_pages(spark, sf):
    return columns(
        listing.stop_after_empty_pages(sparse(spark, sf), LIST_LO, LIST_HI, n=3, accepted=F.col("ok"))
    )


@query("stop_after_empty_pages_newer_counts", _empty_pages_sql("links > 0 AND kept = 0"))
def stop_after_empty_pages_newer_counts(spark, sf):
    return columns(
        listing.stop_after_empty_pages(
            sparse(spark, sf), LIST_LO, LIST_HI, n=3, newer_resets=False, accepted=F.col("ok")
        )
    )


@query(
    "stop_at_page_without_links",
    _empty_pages_sql("links > 0 AND kept = 0 AND newer = 0", "links = 0"),
)
def stop_at_page_without_links(spark, sf):
    later = sparse(spark, sf)
    return columns(
        listing.stop_after_empty_pages(
            later, LIST_LO, LIST_HI, n=3, empty_page_ends=True, accepted=F.col("ok")
        )
    )


@query(
    "stop_after_old_pages",
    with_views(
        ["listing"],
        "",
    ).rstrip()
    + f""", pages AS (SELECT periodico, termino, page, max(fecha) < {_LO} AS counts FROM listing
        WHERE fecha IS NOT NULL GROUP BY ALL),
    runs AS (SELECT *, sum(CASE WHEN counts THEN 0 ELSE 1 END) OVER ({_GROUP} ORDER BY page) AS run FROM pages),
    lengths AS (SELECT *, sum(CASE WHEN counts THEN 1 ELSE 0 END) OVER (PARTITION BY periodico, termino, run ORDER BY page)
      AS n FROM runs),
    stops AS (SELECT periodico, termino, min(page) FILTER (n >= 2) AS stop FROM lengths GROUP BY ALL)
    SELECT l.periodico, l.termino, l.page, l.pos, l.link FROM listing l JOIN stops USING (periodico, termino)
    WHERE stop IS NULL OR page <= stop""",
)
def stop_after_old_pages(spark, sf):
    return columns(listing.stop_after_old_pages(views.listing(spark, sf), LIST_LO))


@query(
    "stop_batch_all_older",
    with_views(["listing"], "").rstrip()
    + f""", fresh AS (SELECT * FROM listing
        QUALIFY row_number() OVER (PARTITION BY periodico, termino, link ORDER BY page, pos) = 1),
    stops AS (SELECT periodico, termino, min(page) AS stop FROM (
        SELECT periodico, termino, page FROM fresh GROUP BY ALL
        HAVING count(fecha) > 0 AND count(fecha) = count(*) FILTER ({_OLDER})) GROUP BY ALL)
    SELECT f.periodico, f.termino, f.page, f.pos, f.link FROM fresh f LEFT JOIN stops USING (periodico, termino)
    WHERE stop IS NULL OR page <= stop""",
)
def stop_batch_all_older(spark, sf):
    return columns(listing.stop_batch_all_older(views.listing(spark, sf), LIST_LO))


@query(
    "page_span",
    with_views(
        ["listing"],
        """SELECT periodico, termino, page, strftime(min(fecha), '%Y-%m-%d %H:%M:%S') AS desde,
          strftime(max(fecha), '%Y-%m-%d %H:%M:%S') AS hasta FROM listing WHERE fecha IS NOT NULL GROUP BY ALL""",
    ),
)
def page_span(spark, sf):
    spans = listing.page_span(views.listing(spark, sf))
    return spans.select("periodico", "termino", "page", shown("desde"), shown("hasta"))


def _cap_query(name: str, n: int, keys: tuple[str, ...]) -> None:
    sql = f"SELECT {_COLUMNS} FROM listing QUALIFY row_number() OVER (PARTITION BY {', '.join(keys)} " \
        f"ORDER BY page, pos, link) <= {n}"

    @query(name, with_views(["listing"], sql))
    def cap(spark, sf):
        return columns(listing.cap_per_group(views.listing(spark, sf), n, keys))


_cap_query("cap_per_group", 50, ("periodico", "termino"))
# a cap of another size has the same plan; pages of several listings lie in one here
_cap_query("cap_per_group_large", 1500, ("periodico",))


@query(
    "cap_pages",
    with_views(
        ["listing"],
        f"SELECT {_COLUMNS} FROM listing WHERE page <= ceil(least(1000 + pos % 4000, 3000) / 20)",
    ),
)
def cap_pages(spark, sf):
    total = 1000 + F.col("pos") % 4000
    return columns(listing.cap_pages(views.listing(spark, sf), 3000, 20, total))


@query(
    "dedup_links",
    with_views(
        ["listing"],
        f"SELECT {_COLUMNS} FROM listing "
        "QUALIFY row_number() OVER (PARTITION BY periodico, termino, link ORDER BY page, pos) = 1",
    ),
)
def dedup_links(spark, sf):
    return columns(dedup.dedup_links(views.listing(spark, sf)))


# ── Joins ────────────────────────────────────────────────────────────────────

_LISTED = """, listed AS (SELECT link, fecha FROM listing {where}
    QUALIFY row_number() OVER (PARTITION BY link ORDER BY page DESC, pos DESC) = 1),
  own AS (SELECT event_id, 'https://news.example.com/' || user_id || '/' || (event_id % 40) AS link,
    CASE WHEN event_id % 3 <> 0 THEN TIMESTAMP '2020-05-05' END AS fecha FROM events)
  SELECT event_id, own.link, strftime(CASE WHEN listed.link IS NOT NULL THEN listed.fecha ELSE own.fecha END,
    '%Y-%m-%d %H:%M:%S') AS fecha FROM own LEFT JOIN listed ON own.link = listed.link"""


def _articles_with_links(spark, sf):
    return views.read(spark, sf, "events").select(
        "event_id",
        F.concat(
            F.lit("https://news.example.com/"), "user_id", F.lit("/"), F.col("event_id") % 40
        ).alias("link"),
        F.when(F.col("event_id") % 3 != 0, F.lit("2020-05-05 00:00:00").cast("timestamp")).alias("fecha"),
    )


def _dated(spark, sf, skip_null):
    # Positions are unique over all listings here, so one key is enough.
    listed = joins.last_listing_dates(views.listing(spark, sf), ["link"], skip_null)
    rows = joins.listing_date(_articles_with_links(spark, sf), listed, ["link"])
    return rows.select("event_id", "link", shown())


@query("listing_date", with_views(["listing"], "").rstrip() + _LISTED.format(where=""))
def listing_date(spark, sf):
    """A listed link without a date loses the article's own date."""
    return _dated(spark, sf, skip_null=False)


@query(
    "listing_date_dated_only",
    with_views(["listing"], "").rstrip() + _LISTED.format(where="WHERE fecha IS NOT NULL"),
)
def listing_date_dated_only(spark, sf):
    return _dated(spark, sf, skip_null=True)


@query(
    "known_links",
    with_views(
        ["listing"],
        f"SELECT {_COLUMNS} FROM listing WHERE link NOT IN (SELECT link FROM listing WHERE fecha > {_HI})",
    ),
)
def known_links(spark, sf):
    rows = views.listing(spark, sf)
    seen = rows.filter(F.col("fecha") > F.lit(f"{LIST_HI} 00:00:00").cast("timestamp"))
    return columns(joins.known_links(rows, seen))


@query(
    "new_links",
    with_views(
        ["listing"],
        f"SELECT {_COLUMNS} FROM listing WHERE link NOT IN (SELECT link FROM listing WHERE fecha > {_HI} "
        f"OR fecha < {_LO})",
    ),
)
def new_links(spark, sf):
    """The history grows by two batches, one of them stored twice."""
    rows = views.listing(spark, sf)
    hi, lo = (F.lit(f"{day} 00:00:00").cast("timestamp") for day in (LIST_HI, LIST_LO))
    store = KeyStore(spark, shared_path(spark, "keys"), buckets=16)
    store.add(rows.filter(F.col("fecha") > hi), "link", batch=0)
    for _ in range(2):
        store.add(rows.filter(F.col("fecha") < lo), "link", batch=1)
    return columns(joins.new_links(rows, store))


_PAGE_LINKS = """links AS (SELECT 'p' || (page_id % 3) AS periodico, 't' || (page_id % 2) AS termino,
    CAST(page_id AS INTEGER) AS page, 0 AS pos, url AS link,
    CASE WHEN page_id % 4 <> 0 THEN TIMESTAMP '2023-01-01' + to_days(CAST(page_id AS INTEGER)) END AS fecha
    FROM pages)"""


@query(
    "candidates_from_pages",
    "WITH " + _PAGE_LINKS + f"""
    SELECT periodico, termino, link AS url, strftime(links.fecha, '%Y-%m-%d %H:%M:%S') AS fecha, titulo, texto
    FROM links JOIN ({PAGE_SQL}) a ON links.page = a.page_id""",
)
def candidates_from_pages_query(spark, sf):
    """Titles and texts of all pages with the dates of their listings."""
    page = F.col("page_id")
    pages = views.read(spark, sf, "pages")
    links = pages.select(
        F.concat(F.lit("p"), page % 3).alias("periodico"), F.concat(F.lit("t"), page % 2).alias("termino"),
        page.cast("int").alias("page"), F.lit(0).alias("pos"), F.col("url").alias("link"),
        F.when(page % 4 != 0, F.timestamp_seconds(F.lit(1672531200) + page * 86400)).alias("fecha"),
    )
    return candidates_from_pages(links, links, pages).withColumn("fecha", shown())


@query(
    "stop_after_articles",
    with_views(["listing"], "").rstrip()
    + f""", stops AS (SELECT periodico, termino, page AS stop FROM listing
        QUALIFY row_number() OVER ({_GROUP} ORDER BY page, pos, link) = 60)
    SELECT l.periodico, l.termino, l.page, l.pos, l.link FROM listing l LEFT JOIN stops USING (periodico, termino)
    WHERE stop IS NULL OR page <= stop""",
)
def stop_after_articles(spark, sf):
    return columns(listing.stop_after_articles(views.listing(spark, sf), 60))


@query(
    "stop_at_empty_page",
    with_views(["listing"], "").rstrip()
    + f""", {_SPARSE_SQL}, stops AS (SELECT periodico, termino, min(page) AS stop FROM (
        SELECT periodico, termino, page FROM sparse GROUP BY ALL HAVING count(link) = 0) GROUP BY ALL)
    SELECT s.periodico, s.termino, s.page, s.pos, s.link FROM sparse s LEFT JOIN stops USING (periodico, termino)
    WHERE stop IS NULL OR page < stop""",
)
def stop_at_empty_page(spark, sf):
    return columns(listing.stop_at_empty_page(sparse(spark, sf)))


# ── Listing rules of all sources ─────────────────────────────────────────────


def _runs_sql(pages: str, n: int) -> str:
    """First page of each listing that completes ``n`` counting pages in a row."""
    return f"""SELECT periodico, termino, min(page) FILTER (n >= {n}) AS stop FROM (
      SELECT *, sum(CASE WHEN counts THEN 1 ELSE 0 END) OVER (PARTITION BY periodico, termino, run ORDER BY page) AS n
      FROM (SELECT *, sum(CASE WHEN counts THEN 0 ELSE 1 END) OVER ({_GROUP} ORDER BY page) AS run FROM ({pages}))
    ) GROUP BY ALL"""


def _until(rows: str, stops: str, kept: str) -> str:
    return f"SELECT r.* FROM ({rows}) r LEFT JOIN ({stops}) s USING (periodico, termino) WHERE s.stop IS NULL OR {kept}"


def _rule_sql(rule: ListingRule) -> str:
    """The steps of a rule one inside the other."""
    rows = "SELECT periodico, termino, page, pos, fecha, link FROM sparse"
    if rule.first_older:
        first = f"""SELECT periodico, termino, min((page, pos)) AS stop FROM ({rows})
          WHERE {_OLDER} AND link IS NOT NULL GROUP BY ALL"""
        rows = _until(rows, first, "(r.page, r.pos) < s.stop")
    empty = f"SELECT periodico, termino, min(page) - 1 AS stop FROM (SELECT periodico, termino, page FROM ({rows}) " \
        "GROUP BY ALL HAVING count(link) = 0) GROUP BY ALL"
    if rule.empty_pages:
        newer = f" AND count(*) FILTER (link IS NOT NULL AND {_NEWER}) = 0" if rule.newer_resets else ""
        pages = f"""SELECT periodico, termino, page, count(link) > 0 AND count(*) FILTER (link IS NOT NULL AND {_KEPT}) = 0
          {newer} AS counts FROM ({rows}) GROUP BY ALL"""
        stops = _runs_sql(pages, rule.empty_pages)
        if rule.empty_page_ends:
            stops = f"SELECT periodico, termino, min(stop) AS stop FROM ({stops} UNION ALL {empty}) GROUP BY ALL"
        rows = _until(rows, stops, "r.page <= s.stop")
    elif rule.empty_page_ends:
        rows = _until(rows, empty, "r.page <= s.stop")
    rows = f"SELECT * FROM ({rows}) WHERE link IS NOT NULL"
    if rule.old_pages:
        pages = f"""SELECT periodico, termino, page, max(fecha) < {_LO} AS counts FROM ({rows})
          WHERE fecha IS NOT NULL GROUP BY ALL"""
        rows = _until(rows, _runs_sql(pages, rule.old_pages), "r.page <= s.stop")
    first = "QUALIFY row_number() OVER (PARTITION BY periodico, termino, link ORDER BY page, pos) = 1"
    if rule.older_batch:
        rows = f"SELECT * FROM ({rows}) {first}"
        old = f"""SELECT periodico, termino, min(page) AS stop FROM (SELECT periodico, termino, page FROM ({rows})
          GROUP BY ALL HAVING count(fecha) > 0 AND count(fecha) = count(*) FILTER ({_OLDER})) GROUP BY ALL"""
        rows = _until(rows, old, "r.page <= s.stop")
    undated = "fecha IS NULL OR " if rule.keep_undated else ""
    if rule.whole_last_day or not rule.keep_undated:
        rows = f"SELECT * FROM ({rows}) WHERE {undated}fecha BETWEEN {_LO} AND TIMESTAMP '{LIST_HI} 23:59:59'"
    elif rule.filter_dates:
        rows = f"SELECT * FROM ({rows}) WHERE {_KEPT}"
    return f"SELECT {_COLUMNS} FROM ({rows}) {first}"


# Sources with equal rules share a result.
_BY_RULE: dict[ListingRule, str] = {}
for _source, _rule in LISTINGS.items():
    _BY_RULE[_rule] = f"{_BY_RULE[_rule]} {_source}" if _rule in _BY_RULE else _source


@query(
    "replay_source",
    with_views(["listing"], "").rstrip() + f", {_SPARSE_SQL} " + " UNION ALL ".join(
        f"SELECT '{names}' AS fuentes, * FROM ({_rule_sql(rule)})" for rule, names in _BY_RULE.items()
    ),
)
def replay_source_query(spark, sf):
    """The listing rules of all sources over all listings, pages without links included."""
    rows = sparse(spark, sf).drop("ok")
    return sets.union_all([
        columns(replay_source(rows, rule, LIST_LO, LIST_HI)).withColumn("fuentes", F.lit(names))
        for rule, names in _BY_RULE.items()
    ])
