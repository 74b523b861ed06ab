"""Listing rules against plain loops over small random listings."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from noticiario.operators import joins, listing
from noticiario.plans.listings import links_from_payloads, replay_source
from noticiario.sources import dimensions
from noticiario.sources.rules import LISTINGS, QUERYLY, RULES

LO, HI = "2024-01-10", "2024-01-20"
DLO, DHI = datetime(2024, 1, 10), datetime(2024, 1, 20)
SCHEMA = "periodico string, termino string, page int, pos int, link string, fecha timestamp"


def random_listing(seed, sources=4, pages=60, null_share=0.2, empty_pages=0.1):
    rng = random.Random(seed)
    rows = []
    for s in range(sources):
        start = datetime(2024, 1, 24)
        for page in range(1, rng.randint(5, pages)):
            if rng.random() < 0.1:
                continue  # a page that failed to load
            if rng.random() < empty_pages:
                rows.append((f"p{s}", "t", page, 0, None, None))
                continue
            for pos in range(rng.randint(1, 4)):
                start -= timedelta(hours=rng.randint(-20, 30))
                fecha = None if rng.random() < null_share else start
                rows.append((f"p{s}", "t", page, pos, f"l{rng.randint(0, 150)}", fecha))
    return rows


def listings(rows):
    """Rows per source in order."""
    by = {}
    for row in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        by.setdefault(row[0], []).append(row)
    return by


def by_page(rows):
    pages = {}
    for row in rows:
        pages.setdefault(row[2], []).append(row)
    return sorted(pages.items())


def kept(fecha):
    return fecha is None or DLO <= fecha <= DHI


def as_set(df):
    return sorted((tuple(r) for r in df.select("periodico", "page", "pos").collect()))


def place(rows):
    return sorted((r[0], r[2], r[3]) for r in rows)


@pytest.fixture(scope="module", params=[1, 2, 3])
def case(request, spark):
    rows = random_listing(request.param)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_states(spark):
    df = spark.createDataFrame(
        [(1, None), (2, datetime(2024, 1, 20, 0, 0, 1)), (3, DHI), (4, DLO), (5, datetime(2024, 1, 9))],
        "i int, fecha timestamp",
    )
    got = [r.estado for r in listing.classify_listing(df, LO, HI).orderBy("i").collect()]
    assert got == ["sin_fecha", "posterior", "en_rango", "en_rango", "anterior"]


def test_cut_at_first_older(case):
    rows, df = case
    expected = []
    for group in listings(rows).values():
        for row in group:
            if row[5] is not None and row[5] < DLO and row[4] is not None and not row[4].endswith("7"):
                break
            expected.append(row)
    got = listing.cut_at_first_older(df, LO, F.col("link").isNotNull() & ~F.col("link").endswith("7"))
    assert as_set(got) == place(expected)


def test_replay(case):
    rows, df = case
    expected = []
    for name, group in listings(rows).items():
        seen = {}
        for row in group:
            if row[4] is None:
                continue
            if row[5] is not None and row[5] < DLO:
                break
            if kept(row[5]):
                seen.setdefault(row[4], row)
        expected += seen.values()
    got = listing.replay(df, LO, HI, F.col("link").isNotNull())
    assert as_set(got) == place(expected)


@pytest.mark.parametrize("block_pages", [1, 3, 1000])
@pytest.mark.parametrize("newer_resets, empty_ends", [(True, False), (False, False), (True, True)])
def test_stop_after_empty_pages(case, monkeypatch, block_pages, newer_resets, empty_ends):
    rows, df = case
    expected = []
    for group in listings(rows).values():
        run = 0
        for _, page in by_page(group):
            links = [r for r in page if r[4] is not None]
            if not links and empty_ends:
                break
            expected += links
            new = sum(kept(r[5]) for r in links)
            newer = any(r[5] is not None and r[5] > DHI for r in links)
            if links and new == 0 and not (newer_resets and newer):
                run += 1
                if run >= 2:
                    break
            else:
                run = 0
    original = listing.stop_after_run
    monkeypatch.setattr(
        listing, "stop_after_run",
        lambda pages, n, keys: original(pages, n, keys, block_pages=block_pages),
    )
    got = listing.stop_after_empty_pages(
        df, LO, HI, n=2, newer_resets=newer_resets, empty_page_ends=empty_ends
    )
    assert as_set(got) == place(expected)


@pytest.mark.parametrize("block_pages", [1, 4, 1000])
def test_runs_across_blocks(spark, block_pages):
    rng = random.Random(block_pages)
    rows, expected = [], {}
    for s in range(30):
        run, stop = 0, None
        for page in sorted(rng.sample(range(1, 80), 40)):
            counts = rng.random() < 0.75
            rows.append((f"p{s}", "t", page, counts))
            run = run + 1 if counts else 0
            if run == 7 and stop is None:
                stop = page
        if stop is not None:
            expected[f"p{s}"] = stop
    pages = spark.createDataFrame(rows, "periodico string, termino string, page int, _counts boolean")
    got = listing.stop_after_run(pages, 7, block_pages=block_pages)
    assert {r.periodico: r._stop for r in got.collect()} == expected


def test_stop_after_old_pages(case):
    rows, df = case
    expected = []
    for group in listings(rows).values():
        run = 0
        for _, page in by_page(group):
            expected += page
            fechas = [r[5] for r in page if r[5] is not None]
            if fechas:
                run = run + 1 if max(fechas) < DLO else 0
                if run >= 2:
                    break
    assert as_set(listing.stop_after_old_pages(df, LO)) == place(expected)


def test_stop_batch_all_older(case):
    rows, df = case
    expected = []
    for group in listings([r for r in rows if r[4] is not None]).values():
        seen = set()
        for _, page in by_page(group):
            new = []
            for row in page:
                if row[4] not in seen:
                    seen.add(row[4])
                    new.append(row)
            expected += new
            fechas = [r[5] for r in new if r[5] is not None]
            if fechas and all(f < DLO for f in fechas):
                break
    got = listing.stop_batch_all_older(df.filter("link IS NOT NULL"), LO)
    assert as_set(got) == place(expected)


@pytest.mark.parametrize("n", [1, 9, 40, 10_000])
@pytest.mark.parametrize("block", [1, 7, 1000])
def test_cap_per_group(case, monkeypatch, n, block):
    rows, df = case
    monkeypatch.setattr(listing, "BLOCK_PAGES", block)
    expected = [r for group in listings(rows).values() for r in group[:n]]
    assert as_set(listing.cap_per_group(df, n)) == place(expected)
    whole = []
    for group in listings(rows).values():
        last = group[n - 1][2] if len(group) >= n else None
        whole += [r for r in group if last is None or r[2] <= last]
    assert as_set(listing.stop_after_articles(df, n)) == place(whole)


def test_cap_of_a_hot_listing_and_odd_places(spark):
    """One page holds all rows of a listing; pages and positions may be null."""
    rows = spark.range(30_000).selectExpr(
        "'p' AS periodico", "'t' AS termino", "1 AS page", "cast(id as int) AS pos", "concat('l', id) AS link",
        "CAST(NULL AS TIMESTAMP) AS fecha",
    ).repartition(8)
    for n in (6000, 29_999, 30_001):
        got = listing.cap_per_group(rows, n)
        assert got.count() == min(n, 30_000) and got.agg(F.max("pos")).first()[0] == min(n, 30_000) - 1
    odd = spark.createDataFrame(
        [("p", "t", None, 5, "a", None), ("p", "t", 1, None, "b", None), ("p", "t", 1, 0, "c", None), ("p", "t", 1, 0, "d", None)],
        SCHEMA,
    )
    for n in range(1, 6):
        kept_links = sorted(r.link for r in listing.cap_per_group(odd, n).collect())
        assert kept_links == ["a", "b", "c", "d"][:n]
    assert listing.cap_per_group(odd.limit(0), 3).count() == 0


def test_caps_of_all_sizes_have_one_plan(spark, case):
    def shape(n):
        plan = listing.cap_per_group(case[1], n)._jdf.queryExecution().executedPlan().toString()
        return [line.split("(")[0].strip(" :+-*") for line in plan.splitlines() if "Exchange" in line or "Window" in line]

    assert shape(50) == shape(6000) and not any("WindowGroupLimit" in line for line in shape(6000))


def test_cap_pages(spark):
    df = spark.createDataFrame([(p,) for p in range(1, 30)], "page int")
    assert listing.cap_pages(df, 300, 20).count() == 15
    assert listing.cap_pages(df, 300, 20, F.lit(41)).count() == 3


def test_listing_dates_replace_article_dates(spark):
    rows = [
        ("p", "t", 1, 0, "a", datetime(2024, 1, 1)), ("p", "t", 2, 0, "a", None),
        ("p", "t", 1, 1, "b", datetime(2024, 1, 2)), ("p", "t", 3, 1, "b", datetime(2024, 1, 3)),
    ]
    listed = spark.createDataFrame(rows, SCHEMA)
    own = datetime(2023, 5, 5)
    articles = spark.createDataFrame(
        [("p", "t", x, own) for x in "abc"],
        "periodico string, termino string, link string, fecha timestamp",
    )
    read = lambda df: {r.link: r.fecha for r in df.collect()}
    got = read(joins.listing_date(articles, joins.last_listing_dates(listed)))
    assert got == {"a": None, "b": datetime(2024, 1, 3), "c": own}
    got = read(joins.listing_date(articles, joins.last_listing_dates(listed, skip_null=True)))
    assert got == {"a": datetime(2024, 1, 1), "b": datetime(2024, 1, 3), "c": own}


def test_listing_dates_belong_to_their_search(spark):
    days = [datetime(2024, 1, d) for d in (1, 2, 3)]
    rows = [("p", "t", 1, 0, "a", days[0]), ("p", "u", 1, 0, "a", days[1]), ("p", "u", 1, 0, "a", days[2])]
    for parts in (1, 3):
        listed = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        got = {r.termino: r.fecha_listado for r in joins.last_listing_dates(listed).collect()}
        assert got == {"t": days[0], "u": days[2]}


@pytest.mark.parametrize("source", ["portafolio", "publimetro", "las2orillas", "larepublica", "elmeridiano"])
def test_rows_are_not_dropped_for_their_number(spark, source):
    rows = [("p", "t", n // 20 + 1, n % 20, f"l{n}", datetime(2024, 1, 15)) for n in range(5000)]
    got = replay_source(spark.createDataFrame(rows, SCHEMA), LISTINGS[source], LO, HI)
    assert got.count() == 5000


def replay_loop(group, rule, historical):
    """One listing read page by page, as a plain loop."""
    most_empty = 10 if historical and rule.empty_pages and not rule.first_older else rule.empty_pages
    found, run_empty, run_old, seen = [], 0, 0, set()
    for number, page in by_page(group):
        links = [r for r in page if r[4] is not None]
        if not links and rule.empty_page_ends:
            break
        older, new, newer, fresh = False, 0, False, []
        for row in links:
            if rule.first_older and row[5] is not None and row[5] < DLO:
                older = True
                break
            if rule.older_batch:
                if row[4] in seen:
                    continue
                seen.add(row[4])
            fresh.append(row)
            new += kept(row[5])
            newer |= row[5] is not None and row[5] > DHI
        found += fresh
        if older:
            break
        if most_empty:
            counts = links and not new and not (rule.newer_resets and newer)
            run_empty = run_empty + 1 if counts else 0
            if run_empty >= most_empty:
                break
        dated = [r[5] for r in (fresh if rule.older_batch else links) if r[5] is not None]
        if rule.old_pages and dated:
            run_old = run_old + 1 if max(dated) < DLO else 0
            if run_old >= rule.old_pages:
                break
        if rule.older_batch and dated and all(f < DLO for f in dated):
            break
    if rule.whole_last_day:
        last = DHI + timedelta(days=1, seconds=-1)
        found = [r for r in found if r[5] is not None and DLO <= r[5] <= last]
    elif rule.filter_dates:
        found = [r for r in found if kept(r[5])]
    first = {}
    for row in found:
        first.setdefault(row[4], row)
    return list(first.values())


@pytest.mark.parametrize("historical", [False, True])
@pytest.mark.parametrize("source", list(LISTINGS))
def test_replay_of_every_source(spark, source, historical):
    rows = random_listing(7, sources=3, pages=120, empty_pages=0.03)
    df = spark.createDataFrame(rows, SCHEMA)
    rule = LISTINGS[source]
    expected = [r for g in listings(rows).values() for r in replay_loop(g, rule, historical)]
    got = replay_source(df, rule, LO, HI, historical)
    assert as_set(got) == place(expected)


def test_every_source_has_its_rules():
    types = {row[0]: row[3] for row in dimensions.SOURCES}
    html = {name for name, kind in types.items() if kind in ("html_static", "playwright")}
    assert html - set(RULES) == {"diariodelsur"}  # an RSS feed
    assert {name for name, kind in types.items() if kind == "queryly_api"} == set(QUERYLY)
    assert {name for name, kind in types.items() if kind != "wp_api"} <= set(LISTINGS)


@pytest.mark.parametrize(
    "source, link, shown, expected",
    [
        ("elpais", "/cali/nota", "2024-04-22", ("https://www.elpais.com.co/cali/nota", datetime(2024, 4, 22))),
        ("eluniversal", "/a/2023/b/c", "ene 5, 2023", ("https://www.eluniversal.com.co/a/2023/b/c", datetime(2023, 1, 5))),
        ("eluniversal", "/a/b", "ene 5, 2023", None),
        ("vanguardia", "/x", "Apr 22, 2024 10:30 AM", ("https://www.vanguardia.com/x", datetime(2024, 4, 22))),
    ],
)
def test_search_service_sources(spark, source, link, shown, expected):
    body = '{"items":[{"link":"%s","pubdate":"%s"}],"metadata":{"total":1}}' % (link, shown)
    payloads = spark.createDataFrame([(1, body)], "page int, body string")
    got = [(r.link, r.fecha) for r in links_from_payloads(payloads, QUERYLY[source]).collect()]
    assert got == ([] if expected is None else [expected])
