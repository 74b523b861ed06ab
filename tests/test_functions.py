"""Golden cases of the date, URL and text expressions."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from noticiario.functions import dates, text, urls

D = datetime

DATE_CASES = [
    (dates.es_month_day, "marzo 3, 2026", D(2026, 3, 3)),
    (dates.es_month_day, "publicado: Marzo 3 2026", D(2026, 3, 3)),
    (dates.es_month_day, "march 3, 2026", None),
    (dates.es_day_de_month, "martes 24 de febrero, 2026", D(2026, 2, 24)),
    (dates.es_text, "martes 24 de febrero, 2026", D(2026, 2, 24)),
    (dates.es_text, "febrero 2, 2026", D(2026, 2, 2)),
    (dates.es_text, "30 de febrero, 2024 y marzo 3, 2024", None),
    (dates.es_abbr, "03 mar 2026", D(2026, 3, 3)),
    (dates.es_abbr, "3 marzo 2026", None),
    (dates.iso_date, "2024-01-15T10:30:00-05:00", D(2024, 1, 15)),
    (dates.iso_datetime, "2024-01-15T10:30:00-05:00", D(2024, 1, 15, 10, 30)),
    (dates.iso_datetime, "2024-01-15T10:30:00Z", D(2024, 1, 15, 10, 30)),
    (dates.iso_datetime, "2024-01-15T10:30:00.250", D(2024, 1, 15, 10, 30, 0, 250000)),
    (dates.iso_datetime, "2024-01-15", D(2024, 1, 15)),
    (dates.iso_datetime, "2024-01-15T25:30:00", None),
    (dates.iso_datetime_short_offset, "2023-04-15T10:30:00-05:00", D(2023, 4, 15)),
    (dates.iso_datetime_short_offset, "2023-04-15T10:30:00-0500", D(2023, 4, 15, 10, 30)),
    (dates.iso_datetime_short_offset, "2023-04-15T10:30:00", D(2023, 4, 15, 10, 30)),
    (dates.iso_datetime_short_offset, "2023-04-15", D(2023, 4, 15)),
    (dates.to_utc_naive, "2024-01-15T10:30:00-05:00", D(2024, 1, 15, 15, 30)),
    (dates.to_utc_naive, "2024-01-15", D(2024, 1, 15)),
    (dates.to_utc_naive, " Tue, 05 Mar 2024 10:00:00 -0500 ", D(2024, 3, 5, 15)),
    (dates.to_utc_naive, "5 Mar 2024 23:30:10 +01:00", D(2024, 3, 5, 22, 30, 10)),
    (dates.to_utc_naive, "Tue, 5 Mar 2024 10:00:00 GMT", D(2024, 3, 5, 10)),
    (dates.to_utc_naive, "March 5, 2024", D(2024, 3, 5)),
    (dates.to_utc_naive, "Sunday, March 3rd, 2024 3:15 PM", D(2024, 3, 3, 15, 15)),
    (dates.to_utc_naive, "Sept. 5, 2024 12:05 am", D(2024, 9, 5, 0, 5)),
    (dates.to_utc_naive, "5 March 2024", D(2024, 3, 5)),
    (dates.to_utc_naive, "05-Mar-2024 07:08", D(2024, 3, 5, 7, 8)),
    (dates.to_utc_naive, "Tue Mar  5 10:00:00 2024", D(2024, 3, 5, 10)),
    (dates.to_utc_naive, "20240305", D(2024, 3, 5)),
    (dates.to_utc_naive, "20240305T101530", D(2024, 3, 5, 10, 15, 30)),
    (dates.to_utc_naive, "05/03/2024", D(2024, 5, 3)),
    (dates.to_utc_naive, "25/03/2024 08:09:10", D(2024, 3, 25, 8, 9, 10)),
    (dates.to_utc_naive, "5.3.2024", D(2024, 5, 3)),
    (dates.to_utc_naive, "2024/03/05 10:15", D(2024, 3, 5, 10, 15)),
    (dates.to_utc_naive, "31/31/2024", None), (dates.to_utc_naive, "March 35, 2024", None),
    (dates.to_utc_naive, "Marte 5, 2024", None), (dates.to_utc_naive, "5 de marzo de 2024", None),
    (dates.to_utc_naive, "20241305", None), (dates.to_utc_naive, "ayer", None), (dates.to_utc_naive, "", None),
    (dates.to_utc_naive, "Tue, 05 Mar 2024 25:00:00 +0000", None),
    (dates.en_abbr, "Mar 02, 2026", D(2026, 3, 2)),
    (dates.en_abbr, "Apr 22, 2024 10:30 AM", D(2024, 4, 22)),
    (dates.en_abbr, "Apr 2, 2024 10:30 AM", None),
    (dates.en_abbr_or_iso, "2024-04-22 more", D(2024, 4, 22)),
    (dates.es_as_en, "ene 5, 2023", D(2023, 1, 5)),
    (dates.es_as_en, "January 5, 2023", D(2023, 1, 5)),
    (dates.es_as_en, "enero 5, 2023", None),
    (dates.slash_crumb, "sitio › 2023/07/09", D(2023, 7, 9)),
    (dates.rfc2822, "Tue, 05 Mar 2024 10:00:00 +0000", D(2024, 3, 5, 10)),
    (dates.rfc2822, "Tue, 05 Mar 2024 10:00:00 -0500", D(2024, 3, 5, 10)),
    (dates.rfc2822, "05 Mar 24 10:00 GMT", D(2024, 3, 5, 10)),
    (dates.es_positional, "agosto 13, 2024", D(2024, 8, 13)),
    (dates.es_positional, "agosto 13 de 2024", None),
    (dates.FORMATS["es_positional_de"], "agosto 13 de 2024", D(2024, 8, 13)),
    (dates.bullet_dmy, "Judicial • 09/07/2023", D(2023, 7, 9)),
] + [
    (parser, bad, None)
    for parser in dates.FORMATS.values()
    for bad in ("basura", "", "febrero 30, 2024", None)
]


def test_date_formats(spark):
    rows = [(i, case[1]) for i, case in enumerate(DATE_CASES)]
    df = spark.createDataFrame(rows, "i int, raw string")
    wrong = []
    parsers = {case[0] for case in DATE_CASES}
    for parser in parsers:
        wanted = {i: c[2] for i, c in enumerate(DATE_CASES) if c[0] is parser}
        part = df.filter(F.col("i").isin(list(wanted)))
        for row in part.select("i", "raw", parser(F.col("raw")).alias("d")).collect():
            if row.d != wanted[row.i]:
                wrong.append((getattr(parser, "__name__", ""), row.raw, row.d, wanted[row.i]))
    assert not wrong


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("4 meses ago", D(2025, 9, 3)),
        ("1 año ago", D(2025, 1, 1)),
        ("3 semanas ago", D(2025, 12, 11)),
        ("2 días ago", D(2025, 12, 30)),
        ("5 horas ago", D(2025, 12, 31, 19)),
        ("7 minutos", D(2025, 12, 31, 23, 53)),
        ("hace 2 días", None),
        ("2", None),
        ("99999999 años ago", None),
        ("", None),
        (None, None),
    ],
)
def test_relative_dates(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "raw string")
    got = df.select(dates.es_relative(F.col("raw"), "2026-01-01 00:00:00").alias("d"))
    assert got.first().d == expected


def test_positional_text_keeps_impossible_day(spark):
    df = spark.createDataFrame([("febrero 30 de 2024",), ("x",)], "raw string")
    got = [r.d for r in df.select(dates.es_positional_text(F.col("raw")).alias("d")).collect()]
    assert got == ["2024-02-30", None]


def test_first_format_wins(spark):
    df = spark.createDataFrame([("2024-01-15",), ("03 mar 2026",), ("-",)], "raw string")
    got = df.select(dates.parse_date(F.col("raw"), ["iso_date", "es_abbr"]).alias("d"))
    assert [r.d for r in got.collect()] == [D(2024, 1, 15), D(2026, 3, 3), None]


@pytest.mark.parametrize(
    "term, title, body, score",
    [
        ("Meta conflicto", "Noticias", "Meta y metal", 2),
        ("La Guajira conflicto", "La Guajira hoy", "en La Guajira", 3),
        ("Norte de Santander derechos", None, None, 0),
        ("Meta", "x", None, 3),
        ("Meta", "x", "abc", 6),
        ("Chocó social", "Choco", "choco", 0),
        ("aa x", "", "aaaaa", 2),
    ],
)
def test_mention_score(spark, term, title, body, score):
    df = spark.createDataFrame([(term, title, body)], "term string, title string, body string")
    place = text.territory(F.col("term"))
    assert df.select(text.mention_score(F.col("body"), F.col("title"), place)).first()[0] == score


def test_territory(spark):
    df = spark.createDataFrame(
        [("  Norte  de Santander derechos ",), ("Meta",), ("",)], "term string"
    )
    got = [r[0] for r in df.select(text.territory(F.col("term"))).collect()]
    assert got == ["norte de santander", "", ""]


def test_slug(spark):
    df = spark.createDataFrame([("San Andrés y Providencia",), ("Nariño",)], "d string")
    got = [r[0] for r in df.select(text.slug(F.col("d"))).collect()]
    assert got == ["san_andres_y_providencia", "narino"]


def test_article_links(spark):
    df = spark.createDataFrame(
        [("/a/2023/b/c",), ("/a/1999/b/c",), ("/a/2023/b",), ("http://x/a/2023/b/c",), (None,)],
        "href string",
    )
    got = [r[0] for r in df.select(urls.is_article(F.col("href"), 4, 2)).collect()]
    assert got == [True, False, False, False, False]


def test_absolute_links(spark):
    df = spark.createDataFrame([("/a",), ("a",), ("http://x/a",)], "href string")
    got = df.select(
        urls.absolutise(F.col("href"), "http://b").alias("p"),
        urls.absolutise_rooted(F.col("href"), "http://b").alias("q"),
    ).collect()
    assert [tuple(r) for r in got] == [
        ("http://b/a", "http://b/a"), ("http://ba", "a"), ("http://x/a", "http://x/a"),
    ]
