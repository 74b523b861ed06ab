"""Golden cases of filters, reports and streams."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from noticiario.functions import text
from noticiario.operators import columns, dedup, filters, reports, sets
from noticiario.plans import consolidate, health, progress
from noticiario.sources import dimensions, registry
from noticiario.streaming import arrivals

D = datetime


def test_date_window(spark):
    dates = [None, D(2022, 12, 31, 23, 59, 59), D(2023, 1, 1), D(2023, 12, 31, 18), D(2024, 1, 1)]
    df = spark.createDataFrame(list(enumerate(dates)), "i int, fecha timestamp")
    kept = lambda rows: sorted(r.i for r in rows.collect())
    assert kept(filters.filter_date_range(df, "2023-01-01", "2023-12-31")) == [0, 2, 3]
    assert kept(filters.filter_date_range(df, "2023-01-01", "2023-12-31", keep_null=False)) == [2, 3]


def test_relevance_thresholds(spark):
    df = spark.createDataFrame(
        [(1, "Meta paz", "t", "Meta"), (2, "Meta paz", "t", "nada")],
        "i int, termino string, titulo string, texto string",
    )
    assert filters.filter_relevant(df, 1).count() == 1
    assert filters.filter_relevant(df, 0).count() == 2
    # The override for national sources comes before the test for zero.
    national = filters.effective_minimum(0, F.lit(True))
    assert filters.filter_relevant(df, national).count() == 1


def test_blank_text(spark):
    df = spark.createDataFrame([("  \n",), ("",), (None,), ("x",)], "texto string")
    assert [r.texto for r in filters.drop_empty_text(df).collect()] == ["x"]


def test_merge_matches_the_three_steps(spark):
    df = spark.createDataFrame(
        [("u1", "violencia", 1), ("u1", "conflicto", 2), ("u1", "conflicto", 3), ("u2", "derechos", 4),
         (None, "social", 5), (None, "social", 6)],
        "url string, tema string, n int",
    )
    merged = dedup.merge_by_url(df, [F.col("n")])
    got = {(r.url, r.n, r.terminos_encontrado) for r in merged.collect()}
    assert got == {("u1", 1, "conflicto, violencia"), ("u2", 4, "derechos"), (None, 5, None)}
    stats = reports.dedup_stats(df).first()
    assert (stats.total, stats.duplicados, stats.unicos) == (6, 3, 3)
    again = dedup.dedup_keep_first(merged, [F.col("n")])
    assert again.count() == merged.count()


def test_empty_stats(spark):
    empty = spark.createDataFrame([], "url string, fecha timestamp")
    assert tuple(reports.dedup_stats(empty).first()) == (0, 0, 0)
    assert tuple(reports.date_span(empty).first()) == (None, None)


@pytest.mark.parametrize(
    "arts, seconds, http, failure, status",
    [
        (5, 10.0, 200, None, "OK"),
        (5, 60.0, 200, None, "Lento"),
        (0, 1.0, 301, None, "Sin_resultados"),
        (0, 1.0, 404, None, "Roto"),
        (0, 1.0, None, None, "Roto"),
        (9, 1.0, 200, "Timeout", "Roto"),
    ],
)
def test_health(spark, arts, seconds, http, failure, status):
    runs = spark.createDataFrame(
        [("s", "Meta paz", arts, seconds, "wp_api", http, failure)],
        "id string, termino string, arts int, tiempo_s double, tipo string, http_status int, failure string",
    )
    classified, summary, _ = health.health_report(runs)
    row = classified.first()
    assert row.status == status
    assert summary.first()[status.lower()] == 1
    assert (row.error is None) == (status in ("OK", "Lento"))


def test_error_report(spark):
    rows = [("b", "X")] * 60 + [("a", "X")] * 250 + [("c", "PrimeraPagina")] + [("d", "Y")]
    errors = spark.createDataFrame(rows, "periodico string, tipo string")
    table, totals = health.error_report(errors)
    assert [(r.periodico, r.n, r.nota) for r in table.collect()] == [
        ("c", 1, "primera página no cargó"), ("a", 250, "posible bloqueo total"),
        ("b", 60, "muchos fallos"), ("d", 1, ""),
    ]
    assert tuple(totals.first()) == (312, 4)


def test_unions(spark):
    a = spark.createDataFrame([("u1", "local", D(2023, 1, 1), "x")], "url string, titulo string, fecha timestamp, t string")
    b = spark.createDataFrame([("u1", "otro", D(2023, 2, 1)), ("u2", "otro", None)], "url string, titulo string, fecha timestamp")
    both = sets.union_backup(a, b)
    assert sorted((r.url, r.titulo, r.t) for r in both.collect()) == [("u1", "local", "x"), ("u2", "otro", None)]
    assert columns.to_canonical(b).columns == ["periodico", "titulo", "fecha", "texto", "url"]


def test_stage_counts_add_up(spark):
    df = spark.range(100).select((F.col("id") % 7 == 0).alias("a"), F.when(F.col("id") % 3 == 0, True).alias("b"))
    row = reports.stage_counts(df, {"a": F.col("a"), "b": F.col("b")}).first()
    assert row.a_quedan + row.a_descartados == row.total == 100
    assert row.b_quedan + row.b_descartados == row.a_quedan


def test_route_keeps_departments_without_sources(spark):
    departments = dimensions.departments_table(spark, ["Vichada", "Arauca", "Otro"])
    rows = registry.route(departments, dimensions.routing_table(spark)).collect()
    assert sorted((r.departamento, r.fuente or "") for r in rows) == [
        ("Arauca", "lavozdelcinaruco"), ("Arauca", "tronchandosinfronteras"), ("Otro", ""), ("Vichada", ""),
    ]
    limits = registry.attach_thresholds(departments, dimensions.thresholds_table(spark))
    assert {r.departamento: r.min_menciones for r in limits.collect()} == {"Vichada": 2, "Arauca": 2, "Otro": 3}


def test_progress_without_any_output(spark, tmp_path):
    report = progress.progress_report(spark, dimensions.groups_table(spark), str(tmp_path / "none"))
    assert {r.estado for r in report["grupos"].collect()} == {"PENDIENTE"}
    assert tuple(report["total"].first()) == (0, 32)
    assert report["pendientes"].count() == 32


def test_slug_of_other_alphabets(spark):
    df = spark.createDataFrame([("Łódź ā ß Ñ",)], "d string")
    assert df.select(text.slug(F.col("d"))).first()[0] == "odz_a__n"


def test_stream_sees_a_url_once_across_batches(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    row_type = "periodico string, titulo string, fecha timestamp, texto string, url string, departamento string"
    write = lambda urls: spark.createDataFrame(
        [("p", "t", None, "x", u, "Meta") for u in urls], row_type
    ).coalesce(1).write.mode("append").parquet(source)
    for urls in (["u1", "u2", "u1"], ["u2", "u3"]):
        write(urls)
        schema = spark.read.parquet(source).schema
        stream = arrivals.stream_dedup(arrivals.stream_articles(spark, source, schema))
        arrivals.write_stream(stream, root, str(tmp_path / "check"), available_now=True).awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(root).collect()) == ["u1", "u2", "u3"]


def test_consolidation_summaries(spark):
    rows = [("p", "t", D(2023, 1, 1), "x", "u1", "Meta", "f1"), ("p", "t", D(2023, 2, 1), "x", "u1", "Cesar", "f2")]
    stored = spark.createDataFrame(
        rows, "periodico string, titulo string, fecha timestamp, texto string, url string, departamento string, archivo string"
    )
    parts = consolidate.summaries(stored, consolidate.clean(stored))
    assert tuple(parts["duplicados"].first()) == (2, 1, 1)
    assert [tuple(r) for r in parts["departamentos"].collect()] == [("Cesar", 1)]
    assert [tuple(r) for r in parts["archivos"].collect()] == [("f1", 1), ("f2", 1)]


def test_orphan_names_cover_customers_with_orders_and_suppliers(spark, sf_small):
    from checks import summaries, views

    got = {(r.n, r.slug) for r in summaries.orphan_files(spark, sf_small).collect()}
    nation = {r.c_custkey: r.c_nationkey for r in views.read(spark, sf_small, "customer").collect()}
    ordered = {r.o_custkey for r in views.read(spark, sf_small, "orders").select("o_custkey").collect()}
    customers = {n for n, slug in got if slug.startswith("customer")}
    assert customers == {n for n in ordered if nation[n] >= 5} != set()
    suppliers = views.read(spark, sf_small, "supplier").count()
    assert len(got) - len(customers) == suppliers


def test_arriving_files_are_bounded_and_come_in_three_batches(spark, sf_small, tmp_path, monkeypatch):
    from checks import storage, views

    monkeypatch.setattr(storage, "_FILE_BYTES", 10_000, raising=False)
    monkeypatch.setattr(storage, "shared_path", lambda spark, label: str(tmp_path / label))
    stream = storage._article_stream(spark, sf_small, "*.parquet")
    files = list((tmp_path / "arrivals").glob("*.parquet"))
    assert len(files) > 3
    assert spark.read.parquet(str(tmp_path / "arrivals")).count() == views.articles(spark, sf_small).count()
    query = arrivals.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), True)
    query.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 3
