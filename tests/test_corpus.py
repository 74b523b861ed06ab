"""Search, merge, backup and persistence on small hand-made inputs."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from checks import views
from noticiario import schema
from noticiario.plans import consolidate, corpus
from noticiario.sources import dimensions, readers, registry, writers

D = datetime
CANDIDATE = (
    "fuente string, termino string, periodico string, titulo string, fecha timestamp, "
    "texto string, url string, n int"
)


def plan_for(spark, routing, topics=("paz",), **options):
    departments = dimensions.departments_table(spark, list(routing))
    return registry.search_plan(
        departments,
        dimensions.routing_table(spark, routing),
        dimensions.thresholds_table(spark),
        dimensions.sources_table(spark),
        topics=list(topics),
        **options,
    )


def candidate(fuente, termino, url, n, text="Meta Meta Meta", fecha=D(2023, 5, 1), titulo="t"):
    return (fuente, termino, fuente.upper(), titulo, fecha, text, url, n)


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_default_dimensions(spark):
    assert dimensions.sources_table(spark).count() == 27
    assert dimensions.routing_table(spark).count() == 32
    assert dimensions.groups_table(spark).select("departamento").distinct().count() == 32
    plan = plan_for(spark, dimensions.ROUTING, dimensions.TOPICS)
    local = plan.filter(F.col("origen") == registry.LOCAL)
    assert local.count() == 5 * sum(len(ids) for ids in dimensions.ROUTING.values())
    # National sources need one mention, Meta two, Antioquia three.
    limits = {(r.departamento, r.fuente): r.umbral for r in local.collect()}
    assert limits["Meta", "llanoalmundo"] == 2
    assert limits["Antioquia", "elcolombiano"] == 3
    assert limits["Boyacá", "eltiempo"] == 1


def test_stand_in_only_where_a_local_source_found_nothing(spark):
    plan = plan_for(spark, {"Meta": ["llanoalmundo", "elpilon"]}, ["paz", "agua"])
    found = spark.createDataFrame(
        [
            candidate("llanoalmundo", "Meta paz", "u1", 1),
            candidate("elpilon", "Meta paz", "u2", 2),
            candidate("eltiempo", "Meta paz", "u3", 3),
            candidate("llanoalmundo", "Meta agua", "u4", 4),
            candidate("elpilon", "Meta agua", "u5", 5, text="Meta"),  # too few mentions
            candidate("eltiempo", "Meta agua", "u6", 6, text="Meta"),  # national: one is enough
            candidate("corrillos", "Meta paz", "u7", 7),  # not in the plan
        ],
        CANDIDATE,
    )
    got = corpus.search_sources(found, plan)
    assert rows(got, "tema", "url") == [
        ("agua", "u4"), ("agua", "u6"), ("paz", "u1"), ("paz", "u2"),
    ]


def test_no_stand_in_when_it_is_planned_or_all_sources_are_national(spark):
    plan = plan_for(spark, {"Tolima": ["eltiempo", "bcnoticias"], "Boyacá": ["eltiempo"]})
    found = spark.createDataFrame(
        [candidate("verdadabierta", "Tolima paz", "u1", 1, text="Tolima")], CANDIDATE
    )
    assert corpus.search_sources(found, plan).count() == 0


def test_topics_merge_and_window(spark):
    plan = plan_for(spark, {"Meta": ["llanoalmundo"]}, ["violencia", "conflicto"])
    found = spark.createDataFrame(
        [
            candidate("llanoalmundo", "Meta violencia", "u1", 1, titulo="viejo", fecha=D(2023, 1, 1)),
            candidate("llanoalmundo", "Meta violencia", "u1", 2, titulo="nuevo", fecha=D(2023, 6, 1)),
            candidate("llanoalmundo", "Meta conflicto", "u1", 3, titulo="otro", fecha=D(2023, 9, 1)),
            candidate("llanoalmundo", "Meta conflicto", "u2", 4, fecha=None),
            candidate("llanoalmundo", "Meta conflicto", "u3", 5, fecha=D(2024, 1, 1)),
            candidate("llanoalmundo", "Meta conflicto", "u4", 6, fecha=D(2023, 12, 31, 18)),
            candidate("llanoalmundo", "Meta conflicto", None, 7),
            candidate("llanoalmundo", "Meta violencia", None, 8),
        ],
        CANDIDATE,
    )
    got = corpus.search_topics(found, plan, "2023-01-01", "2023-12-31", tie=["n"])
    assert sorted(
        (r.url or "", r.terminos_encontrado, r.titulo) for r in got.collect()
    ) == [
        ("", None, "t"), ("u1", "conflicto, violencia", "nuevo"),
        ("u2", "conflicto", "t"), ("u4", "conflicto", "t"),
    ]
    assert got.columns == [
        "periodico", "titulo", "fecha", "texto", "url", "terminos_encontrado", "departamento",
    ]


@pytest.mark.parametrize("minimum, expected", [(1, ["u1", "u2"]), (3, ["u1", "u2", "u3"])])
def test_backup_tops_up_thin_departments(spark, minimum, expected):
    plan = plan_for(spark, {"Meta": ["llanoalmundo"]}, ["paz", "agua"])
    found = spark.createDataFrame(
        [
            candidate("llanoalmundo", "Meta paz", "u1", 1),
            candidate("llanoalmundo", "Meta agua", "u2", 2),
            candidate("eltiempo", "Meta agua", "u1", 3, text="Meta"),
            candidate("verdadabierta", "Meta agua", "u3", 4, text="Meta"),
        ],
        CANDIDATE,
    )
    got = corpus.department_corpus(found, plan, min_articles=minimum, tie=["n"])
    assert rows(got, "url") == [(u,) for u in expected]
    terms = {r.url: r.terminos_encontrado for r in got.collect()}
    assert terms["u1"] == "paz"  # the backup copy does not add its term


def test_department_without_sources_uses_backup(spark):
    plan = plan_for(spark, {"Vichada": [], "Meta": ["llanoalmundo"]})
    found = spark.createDataFrame(
        [candidate("eltiempo", "Vichada paz", "u1", 1, text="Vichada")], CANDIDATE
    )
    got = corpus.department_corpus(found, plan)
    assert rows(got, "departamento", "url", "terminos_encontrado") == [("Vichada", "u1", "paz")]
    assert corpus.department_corpus(found, plan, use_backup=False).count() == 0


def test_municipality(spark):
    found = spark.createDataFrame(
        [
            candidate("llanoalmundo", "Granada paz", "u1", 1, text="Granada granada GRANADA"),
            candidate("eltiempo", "Granada agua", "u1", 2, text="Granada"),
            candidate("llanoalmundo", "Granada agua", "u2", 3, text="Granada"),
        ],
        CANDIDATE,
    )
    places = spark.createDataFrame([("Granada",)], "municipio string")
    got = corpus.municipality_corpus(
        found, places, dimensions.sources_table(spark), ["paz", "agua"], tie=["n"]
    )
    assert rows(got, "municipio", "url", "terminos_encontrado") == [
        ("Granada", "u1", "agua, paz")
    ]


def test_municipality_stand_in(spark):
    found = spark.createDataFrame(
        [
            candidate("llanoalmundo", "Granada paz", "u1", 1, text="Granada granada GRANADA"),
            candidate("eltiempo", "Granada paz", "u2", 2, text="Granada"),
            candidate("eltiempo", "Granada agua", "u3", 3, text="Granada"),
        ],
        CANDIDATE,
    )
    places = spark.createDataFrame([("Granada",)], "municipio string")
    local = registry.select_sources(dimensions.sources_table(spark), ["llanoalmundo"])
    got = corpus.municipality_corpus(found, places, local, ["paz", "agua"], tie=["n"])
    assert rows(got, "url") == [("u1",), ("u3",)]


def test_run_resumes_and_replaces(spark, tmp_path):
    root = str(tmp_path / "corpus")
    routing = {"Meta": ["llanoalmundo"], "San Andrés y Providencia": ["eltiempo"], "Cesar": []}
    departments = dimensions.departments_table(spark, list(routing))
    plan = plan_for(spark, routing)
    text = "San Andrés y Providencia"
    first = spark.createDataFrame(
        [
            candidate("llanoalmundo", "Meta paz", "u1", 1),
            candidate("eltiempo", f"{text} paz", "u2", 2, text=text),
        ],
        CANDIDATE,
    )
    got = corpus.all_departments_corpus(first, departments, plan, root, tie=["n"])
    assert rows(got, "departamento", "url") == [("Meta", "u1"), (text, "u2")]

    inventory = readers.corpus_inventory(spark, root)
    assert {r.departamento for r in inventory.collect()} == {"Meta", text}
    assert rows(writers.resume_plan(departments, root), "departamento") == [("Cesar",)]

    second = spark.createDataFrame(
        [
            candidate("llanoalmundo", "Meta paz", "u9", 1),
            candidate("eltiempo", "Cesar paz", "u3", 2, text="Cesar"),
        ],
        CANDIDATE,
    )
    again = corpus.all_departments_corpus(second, departments, plan, root, tie=["n"])
    assert rows(again, "departamento", "url") == [("Cesar", "u3"), ("Meta", "u1"), (text, "u2")]
    forced = corpus.all_departments_corpus(second, departments, plan, root, force=True, tie=["n"])
    assert rows(forced, "departamento", "url") == [("Cesar", "u3"), ("Meta", "u9"), (text, "u2")]


def test_bad_file_is_reported_and_rebuilt(spark, tmp_path):
    root = tmp_path / "corpus"
    data = spark.createDataFrame(
        [("p", "t", D(2023, 1, 1), "x", "u1", "paz", "Meta"), ("p", "t", None, "y", "u2", None, "Chocó")],
        "periodico string, titulo string, fecha timestamp, texto string, url string, "
        "terminos_encontrado string, departamento string",
    )
    writers.write_corpus(data, str(root))
    bad = root / "departamento=Arauca"
    bad.mkdir()
    (bad / "part-0.parquet").write_bytes(b"not parquet at all")
    stored = readers.read_corpus(spark, str(root), tolerate_bad=True, with_file=True)
    assert rows(stored, "url") == [("u1",), ("u2",)]
    inventory = readers.corpus_inventory(spark, str(root))
    assert rows(readers.bad_files(inventory, stored), "departamento") == [("Arauca",)]
    departments = dimensions.departments_table(spark, ["Meta", "Arauca", "Chocó"])
    assert rows(writers.resume_plan(departments, str(root)), "departamento") == [("Arauca",)]
    assert consolidate.consolidate(spark, str(root)).count() == 2
    # a good file beside a damaged one does not make a department complete
    (root / "departamento=Meta" / "part-bad.parquet").write_bytes(b"PAR1 cut off")
    assert rows(writers.resume_plan(departments, str(root)), "departamento") == [("Arauca",), ("Meta",)]


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="departamento"):
        readers.require_columns(spark.createDataFrame([("x",)], "url string"))


def test_consolidation_order(spark):
    data = spark.createDataFrame(
        [
            ("p", "a", D(2023, 5, 1), "  ", "u1", "Arauca"),
            ("p", "b", D(2023, 1, 1), "texto", "u1", "Meta"),
            ("p", "c", D(2023, 1, 1), " \n", "u2", "Meta"),
            ("p", "d", D(2023, 1, 1), "texto", "u3", "Meta"),
        ],
        "periodico string, titulo string, fecha timestamp, texto string, url string, departamento string",
    )
    assert rows(consolidate.clean(data), "titulo") == [("d",)]
    assert rows(consolidate.clean(data, content_first=True), "titulo") == [("b",), ("d",)]


def test_states_of_stored_files(spark, tmp_path):
    import glob
    import os

    from noticiario.sources import manifest

    root = str(tmp_path / "corpus")
    rows = spark.range(400).selectExpr(
        "'p' AS periodico", "concat('t', id) AS titulo", "timestamp_seconds(1680000000 + id) AS fecha",
        "repeat(concat('texto ', id, ' '), 50) AS texto", "IF(id % 10 = 0, NULL, concat('u', id)) AS url",
        "'a' AS terminos_encontrado",
        "element_at(array('Uno', 'Dos ñ+%', 'Tres', 'Cuatro', 'Cinco'), cast(id % 5 + 1 as int)) AS departamento",
    )
    writers.write_corpus(rows, root)
    lines = {r.departamento: r for r in manifest.manifest(spark, root).collect()}
    assert {d: (r.filas, r.sin_url) for d, r in lines.items()} == {
        "Uno": (80, 40), "Dos ñ+%": (80, 0), "Tres": (80, 0), "Cuatro": (80, 0), "Cinco": (80, 0)}
    assert all((r.hasta - r.desde).total_seconds() == 395 for r in lines.values())
    assert readers.read_corpus(spark, root).count() == 400  # the manifest is no part of the corpus

    def states(**more):
        found = manifest.file_states(spark, root, **more).collect()
        return {r.departamento: (r.estado, r.filas) for r in found}

    assert states() == states(deep=True) == {d: ("bien", 80) for d in lines}

    def file_of(name):
        (found,) = glob.glob(f"{root}/departamento={name}*/*.parquet")
        for checksum in glob.glob(f"{root}/departamento={name}*/.*.crc"):
            os.remove(checksum)  # shared stores have none
        return found

    with open(file_of("Uno"), "r+b") as f:  # cut short
        f.truncate(os.path.getsize(f.name) - 7)
    os.remove(file_of("Tres"))
    with open(file_of("Cuatro"), "r+b") as f:  # same size, other content
        f.seek(50)
        f.write(b"\xff" * (os.path.getsize(f.name) // 2))
    for name, content in {"Basura": b"nothing", "Falso": b"PAR1" + b"x" * (1 << 20) + b"PAR1"}.items():
        os.makedirs(f"{root}/departamento={name}")
        with open(f"{root}/departamento={name}/a.parquet", "wb") as f:
            f.write(content)
    columns = [c for c in rows.columns if c != "departamento"]
    rows.limit(0).select(*columns).write.parquet(f"{root}/departamento=Vacio")
    rows.limit(3).select(*columns).write.parquet(f"{root}/departamento=Ajeno")
    wanted = {
        "Uno": ("danado", 80), "Dos ñ+%": ("bien", 80), "Tres": ("falta", 80), "Cuatro": ("bien", 80),
        "Cinco": ("bien", 80), "Basura": ("danado", 0), "Falso": ("danado", 0), "Vacio": ("vacio", 0),
        "Ajeno": ("bien", 3),
    }
    assert states() == wanted
    assert states(deep=True) == wanted | {"Cuatro": ("danado", 80)}
    places = spark.createDataFrame([(k, d) for k, d in enumerate([*wanted, "Nuevo"])], "pos int, departamento string")
    pending = {r.departamento for r in writers.resume_plan(places, root).collect()}
    assert pending == {"Uno", "Tres", "Basura", "Falso", "Nuevo"}
    inventory = readers.corpus_inventory(spark, root)
    stored = readers.read_corpus(spark, root, tolerate_bad=True, row_type=schema.CORPUS, with_file=True)
    bad = {r.departamento for r in readers.bad_files(inventory, stored, root).collect()}
    assert {"Basura", "Falso"} <= bad and not bad & {"Vacio", "Ajeno", "Cinco"}

    # building a department again replaces its lines alone
    writers.write_corpus(rows.filter("departamento = 'Uno' AND url IS NOT NULL"), root)
    assert states()["Uno"] == ("bien", 40) and states()["Cinco"] == ("bien", 80)
    summary = corpus.run_report(places, root, spark.createDataFrame([("Cinco", "x")], "departamento string, m string"))
    kept = {r.departamento: (r.articulos, r.estado) for r in summary["departamentos"].collect()}
    assert kept["Uno"] == (40, "con datos") and kept["Nuevo"] == (0, "sin datos")
    assert kept["Cinco"] == (80, "con error") and kept["Tres"] == (80, "con error")
    total = summary["total"].first()
    assert (total.departamentos, total.con_datos, total.con_error) == (10, 5, 4)


def test_summary_reads_no_article(spark, sf_small, tmp_path):
    root = str(tmp_path / "corpus")
    writers.write_corpus(views.articles(spark, sf_small).withColumn("terminos_encontrado", F.col("tema")), root)
    places = views.departments(spark)
    for part in corpus.run_report(places, root).values():
        files = part.inputFiles()
        assert any("_manifiesto" in f for f in files)
        assert not any(root in f and "_manifiesto" not in f for f in files)
