"""Physical plans: what is pushed down, shuffled and broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from checks import corpora, listings, rows, storage, summaries, views  # noqa: F401
from checks.registered import QUERIES
from noticiario.operators import dedup, filters, listing
from noticiario.plans import corpus, listings as listing_jobs
from noticiario.session import broadcast_if_small, pin, shared_folder, shared_table
from noticiario.sources import dimensions, readers, writers

# Queries that run jobs of their own while they are built.
EAGER = {
    name for name, query in QUERIES.items()
    if query.__name__ in vars(storage)
}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan):
    return len(re.findall(r"\bExchange hashpartitioning", plan))


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in EAGER])
def test_no_slow_operators(spark, sf_small, name):
    plan = plan_of(QUERIES[name](spark, sf_small))
    for operator in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas",
                     "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan


def test_date_window_reaches_the_scan(spark, sf_small, tmp_path):
    root = str(tmp_path / "corpus")
    writers.write_corpus(storage.corpus_rows(spark, sf_small), root)
    rows = filters.filter_date_range(readers.read_corpus(spark, root), views.LO, views.HI)
    one = rows.filter("departamento = 'The'").select("url")
    plan = plan_of(one)
    assert re.search(r"PushedFilters: \[Or\(IsNull\(fecha\),And\(GreaterThanOrEqual\(fecha", plan)
    assert re.search(r"PartitionFilters: \[isnotnull\(departamento", plan)
    assert "ReadSchema: struct<fecha:timestamp,url:string>" in plan


def test_keep_first_is_cut_before_the_shuffle(spark, sf_small):
    order = [*dedup.recent_first(), F.col("doc_id")]
    plan = plan_of(dedup.dedup_keep_first(views.articles(spark, sf_small), order))
    assert re.search(r"row_number\(\), 1, Partial", plan)
    assert exchanges(plan) == 1


def test_listing_cap_counts_before_the_shuffle(spark, sf_small):
    plan = plan_of(listing.cap_per_group(views.listing(spark, sf_small), 2000))
    # rows are counted in the map tasks; only those of one block of a page are ordered
    assert "partial_count" in plan and "Partial" not in plan.replace("partial_count", "")
    assert len(re.findall(r"row_number\(\)", plan)) >= 1


def test_merge_takes_one_shuffle(spark, sf_small):
    order = [*dedup.recent_first(), F.col("doc_id")]
    plan = plan_of(dedup.merge_by_url(views.articles(spark, sf_small), order))
    assert exchanges(plan) == 1
    assert "partial_min_by" in plan


def test_listing_cut_sorts_nothing(spark, sf_small):
    plan = plan_of(listing.cut_at_first_older(views.listing(spark, sf_small), views.LIST_LO))
    assert "Window" not in plan
    assert "SortAggregate" not in plan


def test_candidates_are_never_shuffled_before_they_are_filtered(spark, sf_small):
    built = corpus.department_corpus(
        views.articles(spark, sf_small).drop("departamento", "tema", "tema_pos"),
        views.plan(spark), tie=["doc_id"],
    )
    plan = plan_of(built)
    assert "SortMergeJoin [fuente" not in plan
    # No aggregation and no grouping holds a text.
    grouped = [line for line in plan.splitlines() if "Aggregate(" in line or "Window" in line]
    assert grouped and not any("texto" in line for line in grouped)


def text_exchanges(plan):
    """Exchanges below which a text column is read or handed on, by their own output."""
    return [line for line in plan.splitlines() if "Exchange" in line and "texto" in line]


def test_stored_corpus_moves_texts_once(spark, sf_small):
    stored, winners = corpus._department_winners(
        views.articles(spark, sf_small).drop("departamento", "tema", "tema_pos"), views.plan(spark),
        views.LO, views.HI, 50, True, ["doc_id"], shared_table,
    )
    dealt = corpus._picked_by_file(stored, shared_table(winners, "winners"), "departamento")
    plan = dealt._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    # the arguments of an exchange name its input columns
    moved = [part for part in plan.split("\n\n") if re.search(r"\) Exchange\n", part) and "texto" in part]
    assert len(moved) == 1 and "REPARTITION_BY_NUM" in moved[0]
    picked = corpus._picked(stored, winners, "departamento")
    assert sorted(map(str, dealt.select("url", "texto", "terminos_encontrado").collect())) == sorted(
        map(str, picked.select("url", "texto", "terminos_encontrado").collect())
    )


@pytest.mark.parametrize("hot", ["'hot'", "NULL"])
def test_hot_url_in_the_corpus(spark, hot):
    """A third of all rows under one URL, or under none: one winner and all terms."""
    plan = views.plan(spark)
    terms = [r.termino for r in plan.filter("fuente = 'src0'").select("termino").distinct().limit(2).collect()]
    rows = spark.range(30_000).selectExpr(
        "'src0' AS fuente", f"IF(id % 2 = 0, '{terms[0]}', '{terms[1]}') AS termino", "'p' AS periodico",
        "'The title' AS titulo", f"IF(id % 3 = 0, {hot}, concat('u', id % 500)) AS url",
        "timestamp_seconds(1680000000 + id) AS fecha", "'The the the the text' AS texto", "id AS doc_id",
    )
    for salts in (1, 16):
        index = corpus._index(corpus.match_plan(rows, plan).withColumn("_fila", F.monotonically_increasing_id()), "departamento", ["doc_id"])
        won = corpus._winners(index, "departamento", ["doc_id"], salts)
        matched = index.groupBy("departamento", "url").agg(F.count("*").alias("n")).collect()
        assert won.count() == len(matched) and max(r.n for r in matched) == 10_000
        firsts = {r._fila for r in won.collect()}
        if salts == 1:
            kept = firsts
    assert firsts == kept


def test_pages_are_parsed_before_the_join(spark, sf_small):
    pages = views.read(spark, sf_small, "pages")
    links = pages.select(
        F.lit("p").alias("periodico"), F.lit("t").alias("termino"), F.col("page_id").cast("int").alias("page"),
        F.lit(0).alias("pos"), F.col("url").alias("link"), F.lit(None).cast("timestamp").alias("fecha"),
    )
    plan = plan_of(listing_jobs.candidates_from_pages(links, links, pages))
    joined = plan[: plan.index("FileScan")]
    assert not re.search(r"Exchange[^\n]*html", joined)


def test_large_sides_are_not_broadcast(spark, sf_small):
    big = spark.range(10**9).withColumnRenamed("id", "n")
    assert broadcast_if_small(big) is big
    small = dimensions.sources_table(spark)
    assert broadcast_if_small(small) is not small


@pytest.mark.parametrize("n", [0, 100, 200_000])
def test_pin_stores_a_plan_of_any_size(spark, n):
    fixed = pin(spark.range(n).withColumn("r", F.rand()))
    assert "Scan parquet" in plan_of(fixed) and fixed.count() == n
    assert fixed.exceptAll(fixed).isEmpty()


def test_shared_table_uses_the_cluster_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder.rstrip("/")
    kept = shared_table(spark.range(5), "t")
    assert folder in kept.inputFiles()[0]
    assert kept.count() == 5


def test_settled_run_scans_candidates_once(spark, sf_small):
    built = corpus.department_corpus(
        views.articles(spark, sf_small).drop("departamento", "tema", "tema_pos"),
        views.plan(spark), views.LO, views.HI, tie=["doc_id"], settle=shared_table,
    )
    assert "documents.parquet" not in plan_of(built)
    direct = corpora.department_corpus(spark, sf_small)
    assert sorted(map(str, built.select("url", "titulo").collect())) == sorted(
        map(str, direct.select("url", "titulo").collect())
    )


def test_hot_url_gives_the_same_result_with_salt(spark):
    rows = spark.range(20000).select(
        F.when(F.col("id") % 3 != 0, "hot").otherwise(F.col("id").cast("string")).alias("url"),
        F.col("id").alias("n"),
    ).repartition(16)
    plain = dedup.first_per_group(rows, ["url"], [F.col("n")], n=5)
    salted = dedup.first_per_group(rows, ["url"], [F.col("n")], n=5, salts=8)
    assert sorted(plain.collect()) == sorted(salted.collect())
    assert plain.filter("url = 'hot'").count() == 5


def test_hot_url_merges_the_same_with_salt(spark):
    rows = spark.range(20000).select(
        F.when(F.col("id") % 3 != 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("url"),
        F.col("id").alias("n"), F.concat(F.lit("t"), F.col("id") % 7).alias("tema"),
    ).repartition(16, "n")
    plain = dedup.merge_by_url(rows, [-F.col("n")])
    salted = dedup.merge_by_url(rows, [-F.col("n")], salts=8)
    assert sorted(plain.collect()) == sorted(salted.collect())
