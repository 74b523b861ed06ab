"""The store of seen keys: plans, repeated batches, late copies, hot and null keys."""

import pytest
from pyspark.sql import functions as F

from noticiario import schema
from noticiario.operators import joins
from noticiario.session import shared_path
from noticiario.sources import readers
from noticiario.sources.keys import KeyStore
from noticiario.streaming import arrivals


@pytest.fixture
def store(spark):
    return KeyStore(spark, shared_path(spark, "keys"), buckets=16)


def listing(spark, lo, hi):
    return spark.range(lo, hi).selectExpr("concat('l', id) AS link", "id AS n", "'x' AS _h", "repeat('t', 50) AS texto")


def test_history_is_not_shuffled(spark, store):
    store.add(listing(spark, 0, 1000), "link", batch=0)
    store.add(listing(spark, 500, 2000), "link", batch=1)
    new = joins.new_links(listing(spark, 1900, 2100), store)
    assert new.columns == ["link", "n", "_h", "texto"]
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    history = plan[: plan.rindex("FileScan")].splitlines()[-4:]
    assert not any("Exchange" in line for line in history)
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted(r.n for r in new.collect()) == list(range(2000, 2100))


def test_repeated_batches_and_restarts(spark, store):
    for _ in range(2):
        store.add(listing(spark, 0, 100), "link", batch=0)
    store.add(listing(spark, 100, 150), "link", batch=1)
    store.add(listing(spark, 100, 120), "link", batch=1)  # another try, with fewer rows
    assert store.seen().count() == 120
    # the batch itself is not compared with its first try
    assert store.unseen(listing(spark, 100, 150), "link", before=1).count() == 50
    again = KeyStore(spark, store.path, 16)
    spark.sql(f"DROP TABLE {store.name}")  # as in a new session; the files stay
    assert again.seen().count() == 120


def test_keys_of_several_columns_and_null(spark, store):
    rows = spark.createDataFrame([(None, "b"), ("", "b"), ("a", None), ("ab", ""), ("a", "b")], "x string, y string")
    store.add(rows.limit(1), "x", "y", batch=0)
    left = {(r.x, r.y) for r in store.unseen(rows, "x", "y").collect()}
    assert left == {("", "b"), ("a", None), ("ab", ""), ("a", "b")}


def article(n, url, day=1):
    return ("p", f"t{n}", None, "texto", url, "paz", "Meta")


def batch_of(spark, rows):
    df = spark.createDataFrame(rows, schema.CORPUS)
    return df.withColumn("llegada", F.current_timestamp())


def kept(spark, root):
    rows = readers.read_corpus(spark, root, row_type=schema.CORPUS)
    return sorted((r.titulo, r.url) for r in rows.collect())


def test_a_late_copy_and_a_repeated_batch_add_no_row(spark, store):
    root = shared_path(spark, "stream")
    first = batch_of(spark, [article(1, "u1"), article(2, "u1"), article(3, None), article(4, None)])
    second = batch_of(spark, [article(5, "u1"), article(6, None), article(7, "u2")])
    order = [F.col("titulo")]
    for batch, number in [(first, 0), (first, 0), (second, 1), (second, 1), (second, 7)]:
        arrivals.first_seen_batch(batch, number, root, store, order=order)
    assert kept(spark, root) == [("t1", "u1"), ("t3", None), ("t7", "u2")]


def test_a_batch_that_failed_between_its_rows_and_its_keys(spark, store, monkeypatch):
    root = shared_path(spark, "stream")
    batch = batch_of(spark, [article(1, "u1"), article(2, "u2")])
    with monkeypatch.context() as m:
        m.setattr(KeyStore, "add", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            arrivals.first_seen_batch(batch, 0, root, store)
    arrivals.first_seen_batch(batch, 0, root, store)
    assert [u for _, u in kept(spark, root)] == ["u1", "u2"]
    assert store.seen().count() == 2


@pytest.mark.parametrize("hot", ["'hot'", "NULL"])
def test_a_hot_key_in_a_batch(spark, store, hot):
    root = shared_path(spark, "stream")
    rows = spark.range(20_000).selectExpr(
        "'p' AS periodico", "lpad(id, 6, '0') AS titulo", "CAST(NULL AS TIMESTAMP) AS fecha", "'x' AS texto",
        f"IF(id % 3 = 0, {hot}, concat('u', id)) AS url", "'paz' AS terminos_encontrado", "'Meta' AS departamento",
        "current_timestamp() AS llegada",
    ).repartition(8)
    arrivals.first_seen_batch(rows, 0, root, store, order=[F.col("titulo")])
    found = kept(spark, root)
    assert len(found) == 20_000 - 6667 + 1 and found[0][0] == "000000"
    arrivals.first_seen_batch(rows, 1, root, store)
    assert len(kept(spark, root)) == len(found)
