"""Every registered query of the core against its SQL in another engine, over the smallest test tables."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from querymill import queries as Q
from querymill.functions import text
from querymill.operators import catalog as catalogs
from querymill.operators import pairs, retrieval, stats

SF = Path("/root/testdata/sf0.001")


def shown(v):
    return "nan" if isinstance(v, float) and v != v else repr(round(v, 8) + 0.0) if isinstance(v, float) else repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, str(SF))
    got = [tuple(r) for r in df.collect()]
    assert df.columns
    if name not in Q.SQL:
        return
    rel = duck.execute(Q.SQL[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    order = lambda cols, rows: sorted(tuple(shown(r[cols.index(c)]) for c in sorted(cols)) for r in rows)
    assert order(df.columns, got) == order(columns, rel.fetchall())


def test_mcnemar():
    assert stats.mcnemar_exact(0, 0) == 1.0 and stats.mcnemar_exact(5, 5) == 1.0
    assert stats.mcnemar_exact(1, 9) == pytest.approx(0.021484375) and stats.mcnemar_p(0) == 1.0
    assert stats.mcnemar_exact(4000, 4100) == pytest.approx(0.2713, abs=0.003)
    low, high = stats.bootstrap(1000, 120, 80)
    assert low < 0.04 < high and stats.bootstrap(0, 0, 0) == (0.0, 0.0)
    assert stats.bootstrap(1000, 120, 80) == (low, high)


def test_equal_discordant_counts_are_not_nothing(spark):
    rows = [(i, i < 4, i >= 4) for i in range(8)]
    one = stats.discordant(spark.createDataFrame(rows, "idx int, a boolean, b boolean")).first()
    assert (one.only_a, one.only_b, one.chi2) == (4, 4, 0.125)


def test_exact_p_of_many():
    import time

    began = time.perf_counter()
    assert 0 < stats.mcnemar_exact(10**9, 10**9 + 10**5) < 0.03 and stats.mcnemar_exact(10**9, 10**9) == pytest.approx(1.0)
    assert time.perf_counter() - began < 10


def test_matrix(spark):
    rows = [(i, s, (i * k) % 3 == 0) for i in range(30) for k, s in enumerate("xyz", 1) if not (s == "z" and i < 10)]
    got = {(r.a, r.b): r for r in stats.matrix_report(spark.createDataFrame(rows, "idx int, system string, correct boolean"), [("x", "y"), ("x", "z")], 50).collect()}
    assert got["x", "y"].n == 30 and got["x", "z"].n == 20 and got["x", "z"].only_b == sum(i % 3 != 0 for i in range(10, 30)) and got["x", "y"].p_exact == 1.0


def test_no_pairs(spark):
    empty = spark.createDataFrame([], "idx int, a boolean, b boolean")
    assert stats.paired_report(empty).first().p_exact == 1.0


def test_folds(spark):
    items = spark.createDataFrame([(i, d) for i, d in enumerate(["A"] * 5 + ["b "] * 4 + ["c"] * 3 + ["d"] * 3 + ["a"] * 2) ] + [(99, None)], "idx int, db_id string")
    got = {r.db_id: (r["rows"], r.fold) for r in pairs.database_folds(items, 2).collect()}
    assert got == {"a": (7, 0), "b": (4, 1), "c": (3, 1), "d": (3, 0), "unknown": (1, 1)}


@pytest.mark.parametrize("block", [2, 4096])
def test_dense_search(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "BLOCK", block)
    monkeypatch.setattr(retrieval, "CHUNK", 5)
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(60, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, vecs[i].tolist(), i % 3) for i in range(60)] + [(60, None, 1)], "vec_id long, embedding array<float>, label int").repartition(5)
    got = retrieval.dense_search(df, df.filter("vec_id < 5"), 4).collect()
    for q in range(5):
        s = np.round(vecs.astype(float) @ vecs[q].astype(float), 6)
        s[q] = -np.inf
        assert [r.doc for r in sorted((r for r in got if r.query == q), key=lambda r: r.place)] == sorted(range(60), key=lambda i: (-s[i], i))[:4]
    assert retrieval.dense_search(df, df.filter("vec_id < 0"), 4).count() == 0
    own = retrieval.dense_search(df, df.filter("vec_id < 5"), 30, group="label").collect()
    assert all(r.doc % 3 == r.query % 3 for r in own) and len(own) == 5 * 19


def test_bm25(spark):
    import math

    docs = [(1, "red boxes and blue boxes"), (2, "blue sky"), (3, ""), (4, None)]
    index = retrieval.build_index(spark.createDataFrame(docs, "d int, t string"), "d", "t")
    assert index.n == 4 and index.average == pytest.approx(6 / 4)
    got = {(r.query, r.doc): r.score for r in retrieval.bm25(index, spark.createDataFrame([(9, "box box sky")], "q int, t string"), "q", "t").collect()}
    idf = math.log(1 + (4 - 1 + 0.5) / 1.5)
    score = lambda tf, dl: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 1.5))
    assert got == {(9, 1): pytest.approx(2 * score(2, 4), abs=1e-5), (9, 2): pytest.approx(score(1, 2), abs=1e-5)}


def test_dense_ties(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(40)], "vec_id long, embedding array<float>").repartition(3)
    assert sorted(r.doc for r in retrieval.dense_search(df, df.filter("vec_id = 7"), 5).collect()) == [0, 1, 2, 3, 4]


def test_contexts(spark):
    docs = spark.createDataFrame([("d::table::bird", "d", "table", "Database: d\nTable: bird\nColumns: wing", ["bird"]), ("d::col::bird.wing", "d", "column", "Database: d\nColumn: bird.wing\nType: text", ["bird"]),
                                  ("d::fk::0", "d", "fk", "ForeignKey: nest.bird -> bird.id wing", ["nest", "bird"]), ("d::fk::1", "d", "fk", "ForeignKey: a.b -> c.wing", ["a", "c"]),
                                  ("e::table::bird", "e", "table", "Table: bird", ["bird"])], "doc_id string, db_id string, type string, text string, tables array<string>")
    items = spark.createDataFrame([(1, "D ", "Which wing has the bird?", "SELECT 1"), (2, "e", "bird", "SELECT 2;"), (3, "e", "nothing", None)], "idx int, db_id string, question string, gold string")
    context = retrieval.schema_context(docs, items)
    assert sorted((r.query, r.doc) for r in context.collect()) == [(1, "d::col::bird.wing"), (1, "d::fk::0"), (1, "d::table::bird"), (2, "e::table::bird")]
    texts = retrieval.context_text(context, docs)
    text = {r["query"]: r.text for r in texts.collect()}
    assert text[2] == "=== TABLES (Top) ===\nTable: bird\n=== COLUMNS (Top) ===\n(EMPTY)\n=== FOREIGN KEYS / JOIN HINTS ===\n(EMPTY)\n" and "c.wing" not in text[1]
    cache = {r.idx: r for r in retrieval.prompt_cache(texts, items).collect()}
    assert "Allowed tables:\nbird\nAllowed columns:\nbird.wing\n" in cache[1].input_text and cache[1].target_text == "SELECT 1;" and cache[2].target_text == "SELECT 2;" and "Allowed columns:\n(none)" in cache[2].input_text
    assert set(cache) == {1, 2}


def test_tables_that_no_word_names(spark):
    catalog = spark.createDataFrame([("D", ["x", "a", "b"], [(-1, "*"), (0, "p"), (1, "q"), (2, "r")], ["text"] * 4, [], [])],
                                    "db_id string, table_names_original array<string>, column_names_original array<struct<tbl: int, name: string>>, column_types array<string>, primary_keys array<int>, foreign_keys array<array<int>>")
    items = spark.createDataFrame([(1, "d", "zzz"), (2, "d", "show b")], "idx int, db_id string, question string")
    got = sorted((r.idx, r.place, r.table, r.score) for r in catalogs.relevant_tables(items, catalog).collect())
    assert got == [(1, 1, "x", 0), (1, 2, "a", 0), (2, 1, "x", 0), (2, 2, "a", 0)]  # words have two letters or more


def test_statements_with_a_field_list_inside(spark):
    rows = [("with c as (select a from t) select b from c",), ("select 1",), ("select a, count(*) from t group by a having count(*) > 1 order by a",)]
    df = spark.createDataFrame(rows, "s string")
    assert [(r.f, r.g) for r in df.select(text.field_list(F.col("s")).alias("f"), text.group_fields(F.col("s")).alias("g")).collect()] == [("a", ""), ("", ""), ("a, count(*)", "a")]


def test_values_in_questions(spark):
    df = spark.createDataFrame([("List cars heavier than 300 from France",), ("Who is old",), ("less than 5 and more than 7",), (None,)], "q string")
    got = [(r.f, r.i, r.c and (r.c.op, r.c.value)) for r in df.select(text.value_after(F.col("q"), "from").alias("f"), text.value_after(F.col("q"), "is").alias("i"), text.compared(F.col("q")).alias("c")).collect()]
    assert got == [("France", None, (">", 300)), (None, None, None), (None, None, (">", 7)), (None, None, None)]
