import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from querymill import runtime
from querymill.plans import repair as RP
from querymill.plans import validate as V
from querymill.plans.engine import Engine
from querymill.sources import files, sqlite


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1, "b": "ü"}\n{"a": broken\n{"a": 3}\n')
    assert [r.a for r in files.read_jsonl(spark, str(p), "a int, b string", "drop").collect()] == [1, 3]
    with pytest.raises(Exception):  # noqa: B017, PT011
        files.read_jsonl(spark, str(p), "a int, b string").collect()
    assert files.read_jsonl(spark, str(tmp_path / "none"), "a int", "lenient").count() == 0
    tagged = files.read_jsonl(spark, [str(p)], "a int", "drop", tag_files=True).first()
    assert tagged.file.endswith("a.jsonl")
    files.write_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert json.loads("".join(f.read_text() for f in (tmp_path / "out").glob("*.json"))) == {"a": 1, "b": None}


def test_catalog_file(spark, tmp_path):
    p = tmp_path / "tables.json"
    p.write_text(json.dumps([{"db_id": "d", "table_names_original": ["t"], "column_names_original": [[-1, "*"], [0, "id"], [0, "k"]], "column_types": ["text", "number"], "primary_keys": [1, [1, 2]], "foreign_keys": []}], indent=1))
    row = files.read_catalog_json(spark, str(p)).first()
    assert [(c.tbl, c.name) for c in row.column_names_original] == [(-1, "*"), (0, "id"), (0, "k")] and row.primary_keys == [1, 1, 2]


def test_append_and_latest(spark, tmp_path):
    path = str(tmp_path / "log")
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k int, v string")
    files.append_missing(a, path, ["k"])
    files.append_missing(a.union(spark.createDataFrame([(3, "z")], "k int, v string")), path, ["k"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    log = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "only")], "k string, at int, v string")
    assert {r.k: r.v for r in files.latest(log, ["k"], "at").collect()} == {"a": "new", "b": "only"}


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.12345), ("b", None)], "name string, rate double")
    text = files.markdown([("Rates", df)])
    assert "| a | 0.123 |" in text and "| b | N/A |" in text
    (tmp_path / "r.md").write_text(text)
    assert [r.cells for r in files.read_markdown_table(spark, str(tmp_path / "r.md")).collect()][1:] == [["a", "0.123"], ["b", "N/A"]]
    files.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["name", "rate"]
    files.write_folds(df.withColumns({"fold": F.lit(1), "split": F.lit("dev")}), str(tmp_path / "folds"))
    assert (tmp_path / "folds/rows/fold=1/split=dev").exists() and spark.read.json(str(tmp_path / "folds/metadata")).first()["rows"] == 2
    files.write_report(df.limit(1), df, str(tmp_path / "report"))
    metrics, details = files.read_report(spark, str(tmp_path / "report"), "name STRING, rate DOUBLE", "name STRING, rate DOUBLE")
    assert metrics.count() == 1 and details.count() == 2


def test_head_and_samples(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text("".join(f'{{"question": "q{i}", "tokens": ["a"]}}\n' for i in range(50)))
    head = files.read_jsonl_head(spark, str(tmp_path / "h.jsonl"), "question STRING, query STRING, db_id STRING, tokens ARRAY<STRING>", 3)
    assert [r.question for r in head.collect()] == ["q0", "q1", "q2"]
    assert tuple(files.samples(head).first()) == ("q0", "", "", ["a"])
    assert files.samples(head.drop("tokens")).first().tokens == []


def test_only_a_missing_table_is_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/part.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        files.append_missing(df, str(tmp_path / "bad"), ["k"])


def test_json_arrays(spark, tmp_path):
    df = spark.createDataFrame([(f"d{i}", i) for i in range(20)], "db_id string, n int")
    files.write_json_arrays(df, str(tmp_path / "arrays"), "db_id", 3)
    assert sorted(map(tuple, files.read_json_array(spark, f"{tmp_path}/arrays/part=*", "db_id STRING, n INT").collect())) == sorted((f"d{i}", i) for i in range(20))


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.sqlite")
    with sqlite3.connect(path) as con:
        con.execute('CREATE TABLE "odd name" (id INTEGER, label TEXT, size REAL)')
        con.executemany('INSERT INTO "odd name" VALUES (?, ?, ?)', [(i, f"l{i}", i / 2) for i in range(100)])
        con.execute('INSERT INTO "odd name" VALUES (NULL, CAST(X\'FF41\' AS TEXT), \'\')')
        con.execute("CREATE TABLE empty (a TEXT)")
        con.execute("CREATE TABLE keyed (k INTEGER PRIMARY KEY, v INTEGER) WITHOUT ROWID")
        con.executemany("INSERT INTO keyed VALUES (?, ?)", [(1, 2**60 + 1), (2, "x"), (3, 1.5)])
    assert sqlite.list_tables(path) == ["empty", "keyed", "odd name"]
    sqlite.load_database(spark, path, "s_")
    df = spark.table("`s_odd name`")
    assert dict(df.dtypes) == {"id": "bigint", "label": "string", "size": "double"} and df.count() == 101 and df.rdd.getNumPartitions() > 1
    bad = df.filter("id IS NULL").first()
    assert bad["size"] is None and bad.label.endswith("A") and spark.table("s_empty").count() == 0
    assert sorted(map(tuple, spark.table("s_keyed").collect())) == [(1, 2**60 + 1), (2, None), (3, None)]


@pytest.fixture(scope="module")
def engine(spark):
    t = spark.createDataFrame([(1, "a", 10.0, "7"), (2, "b", 20.0, "x"), (3, "a", 30.0, "9")], "book_id int, shelf string, price double, code string")
    return Engine(spark, {"book": t})


def test_execute(spark, engine):
    ok = V.execute(spark, "SELECT shelf, COUNT(*) FROM book GROUP BY shelf;")
    assert ok.ok and ok.n_rows == 2 and ok.key == V.execute(spark, "SELECT shelf, COUNT(*) FROM book GROUP BY shelf ORDER BY 2").key
    assert ok.key != V.execute(spark, "SELECT COUNT(*), shelf FROM book GROUP BY shelf").key
    assert V.execute(spark, "SELECT 1 WHERE FALSE").key == "[]"
    for bad in (None, "", "DROP TABLE book", "SELECT 1; DROP TABLE book", "INSERT INTO book VALUES (1)"):
        assert V.execute(spark, bad).error == "empty_or_invalid_sql"
    assert V.execute(spark, "SELECT ';' FROM book").ok
    assert V.execute(spark, "SELECT nothing FROM book").condition.startswith("UNRESOLVED_COLUMN")
    assert V.execute(spark, "SELECT 1/(book_id-1) FROM book").condition.startswith("DIVIDE_BY_ZERO")
    assert not V.execute(spark, "SELECT SUM(a.id * b.id * c.id) FROM range(1000000) a, range(1000000) b, range(1000) c", timeout_s=1).ok


@pytest.mark.parametrize("sql", ["SELECT [shelf] FROM [book]", "SELECT shelf FROM books", "SELECT shelv FROM book", "SELECT shelf, COUNT(*) FROM book", "SELECT shelf FROM book LIMIT 1, 1",
                                 "SELECT shelf, price, COUNT(*) FROM book GROUP BY shelf", "SELECT AVG(code) FROM book", "SELECT SUM(price / (book_id - 1)) FROM book"])
def test_repair(spark, engine, sql):
    form, outcome, attempts = RP.repair(spark, sql, engine.tables)
    if "book_id - 1" in sql:
        assert not attempts[0][1].ok
    else:
        assert outcome.ok and form != sql and not attempts[0][1].ok


def test_run(spark, engine):
    chosen, traces = engine.run("How many books per shelf?", [("embedrag", "SELECT shelf, COUNT(*) FROM book WHERE price < 0 GROUP BY shelf"), ("bm25rag", "SELECT shelf, COUNT(*) FROM books GROUP BY shelf"),
                                                              ("promptonly", "SELECT shelf, COUNT(book_id) FROM book GROUP BY shelf")])
    assert chosen.source == "bm25rag" and chosen.repaired and len(traces) == 3
    assert sorted(tuple(r) for r in engine.execute(chosen.sql).collect()) == [("a", 2), ("b", 1)]
    made, _ = engine.run("How many books are there per shelf?")
    assert made.outcome.ok and "COUNT(*)" in made.sql
    assert engine.schema().count() == 4 and engine.databases() == ["book"]
    with pytest.raises(ValueError):
        engine.execute("DELETE FROM book")
    flags = {r.profile: (r.ok, r.same) for r in engine.portability('SELECT "shelf" FROM book').collect()}
    assert flags["ansi"] == (True, True) and flags["quoted_names"] == (True, False)


def test_labels(spark, engine):
    out = V.validate(spark, [(1, 0, "a", "SELECT 1"), (1, 1, "b", "SELECT 2"), (2, 0, "a", "bad")])
    gold = V.validate(spark, [(1, 0, "gold", "SELECT 1"), (2, 0, "gold", "bad")])
    assert sorted((r.idx, r.candidate_index, r.correct) for r in V.labelled(out, gold).collect()) == [(1, 0, True), (1, 1, False), (2, 0, False)]


def test_no_shared_folder_is_an_error(monkeypatch):
    class Context:
        master = "spark://host:7077"

        class getConf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

    class Session:
        sparkContext = Context()  # noqa: N815

    with pytest.raises(RuntimeError):
        runtime.shared_folder(Session())
