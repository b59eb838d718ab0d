"""The schema catalog as flat tables, schema chunks, links between statements and schema, foreign-key graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identifier_words, normal_question, plural_forms

MAX_COLUMNS, MAX_KEYS = 80, 60


def tables(catalog: DataFrame) -> DataFrame:
    return catalog.select("db_id", F.posexplode("table_names_original").alias("tbl", "table"))


def columns(catalog: DataFrame) -> DataFrame:
    """(db_id, tbl, table, col, column, type, is_key); missing types are 'unknown', the pseudo column is left out."""
    cols = catalog.select("db_id", "table_names_original", "column_types", "primary_keys", F.posexplode("column_names_original").alias("col", "c")).filter("c.tbl >= 0")
    return cols.select(
        "db_id", F.col("c.tbl").alias("tbl"), F.get("table_names_original", F.col("c.tbl")).alias("table"), "col", F.col("c.name").alias("column"),
        F.coalesce(F.get("column_types", F.col("col")), F.lit("unknown")).alias("type"), F.coalesce(F.array_contains("primary_keys", F.col("col")), F.lit(False)).alias("is_key"))


def foreign_keys(catalog: DataFrame) -> DataFrame:
    """(db_id, pos, table, column, to_table, to_column)."""
    keys = catalog.select("db_id", "table_names_original", "column_names_original", F.posexplode("foreign_keys").alias("pos", "fk")).filter("size(fk) >= 2")
    at = lambda k: F.get("column_names_original", F.get("fk", F.lit(k)))
    ends = keys.select("db_id", "pos", "table_names_original", at(0).alias("a"), at(1).alias("b")).filter("a.tbl >= 0 AND b.tbl >= 0")
    return ends.select("db_id", "pos", F.get("table_names_original", F.col("a.tbl")).alias("table"), F.col("a.name").alias("column"),
                       F.get("table_names_original", F.col("b.tbl")).alias("to_table"), F.col("b.name").alias("to_column"))


def _listed(cols: DataFrame, shown: Column, limit: int | None = None) -> Column:
    """A table's columns as an array of texts in catalog order; a table has a bounded number of columns."""
    packed = F.array_sort(F.collect_list(F.when(F.col("col").isNotNull(), F.struct("col", shown.alias("shown")))))
    return F.transform(packed if limit is None else F.slice(packed, 1, limit), lambda x: x["shown"])


def _with_columns(catalog: DataFrame) -> DataFrame:
    """Every table beside its columns, and once without any where it has none."""
    return tables(catalog).join(columns(catalog).drop("table"), ["db_id", "tbl"], "left")


def schema_docs(catalog: DataFrame) -> DataFrame:
    """(doc_id, db_id, type, text, tables): one chunk per table, column and foreign key, with the tables it is about."""
    flag = F.when(F.col("is_key"), F.lit(" [PK]")).otherwise("")
    cols = _with_columns(catalog)
    listed = cols.groupBy("db_id", "tbl", "table").agg(F.array_join(_listed(cols, F.concat(F.col("column"), F.lit(":"), F.col("type"), flag)), ", ").alias("cols"))
    text = lambda *parts: F.concat_ws("\n", F.concat(F.lit("Database: "), F.col("db_id")), *parts)
    line = lambda name, *c: F.concat(F.lit(name + ": "), *c)
    t = listed.select(F.concat_ws("::", "db_id", F.lit("table"), "table").alias("doc_id"), "db_id", F.lit("table").alias("type"),
                      text(line("Table", F.col("table")), line("Columns", F.col("cols"))).alias("text"), F.array("table").alias("tables"))
    dotted = F.concat_ws(".", "table", "column")
    c = columns(catalog).select(F.concat_ws("::", "db_id", F.lit("col"), dotted).alias("doc_id"), "db_id", F.lit("column").alias("type"),
                                text(line("Column", dotted), line("Type", F.col("type"), flag)).alias("text"), F.array("table").alias("tables"))
    to = F.concat_ws(".", "to_table", "to_column")
    hint = F.concat(F.col("table"), F.lit(" JOIN "), F.col("to_table"), F.lit(" ON "), dotted, F.lit(" = "), to)
    f = foreign_keys(catalog).select(F.concat_ws("::", "db_id", F.lit("fk"), F.col("pos").cast("string")).alias("doc_id"), "db_id", F.lit("fk").alias("type"),
                                     text(line("ForeignKey", dotted, F.lit(" -> "), to), line("JoinHint", hint)).alias("text"), F.array("table", "to_table").alias("tables"))
    return t.unionByName(c).unionByName(f)


def doc_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("type").agg(F.count("*").alias("docs"), F.count_distinct("db_id").alias("databases"))


def schema_text(catalog: DataFrame) -> DataFrame:
    """(db_id, text): a database's tables with their first MAX_COLUMNS columns, then its first MAX_KEYS keys."""
    cols = _with_columns(catalog)
    shown = F.concat(F.col("column"), F.lit(" "), F.col("type"), F.when(F.col("is_key"), F.lit(" primary_key")).otherwise(""))
    packed = cols.groupBy("db_id", "tbl", "table").agg(_listed(cols, shown, MAX_COLUMNS).alias("cols"))
    line = F.when(F.size("cols") > 0, F.concat(F.lit("Table "), "table", F.lit(": "), F.array_join("cols", "; "), F.lit("."))).otherwise(F.concat(F.lit("Table "), "table", F.lit(".")))
    lines = packed.groupBy("db_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tbl", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    pair = F.concat(F.concat_ws(".", "table", "column"), F.lit(" -> "), F.concat_ws(".", "to_table", "to_column"))
    keys = foreign_keys(catalog).filter(F.col("pos") < MAX_KEYS).groupBy("db_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", pair.alias("pair")))), lambda x: x["pair"]).alias("keys"))
    end = F.when(F.col("keys").isNotNull(), F.concat(F.lit("Foreign keys: "), F.array_join("keys", "; "), F.lit(".")))
    head = F.concat(F.lit("Database "), F.col("db_id"), F.lit("."))
    return lines.join(keys, "db_id", "left").select("db_id", F.concat_ws("\n", head, F.array_join("lines", "\n"), end).alias("text"))


def schema_links(pool: DataFrame, catalog: DataFrame) -> DataFrame:
    """(pool_id, n_tables, n_columns): tables of its database that a statement names, and columns, by name or with their table before.

    Columns of one name in several tables count each, as a bare name may mean any. The catalog has one row per
    database and is joined by a shuffle unless Spark finds it small.
    """
    db = F.lower(F.trim("db_id")).alias("db")
    qualified = F.transform(F.filter("column_names_original", lambda c: c["tbl"] >= 0), lambda c: F.struct(
        F.lower(c["name"]).alias("name"), F.lower(F.concat_ws(".", F.get("table_names_original", c["tbl"]), c["name"])).alias("qualified")))
    names = catalog.select(db, F.transform("table_names_original", F.lower).alias("tables"), qualified.alias("cols"))
    low = F.lower(F.coalesce("sql", F.lit("")))
    words = F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z_][a-z0-9_]*"), F.lit(0)))
    used = pool.select("pool_id", db, low.alias("low"), words.alias("words"))
    hit = lambda c: F.array_contains("words", c["name"]) | F.contains("low", c["qualified"])
    return used.join(names, "db").select(
        "pool_id", F.size(F.filter("tables", lambda t: F.array_contains("words", t))).alias("n_tables"), F.size(F.filter("cols", hit)).alias("n_columns"))


def relevant_tables(items: DataFrame, catalog: DataFrame, top: int = 3) -> DataFrame:
    """(idx, table, score, place): tables by 3 for every word of the name, 2 for every column word, 1 for every column met.

    Tables without a score are left out, but where none has one the database's first two stand in, in catalog
    order. A database's few tables are ranked inside the row.
    """
    cols = columns(catalog).groupBy("db_id", "tbl", "table").agg(F.array_sort(F.collect_list("column")).alias("cols"))
    words = F.array_distinct(F.flatten(F.transform("cols", identifier_words)))
    described = cols.select(F.lower(F.trim("db_id")).alias("db"), F.struct(F.col("tbl"), F.col("table"), F.array_distinct(identifier_words(F.col("table"))).alias("tw"), words.alias("cw"),
                                                                 F.transform("cols", identifier_words).alias("each")).alias("t"))
    per_db = described.groupBy("db").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    asked = items.filter("question IS NOT NULL AND db_id IS NOT NULL").select(
        "idx", F.lower(F.trim("db_id")).alias("db"), plural_forms(F.array_distinct(identifier_words(F.col("question")))).alias("q"))
    score = lambda t: (3 * F.size(F.array_intersect("q", t["tw"])) + 2 * F.size(F.array_intersect("q", t["cw"]))
                       + F.size(F.filter(t["each"], lambda w: F.size(F.array_intersect("q", w)) > 0)))
    ranked = F.array_sort(F.filter(F.transform("ts", lambda t: F.struct((-score(t)).alias("s"), t["table"].alias("table"))), lambda x: x["s"] < 0))
    instead = F.transform(F.slice("ts", 1, min(2, top)), lambda t: F.struct(F.lit(0).alias("s"), t["table"].alias("table")))
    shown = asked.join(per_db, "db").withColumn("ranked", ranked).select("idx", F.when(F.size("ranked") > 0, F.slice("ranked", 1, top)).otherwise(instead).alias("shown"))
    return shown.select("idx", F.posexplode("shown").alias("p", "x")).select(
        "idx", F.col("x.table").alias("table"), (-F.col("x.s")).alias("score"), (F.col("p") + 1).alias("place"))


def bridges(chosen: DataFrame, catalog: DataFrame) -> DataFrame:
    """(idx, table, links): tables not chosen that a key connects to chosen ones."""
    fk = foreign_keys(catalog).select(F.lower(F.trim("db_id")).alias("db"), "table", "to_table")
    edges = fk.select("db", F.col("table").alias("a"), F.col("to_table").alias("b")).union(fk.select("db", F.col("to_table").alias("a"), F.col("table").alias("b")))
    met = chosen.join(edges, (chosen["db"] == edges["db"]) & (chosen["table"] == edges["a"])).select(chosen["idx"], F.col("b").alias("table"))
    return met.join(chosen.select("idx", "table"), ["idx", "table"], "left_anti").groupBy("idx", "table").agg(F.count("*").alias("links"))


def induced_keys(chosen: DataFrame, catalog: DataFrame) -> DataFrame:
    """(idx, table, to_table): keys with both ends among the chosen tables."""
    fk = foreign_keys(catalog).select(F.lower(F.trim("db_id")).alias("db"), "table", "to_table").distinct()
    left = chosen.select("idx", "db", "table").join(fk, ["db", "table"])
    return left.join(chosen.select("idx", F.col("table").alias("to_table")), ["idx", "to_table"], "left_semi").select("idx", "table", "to_table")


def tables_with_bridges(items: DataFrame, catalog: DataFrame, top: int = 3) -> DataFrame:
    """(idx, table, place): the relevant tables; where there are fewer than ``top``, tables that keys connect to them follow."""
    best = relevant_tables(items, catalog, top)
    dbs = items.filter("db_id IS NOT NULL").select("idx", F.lower(F.trim("db_id")).alias("db"))
    more = bridges(best.join(dbs, "idx").select("idx", "db", "table"), catalog)
    both = best.select("idx", "table", F.lit(0).alias("bridge"), F.col("place").cast("bigint").alias("order")).union(
        more.select("idx", "table", F.lit(1).alias("bridge"), (-F.col("links")).alias("order")))
    place = F.row_number().over(Window.partitionBy("idx").orderBy("bridge", "order", "table"))
    return both.withColumn("place", place).filter(F.col("place") <= top).select("idx", "table", "place")


def ordered_docs(docs: DataFrame, limit: int = 120) -> DataFrame:
    """(db_id, doc_id, place): a database's chunks, tables before keys before columns, the first ``limit``."""
    rank = F.when(F.col("type") == "table", 0).when(F.col("type") == "fk", 1).when(F.col("type") == "column", 2).otherwise(99)
    place = F.row_number().over(Window.partitionBy("db_id").orderBy(rank, "doc_id"))
    return docs.withColumn("place", place).filter(F.col("place") <= limit).select("db_id", "doc_id", "place")


def question_lookup(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(idx, found): for every wanted question the first known item of its database with the same normal question.

    Known questions are reduced to one row for each database and normal form before they are joined.
    """
    key = [F.lower(F.trim("db_id")).alias("db"), normal_question(F.col("question")).alias("q")]
    first = known.select("idx", *key).filter("db IS NOT NULL AND q <> ''").groupBy("db", "q").agg(F.min("idx").alias("found"))
    return wanted.select("idx", *key).filter("db IS NOT NULL AND q <> ''").join(first, ["db", "q"]).select("idx", "found")
