"""Retrieval: an inverted index with BM25 scores, schema context for questions, dense search over vectors.

Query sets are stated and bounded in blocks; documents are never paired with each other. Postings are reduced to
the words of the queries before they are scored, while frequencies, lengths and the inverse document frequency
cover all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import retrieval_tokens, with_semicolon
from ..runtime import cut

K1, B = 1.2, 0.75
#: Rows of queries that are broadcast at once, and vectors that are scored against them at once.
BLOCK, CHUNK = 1024, 2048
#: Words of queries up to which they are broadcast to the postings; beyond, both are shuffled by word.
BROADCAST_WORDS = 500_000


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # term, doc, tf, dl and what else was kept
    terms: DataFrame  # term, df, idf
    docs: DataFrame  # doc, dl and what else was kept
    n: int
    average: float


def build_index(docs: DataFrame, doc: str, text: str, keep: tuple[str, ...] = ()) -> Index:
    """Postings, inverse document frequencies ln(1 + (N - df + 0.5) / (df + 0.5)) and document lengths."""
    # tokens are read for lengths, frequencies and postings, and made once
    made = docs.filter(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), *keep, retrieval_tokens(F.col(text)).alias("tokens"))
    tokens = cut(made.withColumn("dl", F.size("tokens")))
    n, average = tokens.agg(F.count("*"), F.coalesce(F.avg("dl"), F.lit(0.0))).first()
    # by document: what is counted and summed for a document further on stays where it is
    postings = tokens.repartition("doc").select("doc", *keep, "dl", F.explode("tokens").alias("term")).groupBy("doc", "term", *keep, "dl").agg(F.count("*").alias("tf"))
    df = tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    terms = df.withColumn("idf", F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    return Index(postings, terms, tokens.drop("tokens"), n, average)


def save_index(index: Index, path: str) -> None:
    """The index as tables below ``path``; postings lie together by term, so that a query's words prune what is read."""
    index.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    index.docs.sparkSession.createDataFrame([(index.n, float(index.average), K1, B)], "n bigint, average double, k1 double, b double").write.mode("overwrite").parquet(f"{path}/corpus")


def load_index(spark: SparkSession, path: str) -> Index:
    corpus = spark.read.parquet(f"{path}/corpus").first()
    return Index(*(spark.read.parquet(f"{path}/{part}") for part in ("postings", "terms", "docs")), corpus.n, corpus.average)


def bm25(index: Index, queries: DataFrame, query: str, text: str, same: dict[str, str] | None = None) -> DataFrame:
    """(query, doc, score, first) and what the index kept: a query's words count as often as they occur.

    ``same`` asks a query column to equal one of the document, as part of the join. Postings carry all that a score needs.
    The words of the queries go to the postings, if they are at most BROADCAST_WORDS, so that a document's score is
    summed where its postings are; else they meet by a shuffle.
    """
    same = same or {}
    tokens = queries.select(F.col(query).alias("query"), *[F.col(q).alias(d) for q, d in same.items()], F.posexplode(retrieval_tokens(F.col(text))).alias("pos", "term"))
    asked = cut(tokens.groupBy("query", *same.values(), "term").agg(F.count("*").alias("times"), F.min("pos").alias("pos")).join(index.terms, "term"))
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_WORDS else asked
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(index.average + 1e-9)) + 1e-9)
    kept = [c for c in index.postings.columns if c not in ("term", "doc", "tf", "dl")]
    scored = index.postings.join(asked, ["term", *same.values()])
    return scored.groupBy("query", "doc", *kept).agg(F.round(F.sum(F.col("times") * weight), 6).alias("score"), F.min("pos").alias("first"))


def top_docs(scores: DataFrame, k: int) -> DataFrame:
    """The k best documents of every query; ties by the first query word that met the document, then the document."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "first", "doc")
    return scored_places(scores, order, k)


def scored_places(scores: DataFrame, order: Window, k: int) -> DataFrame:
    return scores.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def schema_context(docs: DataFrame, items: DataFrame, quotas: dict[str, int] | None = None, depth: int = 200) -> DataFrame:
    """(query, doc, type, score, place): of the best ``depth`` chunks of the question's database the best tables and columns, and keys that touch them."""
    quotas = quotas or {"table": 5, "column": 8, "fk": 8}
    index = build_index(docs.withColumn("db", F.lower(F.trim("db_id"))), "doc_id", "text", ("db", "type", "tables"))
    asked = items.filter("question IS NOT NULL AND db_id IS NOT NULL").withColumn("qdb", F.lower(F.trim("db_id")))
    best = cut(top_docs(bm25(index, asked, "idx", "question", {"qdb": "db"}), depth).drop("place"))
    order = Window.partitionBy("query", "type").orderBy(F.desc("score"), "first", "doc")
    limit = F.lit(0)
    for name, n in quotas.items():
        limit = F.when(F.col("type") == name, n).otherwise(limit)
    chosen = best.filter("type <> 'fk'").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    touched = chosen.groupBy("query").agg(F.flatten(F.collect_set("tables")).alias("touched"))  # at most the quotas
    keys = best.filter("type = 'fk'").join(touched, "query").filter(F.arrays_overlap("tables", "touched")).withColumn(
        "place", F.row_number().over(order)).filter(F.col("place") <= limit)
    shown = ["query", "doc", "type", "score", "place"]
    return chosen.select(*shown).unionByName(keys.select(*shown))


# The titles of a context's blocks, in their order, and what stands in an empty one.
BLOCKS = {"table": "=== TABLES (Top) ===", "column": "=== COLUMNS (Top) ===", "fk": "=== FOREIGN KEYS / JOIN HINTS ==="}
EMPTY_BLOCK = "(EMPTY)"


def context_text(context: DataFrame, docs: DataFrame) -> DataFrame:
    """(query, text): the chunks of a context in three titled blocks; a context has few chunks."""
    full = context.join(docs.select(F.col("doc_id").alias("doc"), "text"), "doc").groupBy("query").agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("place", "text")))), lambda x: x["text"]).alias(kind) for kind in BLOCKS])
    block = lambda kind, title: F.concat(F.lit(title + "\n"), F.when(F.size(kind) > 0, F.array_join(kind, "\n\n")).otherwise(EMPTY_BLOCK), F.lit("\n"))
    return full.select("query", F.concat(*[block(kind, title) for kind, title in BLOCKS.items()]).alias("text"))


def allowed_names(text: Column, what: str, most: int) -> Column:
    """The distinct names on a context's lines "Table: …" or "Column: …", in their order, one on a line."""
    found = F.transform(F.regexp_extract_all(text, F.lit(rf"(?m)^\s*{what}: (.*)$"), F.lit(1)), lambda x: F.trim(x))
    names = F.slice(F.array_sort(F.array_distinct(found)), 1, most)
    return F.when(F.size(names) > 0, F.array_join(names, "\n")).otherwise("(none)")


def prompt_cache(contexts: DataFrame, items: DataFrame, chars: int = 1800, tables: int = 50, columns: int = 200) -> DataFrame:
    """(idx, db_id, input_text, target_text): what a model is trained on: context, allowed names and question, and the statement.

    The context is cut at ``chars`` and the names are those of the cut context.
    """
    cut_text = F.left("text", F.lit(chars))
    joined = items.join(contexts.withColumnRenamed("query", "idx"), "idx").withColumn("schema", cut_text)
    part = lambda title, body: F.concat(F.lit(title + "\n"), body, F.lit("\n"))
    text = F.concat(part("Schema context:", F.col("schema")), part("Allowed tables:", allowed_names(F.col("schema"), "Table", tables)),
                    part("Allowed columns:", allowed_names(F.col("schema"), "Column", columns)), part("Question:", F.trim("question")), F.lit("SQL:"))
    return joined.select("idx", "db_id", text.alias("input_text"), with_semicolon(F.col("gold")).alias("target_text"))


def context_hits(scores: DataFrame, docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(query, text): the hits of a query in their order, each with its score."""
    shown = scores.join(docs.select(F.col(doc).alias("doc"), F.col(text).alias("shown")), "doc").withColumn("line", F.format_string("[%.4f] %s", "score", "shown"))
    lines = shown.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("x"))
    return lines.select("query", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("text"))


def dense_search(vectors: DataFrame, queries: DataFrame, k: int, doc: str = "vec_id", vector: str = "embedding", group: str | None = None) -> DataFrame:
    """(query, doc, score, place): the k vectors with the highest inner product for every query, itself left out.

    Queries are broadcast in blocks of BLOCK rows; every task keeps its k best for each query, and those few are
    merged by query. ``group`` restricts a query to vectors with the same value.
    """
    kept = [F.col(doc).cast("bigint").alias("doc"), (F.col(group).cast("string") if group else F.lit("")).alias("grp"), F.col(vector).alias("vec")]
    out = None
    for block in _blocks(queries.select(*kept).filter("vec IS NOT NULL AND doc IS NOT NULL").orderBy("doc").toLocalIterator()):
        ids = np.array([r.doc for r in block], np.int64)
        groups = np.array([r.grp or "" for r in block])
        shared = vectors.sparkSession.sparkContext.broadcast((ids, groups, np.array([r.vec for r in block], np.float64)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q_ids, q_groups, q = shared.value
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for batch in batches:
                for at in range(0, batch.num_rows, CHUNK):
                    part = batch.slice(at, CHUNK)
                    ids = part.column(0).to_numpy()
                    x = np.stack(part.column(2).to_numpy(zero_copy_only=False)).astype(np.float64)
                    scores = np.round(q @ x.T, 6)
                    scores[q_ids[:, None] == ids[None, :]] = -np.inf
                    if group:
                        own = np.array([g or "" for g in part.column(1).to_pylist()])
                        scores[q_groups[:, None] != own[None, :]] = -np.inf
                    # all that reach the k-th score, ties too
                    least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(q), -np.inf)
                    rows, cols = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
                    best = _k_best(*(np.concatenate(c) for c in zip(best, (rows, ids[cols], scores[rows, cols]))), k)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query", "doc", "score"])

        part = vectors.select(*kept).filter("vec IS NOT NULL AND doc IS NOT NULL").mapInArrow(run, "query bigint, doc bigint, score double")
        out = part if out is None else out.union(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query bigint, doc bigint, score double, place int")
    return scored_places(out, Window.partitionBy("query").orderBy(F.desc("score"), "doc"), k)


def _k_best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores, rows))
    rows = rows[order]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, int)
    place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    keep = order[place < k]
    return rows[place < k], ids[keep], scores[keep]


def _blocks(rows: Iterator) -> Iterator[list]:
    block: list = []
    for row in rows:
        block.append(row)
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block
