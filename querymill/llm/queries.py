"""The pN_ queries over the project's tables, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cross_split, eval_leaks, format_dups, group_splits, packing, pair_defects, top_n, truncation
from .runtime import read

#: Fixed order of the candidate sources, best first.
SOURCE_ORDER = ("embedrag", "bm25rag", "lora_rag", "promptonly", "loraonly_ep3")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_dups.further_copies(read(spark, sf_dir, "candidate_pool"))


def p1_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_dups.collapse(read(spark, sf_dir, "candidate_pool"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cross_split.overlapping_pairs(read(spark, sf_dir, "question_items"))
    return pairs.select(
        F.least("train_rid", "eval_rid").cast("int").alias("idx_a"), F.greatest("train_rid", "eval_rid").cast("int").alias("idx_b"))


def p2_linked_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same links between classes of copies: smallest records and sizes."""
    return cross_split.linked_classes(read(spark, sf_dir, "question_items"))


def p2_overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_split.overlap_report(read(spark, sf_dir, "question_items"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_splits.tied_databases(read(spark, sf_dir, "question_items"), read(spark, sf_dir, "db_catalog"))


def p3_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components that have several databases: root and members."""
    return group_splits.component_members(read(spark, sf_dir, "question_items"))


#: Proportions of the new splits.
SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def p3_split_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records per new split and source."""
    placed = group_splits.assign(read(spark, sf_dir, "question_items"), SPLITS)
    return placed.groupBy("new_split", "source").agg(F.count("*").alias("records"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = read(spark, sf_dir, "candidate_pool")
    return top_n.top_n(pool, 3, source_order=SOURCE_ORDER).select("idx", "pool_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_defects.defects(read(spark, sf_dir, "mysql_repair"))


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def p6_bucket_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.bucket_batches(read(spark, sf_dir, "documents"))


def p6_fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and unused share, across buckets and inside buckets only."""
    docs = read(spark, sf_dir, "documents")
    both = [packing.fill(f(docs)).withColumn("packing", F.lit(name))
            for name, f in (("across buckets", packing.pack), ("inside buckets", packing.bucket_batches))]
    return both[0].union(both[1])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_leaks.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_passages")).select("doc_id", "item_id")


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without the leaked spans: characters kept and removed of every text."""
    clean = eval_leaks.without_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_passages"))
    return clean.select("doc_id", F.length("text").alias("kept"), "removed")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_texts(read(spark, sf_dir, "documents"))


def p8_cut_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_shares(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_collapsed": p1_collapsed,
    "p2_found": p2_found,
    "p2_linked_classes": p2_linked_classes,
    "p2_overlap_report": p2_overlap_report,
    "p3_found": p3_found,
    "p3_members": p3_members,
    "p3_split_balance": p3_split_balance,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p6_pack": p6_pack,
    "p6_bucket_batches": p6_bucket_batches,
    "p6_fill_report": p6_fill_report,
    "p7_found": p7_found,
    "p7_cleaned": p7_cleaned,
    "p8_found": p8_found,
    "p8_cut_shares": p8_cut_shares,
}

# Databases that share a question, closed over all ways; (x, y) holds both directions.
_TIED = """WITH RECURSIVE k AS (SELECT DISTINCT NULLIF(LOWER(regexp_replace(db_id, '^\\s+|\\s+$', '', 'g')), '') AS db, NULLIF(LOWER(regexp_replace(question, '[^\\p{L}\\p{Nd}]', '', 'g')), '') AS q FROM question_items),
 e AS (SELECT DISTINCT a.db AS x, b.db AS y FROM k a JOIN k b ON a.q = b.q AND a.db <> b.db),
 r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
"""

SQL: dict[str, str] = {
    "p3_found": _TIED + """, spelt AS (SELECT LOWER(TRIM(db_id, ' ')) AS db, MIN(db_id) AS name FROM db_catalog GROUP BY 1),
         named AS (SELECT COALESCE(a.name, x) AS x, COALESCE(b.name, y) AS y FROM r LEFT JOIN spelt a ON a.db = x LEFT JOIN spelt b ON b.db = y)
        SELECT x AS db_id_a, y AS db_id_b FROM named WHERE x < y""",
    "p3_members": _TIED + " SELECT LEAST(x, MIN(y)) AS root, x AS db_id FROM r GROUP BY x",
    "p4_found": """
        SELECT idx, pool_id FROM (
          SELECT idx, pool_id, ROW_NUMBER() OVER (
            PARTITION BY idx
            ORDER BY CASE WHEN score IS NULL OR isnan(score) THEN 1 ELSE 0 END,
                     CASE WHEN score IS NULL OR isnan(score) THEN 0 ELSE score END DESC,
                     CASE source WHEN 'embedrag' THEN 0 WHEN 'bm25rag' THEN 1 WHEN 'lora_rag' THEN 2
                                 WHEN 'promptonly' THEN 3 WHEN 'loraonly_ep3' THEN 4 ELSE 5 END,
                     pool_id) AS place
          FROM candidate_pool WHERE idx IS NOT NULL AND pool_id IS NOT NULL) t
        WHERE place <= 3""",
}
