"""Training pairs and folds."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .scoring import candidate_kinds, kind_priority

MAX_PAIRS = 80


def preference_pairs(pool: DataFrame, limit: int = MAX_PAIRS, seed: str = "42") -> DataFrame:
    """(idx, place, positive, negative, kind): labelled wrong candidates with all labelled right ones of their question.

    The hardest wrong ones first, each with the right ones in an order drawn by hash, until ``limit`` pairs: so a
    question takes part with at most ``limit`` of either, and its pairs never grow beyond that. The limit is part
    of the operator.
    """
    kinds = candidate_kinds(pool).filter("labeled").withColumn("priority", kind_priority(F.col("kind")))
    turn = Window.partitionBy("idx").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "pool_id")), "pool_id")
    right = kinds.filter("correct").withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= limit)
    n_right = right.groupBy("idx").agg(F.max("turn").alias("n_right"))
    order = Window.partitionBy("idx").orderBy("priority", "ord", "pool_id")
    wrong = kinds.filter("NOT correct").withColumn("at", F.row_number().over(order)).filter(F.col("at") <= limit)
    needed = wrong.join(n_right, "idx").filter((F.col("at") - 1) * F.col("n_right") < limit)
    # at most ``limit`` rows of a question leave this join, and less than as many again are dropped from them
    both = needed.select("idx", "at", "n_right", "kind", F.col("pool_id").alias("negative")).join(
        right.select("idx", "turn", F.col("pool_id").alias("positive")), "idx")
    placed = both.withColumn("place", ((F.col("at") - 1) * F.col("n_right") + F.col("turn")).cast("int"))
    return placed.filter(F.col("place") <= limit).select("idx", "place", "positive", "negative", "kind")


def pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("kind").agg(F.count("*").alias("pairs"), F.count_distinct("idx").alias("questions"))


def _sequence(rows: int, n: int, loads: list[int]) -> list[tuple[int, int]]:
    """(load before, fold) of every one of n databases of so many rows: each goes to the smallest fold, the lower number on a tie."""
    heap = [(load, k) for k, load in enumerate(loads)]
    heapq.heapify(heap)
    out = []
    for _ in range(n):
        load, k = heapq.heappop(heap)
        out.append((load, k))
        heapq.heappush(heap, (load + rows, k))
        loads[k] += rows
    return out


def database_folds(items: DataFrame, folds: int) -> DataFrame:
    """(db_id, rows, fold): largest database first into the smallest fold, the lower number on a tie; equal ones by name.

    Items without a database count as one, ``unknown``. The driver places numbers of databases of equal size, and
    every database finds its fold by its rank among those of its size.
    """
    name = F.coalesce(F.nullif(F.lower(F.trim("db_id")), F.lit("")), F.lit("unknown"))
    sizes = cut(items.groupBy(name.alias("db_id")).agg(F.count("*").alias("rows")))
    loads, table = [0] * folds, []
    for row in sorted(sizes.groupBy("rows").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["rows"]):  # one row for each size
        table += [(row["rows"], place, fold) for place, (_, fold) in enumerate(_sequence(row["rows"], row.n, loads), 1)]
    placed = items.sparkSession.createDataFrame(table, "rows bigint, place int, fold int")
    ranked = sizes.withColumn("place", F.row_number().over(Window.partitionBy("rows").orderBy("db_id")))
    return ranked.join(placed, ["rows", "place"]).select("db_id", "rows", "fold")


def fold_rows(items: DataFrame, folds: DataFrame, held: int) -> DataFrame:
    """(idx, split): the items of fold ``held`` as eval, all others as train."""
    name = F.coalesce(F.nullif(F.lower(F.trim("db_id")), F.lit("")), F.lit("unknown"))
    return items.select("idx", name.alias("db_id")).join(folds, "db_id").select("idx", F.when(F.col("fold") == held, "eval").otherwise("train").alias("split"))
