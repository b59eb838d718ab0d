"""The candidate pool: one row per candidate variant, and what selectors need to know of it.

A question can hold a large share of all candidates, so nothing here sorts or collects a question in one task:
choices per question are aggregates over structs, which Spark combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.equality import MISSING, is_empty, result_key, rows_of

# Sources by reliability, best first; anything else ranks behind.
SOURCES = ("embedrag", "bm25rag", "lora_rag", "loraonly_ep3", "promptonly")
UNKNOWN_RANK = 999
#: Latency that stands for a missing one.
NO_LATENCY = 999999.0


def source_rank(source: Column, order: Sequence[str] = SOURCES, first: int = 1) -> Column:
    rank = F.lit(UNKNOWN_RANK)
    for place, name in reversed(list(enumerate(order, first))):
        rank = F.when(source == name, place).otherwise(rank)
    return rank


def candidate_pool(df: DataFrame) -> DataFrame:
    """Typed pool rows without nulls in what is compared; rows without a question are left out."""
    key = result_key(F.col("result"))
    return df.filter("idx IS NOT NULL").select(
        "idx", "pool_id", F.coalesce("ord", F.lit(0)).alias("ord"), "candidate_index",
        F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("variant", F.lit("original")).alias("variant"), "sql",
        F.coalesce("exec_ok", F.lit(False)).alias("ok"), F.coalesce("exec_correct", F.lit(False)).alias("correct"),
        F.coalesce("label_available", F.lit(False)).alias("labeled"), key.alias("key"), is_empty(key).alias("empty"),
        "result", "latency_ms", F.coalesce("latency_ms", F.lit(NO_LATENCY)).alias("latency"),
        F.coalesce("repair_available", F.lit(False)).alias("repair_available"), F.coalesce("repair_exec_ok", F.lit(False)).alias("repair_ok"),
        F.coalesce("original_exec_ok", F.lit(False)).alias("original_ok"),
        F.when(F.col("score").isNull() | F.isnan("score"), F.lit(-1e9)).otherwise(F.col("score")).alias("score"),
        source_rank(F.coalesce("source", F.lit("unknown"))).alias("rank"), (F.col("variant") == "strong_repair").cast("int").alias("repaired"),
    )


def first_by(df: DataFrame, group: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """The first row of every group by the given order, as a map-side combined aggregate."""
    taken = F.min(F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)], *[F.col(k).alias(f"k_{k}") for k in keep])).alias("first")
    return df.groupBy(*group).agg(taken).select(*group, *[F.col(f"first.k_{k}").alias(k) for k in keep])


def compacted(pool: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The pool with its candidates of one question, source, variant, outcome (and ``keys``) as one row: the first of them, and their number ``n``.

    Whatever a selector asks of those columns, of position and of identifier it can ask of these rows. They come
    from a hash aggregate, whose one buffer holds position and identifier as a number, so that no task sorts its
    candidates and a hot question is a few rows before anything is shuffled.
    """
    shown = ["idx", "source", "variant", "ok", "correct", "labeled", "rank", "repaired", *keys]
    return _placed(pool.groupBy(*shown).agg(_first_place(), F.count("*").alias("n")))


def _first_place() -> Column:
    """The least position and identifier as one number: identifiers lie within 2^63 of their position times 2^64."""
    return F.min(F.expr("cast(cast(ord as decimal(38,0)) * 18446744073709551616BD + cast(pool_id as decimal(38,0)) as decimal(38,0))")).alias("place")


def _placed(df: DataFrame) -> DataFrame:
    placed = df.withColumn("ord", F.expr("(place + 9223372036854775808BD) div 18446744073709551616BD"))
    return placed.withColumn("pool_id", F.expr("cast(place - cast(ord as decimal(38,0)) * 18446744073709551616BD as bigint)")).drop("place")


def counts(pool: DataFrame) -> DataFrame:
    """How many executable candidates of a question share each result."""
    return pool.filter(F.col("ok") & (F.col("key") != MISSING)).groupBy("idx", "key").agg(F.count("*").alias("support"))


def with_support(pool: DataFrame) -> DataFrame:
    """Every candidate with the number of executable candidates that share its result, 0 if it isn't one of them."""
    joined = pool.join(counts(pool), ["idx", "key"], "left")
    return joined.withColumn("support", F.when(F.col("ok"), F.coalesce("support", F.lit(0))).otherwise(0))


def enriched(pool: DataFrame) -> DataFrame:
    """Support and its share of the question's executable candidates, by one join with a row for each result of a question."""
    results = pool.groupBy("idx", "key").agg(F.count_if("ok").alias("n"))
    totals = results.groupBy("idx").agg(F.sum("n").alias("n_ok"))
    known = results.join(totals, "idx")
    support = F.when(F.col("ok") & (F.col("key") != MISSING), F.col("n")).otherwise(0)
    return pool.join(known, ["idx", "key"]).withColumn("support", support).drop("n").withColumn(
        "support_share", F.when(F.col("n_ok") > 0, F.round(F.col("support") / F.col("n_ok"), 6)).otherwise(0.0))


def executable_or_all(pool: DataFrame) -> DataFrame:
    """The executable candidates of a question, or all of them where none is."""
    some = pool.groupBy("idx").agg(F.max("ok").alias("any_ok"))
    return pool.join(some, "idx").filter(F.col("ok") | ~F.col("any_ok")).drop("any_ok")


def distinct_candidates(pool: DataFrame, lowered: bool = False) -> DataFrame:
    """The first of the candidates of a question that agree in source, variant and statement, or in the lowered statement."""
    text = F.lower(F.trim(F.coalesce("sql", F.lit(""))))
    keys = {"k": text} if lowered else {"k": F.concat_ws("\x1f", "source", "variant", F.coalesce("sql", F.lit("")))}
    return _placed(pool.groupBy("idx", F.md5(keys["k"]).alias("k")).agg(_first_place())).select("idx", "pool_id")


def nested_candidates(items: DataFrame) -> DataFrame:
    """(idx, position, source, sql, model): the candidates nested in the items, by position."""
    return items.select("idx", F.posexplode("candidates").alias("position", "c")).select(
        "idx", "position", "c.source", "c.sql", "c.model", F.col("c.error").alias("error"))


def nest(candidates: DataFrame, size: int = 1000) -> DataFrame:
    """(idx, chunk, candidates): the candidates of a question by position, in arrays of at most ``size`` positions."""
    packed = F.struct("position", "source", "sql", "model", "error")
    return candidates.groupBy("idx", F.floor(F.col("position") / size).cast("int").alias("chunk")).agg(F.array_sort(F.collect_list(packed)).alias("candidates"))


def zipped(base: DataFrame, sources: Mapping[str, DataFrame]) -> DataFrame:
    """(idx, position, source, sql, model, error): predictions of several sources side by side, by the number of their row.

    A source without a row leaves its candidate out; rows beyond the base are left out.
    """
    parts = [df.select("idx", F.lit(k).alias("position"), F.lit(name).alias("source"), "sql", "model", "error") for k, (name, df) in enumerate(sources.items())]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.join(base.select("idx"), "idx", "left_semi")


def wide_candidates(pool: DataFrame) -> DataFrame:
    """One row per candidate with its repair beside it, as the repair stages write them; of rows sent again the first counts."""
    taken = ["sql", "ok", "correct", "labeled", "result", "latency_ms", "repair_available"]
    first = first_by(pool.filter("candidate_index IS NOT NULL"), ["idx", "candidate_index", "repaired"], [F.col("ord"), F.col("pool_id")], ["source", *taken])
    of = lambda k: F.min(F.when(F.col("repaired") == k, F.struct(F.col("source"), *[F.col(c) for c in taken])))
    both = first.groupBy("idx", "candidate_index").agg(of(0).alias("o"), of(1).alias("r")).filter("o IS NOT NULL")
    return both.select(
        "idx", "candidate_index", F.col("o.source").alias("source"), *[F.col(f"o.{c}").alias(c) for c in taken[:-1]],
        F.col("r").isNotNull().alias("repair_attempted"), *[F.col(f"r.{c}").alias(f"repair_{c}") for c in taken[:-1]])


def united(wide: DataFrame, rule: str) -> DataFrame:
    """Originals and repairs in one pool, each question's in their order.

    weak and strong: a repair that was attempted, a strong one without latency; scored: attempted or with a
    statement, labels left out.
    """
    if rule not in ("weak", "strong", "scored"):
        raise ValueError(f"unknown rule {rule!r}")
    attempted = F.coalesce("repair_attempted", F.lit(False))
    there = attempted | (F.trim(F.coalesce("repair_sql", F.lit(""))) != "") if rule == "scored" else attempted
    shown = ["idx", "candidate_index", "source"]
    label = [] if rule == "scored" else [F.coalesce("correct", F.lit(False)).alias("correct")]
    original = wide.select(*shown, F.lit("original").alias("variant"), "sql", F.coalesce("ok", F.lit(False)).alias("ok"), *label, "result", "latency_ms")
    label = [] if rule == "scored" else [F.coalesce("repair_correct", F.lit(False)).alias("correct")]
    latency = F.col("repair_latency_ms") if rule == "weak" else F.lit(None).cast("double")
    name = "repair" if rule == "weak" else "strong_repair"
    repair = wide.filter(there).select(*shown, F.lit(name).alias("variant"), F.col("repair_sql").alias("sql"), F.coalesce("repair_ok", F.lit(False)).alias("ok"), *label,
                                       F.col("repair_result").alias("result"), latency.alias("latency_ms"))
    return original.unionByName(repair)


def preview(result: Column, rows: int = 5) -> Column:
    """The first rows of a result."""
    return F.slice(rows_of(result), 1, rows)


def needs_repair(pool: DataFrame, mode: str = "strong") -> Column:
    """failed_only: not executable; strong: or empty, or with string literals that may not match stored values."""
    failed = ~F.col("ok")
    if mode == "failed_only":
        return failed
    if mode == "strong":
        return failed | F.col("empty") | F.coalesce(F.col("sql").rlike("'[^']*'|\"[^\"]*\""), F.lit(False))
    raise ValueError(f"unknown mode {mode!r}")


def repair_signal() -> Column:
    return (
        F.when(~F.col("ok"), "execution_error").when(F.col("key") == MISSING, "no_result").when(F.col("empty"), "empty_result").otherwise("check_literals"))
