"""Selectors: one candidate for every question.

All of them are orders over structs taken as aggregates. Selectors that ask only for sources, outcomes and results
take them of the compacted pool, which a hash aggregate makes before the shuffle. Those that rank by latency or
score need every candidate: each task sorts its own by question, combines them, and shuffles what is left.
Selectors that vote first aggregate by question and result, then by question, so a hot question is never whole in
one place. Pool position and identifier end every order, so that a choice doesn't depend on how rows are spread.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pool import compacted, first_by, source_rank, with_support

KEEP = ["pool_id", "source", "variant", "ok", "correct"]
# Fixed value: the order in which equal scores are told apart.
SCORE_TIES = ("embedrag", "bm25rag", "lora_rag", "promptonly", "loraonly_ep3")


def _col(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def _pick(pool: DataFrame, *order: Column, keep: list[str] | None = None) -> DataFrame:
    return first_by(pool, ["idx"], [*order, *_col("ord", "pool_id")], keep or KEEP)


def rule_priority(pool: DataFrame) -> DataFrame:
    """Executable candidates, else all; best source first."""
    return _pick(compacted(pool), ~F.col("ok"), F.col("rank"))


def repaired_last(pool: DataFrame) -> DataFrame:
    """Originals before repairs, then the source."""
    return _pick(compacted(pool), ~F.col("ok"), F.col("repaired"), F.col("rank"))


def oracle_repaired(pool: DataFrame) -> DataFrame:
    """Reads labels: a bound for analysis, not a selector."""
    return _pick(compacted(pool), ~F.col("ok"), ~F.col("correct"), F.col("repaired"), F.col("rank"))


def by_score(pool: DataFrame) -> DataFrame:
    """Highest score whether executable or not, since the score carries execution."""
    return _pick(pool, -F.col("score"), source_rank(F.col("source"), SCORE_TIES, 0), F.col("repaired"))


def fixed_model(pool: DataFrame, default: str = "embedrag") -> DataFrame:
    """The first candidate of the default model, whether it runs or not; without one an executable candidate by rank, else any."""
    other = F.col("source") != default
    return _pick(compacted(pool), other, F.when(other, ~F.col("ok")), F.when(other, F.col("rank")))


def oracle_model(pool: DataFrame) -> DataFrame:
    """Reads labels: a correct candidate by rank, else an executable one, else any."""
    return _pick(compacted(pool), F.when(F.col("correct"), 0).when(F.col("ok"), 1).otherwise(2), F.col("rank"))


def priority_with_variant(pool: DataFrame) -> DataFrame:
    return _pick(compacted(pool), ~F.col("ok"), F.col("rank"), F.col("repaired"))


def semantic_score(pool: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return _pick(pool, ~F.col("ok"), -F.col("score"), F.col("rank"), F.col("repaired"), keep=keep)


def _by_result(pool: DataFrame, inner: list[Column], keep: list[str]) -> DataFrame:
    """One row per question and result with its votes and best candidate; failed candidates make one result without votes."""
    key = F.when(F.col("ok"), F.col("key")).otherwise("\x00")
    n = F.sum("n") if "n" in pool.columns else F.count("*")
    votes = F.when(F.max("ok"), n).otherwise(0)
    best = F.min(F.struct(*[o.alias(f"_{i}") for i, o in enumerate([*inner, *_col("ord", "pool_id")])], *[F.col(k).alias(f"k_{k}") for k in keep]))
    return pool.withColumn("group_key", key).groupBy("idx", "group_key").agg(
        votes.alias("votes"), F.max("ok").alias("g_ok"), F.max("empty").alias("g_empty"), best.alias("best"))


def _vote(pool: DataFrame, nonempty_first: bool, inner: list[Column], keep: list[str] | None = None) -> DataFrame:
    keep = keep or KEEP
    groups = _by_result(pool, inner, keep)
    order = [~F.col("g_ok"), -F.col("votes"), *([F.col("g_ok") & F.col("g_empty")] if nonempty_first else []), F.col("best")]
    won = groups.groupBy("idx").agg(F.min(F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)])).alias("w"))
    return won.select("idx", *[F.col(f"w._{len(order) - 1}.k_{k}").alias(k) for k in keep])


def vote(pool: DataFrame) -> DataFrame:
    """The result most executable candidates share, ties to the result with the better source."""
    return _vote(compacted(pool, ["key", "empty"]), False, _col("rank"))


def practical(pool: DataFrame) -> DataFrame:
    """Votes, then non-empty results, source, variant, latency; without executable candidates source and variant."""
    return _vote(pool, True, [*_col("rank", "repaired"), F.when(F.col("ok"), F.col("latency")).otherwise(0.0)])


def consensus_model(pool: DataFrame) -> DataFrame:
    return _vote(pool, True, [F.col("rank"), F.when(F.col("ok"), F.col("latency")).otherwise(0.0)])


def consensus(pool: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return _vote(pool if keep else compacted(pool, ["key", "empty"]), True, _col("rank", "repaired"), keep)


def oracle_consensus(pool: DataFrame) -> DataFrame:
    """Reads labels: a labelled correct candidate by rank, else the consensus."""
    right = _pick(compacted(pool.filter("labeled AND correct")), F.col("rank"), F.col("repaired"))
    return _either(right, consensus(pool))


def _either(first: DataFrame, second: DataFrame) -> DataFrame:
    a = first.select("idx", F.struct(*KEEP).alias("a"))
    b = second.select("idx", F.struct(*KEEP).alias("b"))
    return a.join(b, "idx", "full").select("idx", F.coalesce("a", "b").alias("x")).select("idx", "x.*")


def hybrid(pool: DataFrame, margin: float = 0.25) -> DataFrame:
    """The consensus, unless the semantic choice scores at least ``margin`` more."""
    base, scored = (f(pool, [*KEEP, "score"]) for f in (consensus, semantic_score))
    pack = lambda df, name: df.select("idx", F.struct(*KEEP, "score").alias(name))
    both = pack(base, "base").join(pack(scored, "other"), "idx")
    chosen = F.when(F.col("other.score") >= F.col("base.score") + margin, F.col("other")).otherwise(F.col("base"))
    return both.select("idx", chosen.alias("x")).select("idx", *[f"x.{k}" for k in KEEP])


def conservative_switch(pool: DataFrame, default: str = "embedrag") -> DataFrame:
    """Keep the default model's first candidate unless the others give a reason, by a list of decisions.

    Nothing executable: the default, else the best source. Default missing or failed: consensus. Default shared
    and not empty: keep. Some non-empty result shared by three: that. Default empty and another not: that.
    Default alone and two others agree on a non-empty result: the best of such others. Else keep.
    """
    is_default = F.col("source") == default
    keyed = compacted(pool, ["key", "empty"]).withColumn("group_key", F.when(F.col("ok"), F.col("key")).otherwise("\x00"))
    keep = [F.col(k).alias(f"k_{k}") for k in KEEP]
    row = F.struct(F.col("rank").alias("_0"), F.col("ord").alias("_1"), F.col("pool_id").alias("_2"), *keep)
    own = F.struct(F.col("ord").alias("_0"), F.col("pool_id").alias("_1"), *keep)
    groups = keyed.groupBy("idx", "group_key").agg(
        F.when(F.max("ok"), F.sum("n")).otherwise(0).alias("votes"), F.sum(F.when(~is_default, F.col("n")).otherwise(0)).alias("others"),
        F.max("ok").alias("g_ok"), F.max("empty").alias("g_empty"), F.min(row).alias("best"),
        F.min(F.when(~is_default, row)).alias("best_other"), F.min(F.when(is_default, own)).alias("default_row"))
    full = F.col("g_ok") & ~F.col("g_empty")
    votes = -F.col("votes").alias("v")
    per = groups.groupBy("idx").agg(
        F.max("g_ok").alias("any_ok"), F.min(F.when(F.col("g_ok"), F.struct(votes, F.col("g_empty").alias("e"), F.col("best").alias("b")))).alias("consensus"),
        F.min(F.when(full, F.struct(votes, F.col("best").alias("b")))).alias("full_best"), F.max(F.when(full, F.col("votes"))).alias("full_votes"),
        F.min(F.when(full & (F.col("others") >= 2), F.struct(votes, F.col("best_other").alias("b")))).alias("agreed"),
        F.min(F.when(~F.col("g_ok"), F.col("best"))).alias("failed_best"),
        F.min(F.when(F.col("default_row").isNotNull(), F.struct("default_row", "votes", "g_empty", "g_ok"))).alias("d"))
    shown = lambda c: F.struct(*[F.col(f"{c}.k_{k}").alias(k) for k in KEEP])
    chosen = (
        F.when(~F.col("any_ok"), F.when(F.col("d").isNotNull(), shown("d.default_row")).otherwise(shown("failed_best")))
        .when(F.col("d").isNull() | ~F.col("d.g_ok"), shown("consensus.b"))
        .when((F.col("d.votes") >= 2) & ~F.col("d.g_empty"), shown("d.default_row"))
        .when(F.coalesce(F.col("full_votes"), F.lit(0)) >= 3, shown("full_best.b"))
        .when(F.col("d.g_empty") & F.col("full_best").isNotNull(), shown("full_best.b"))
        .when((F.col("d.votes") == 1) & F.col("agreed").isNotNull(), shown("agreed.b"))
        .otherwise(shown("d.default_row")))
    return per.select("idx", chosen.alias("x")).select("idx", "x.*")


def alternatives(pool: DataFrame, k: int = 3) -> DataFrame:
    """(idx, place, pool_id, score): at most k executable candidates that differ from the consensus in result or statement."""
    base = consensus(pool, ["pool_id", "key", "sql", "score"]).select(
        "idx", F.col("pool_id").alias("base_id"), F.col("key").alias("base_key"), F.col("sql").alias("base_sql"), F.col("score").alias("base_score"))
    other = (
        with_support(pool).filter(F.col("ok") & (F.trim(F.coalesce("sql", F.lit(""))) != "")).join(base, "idx")
        .filter((F.col("key") != F.col("base_key")) | ~F.col("sql").eqNullSafe(F.col("base_sql"))))
    # a row_number up to k is cut before the shuffle, in every task
    order = Window.partitionBy("idx").orderBy(-F.col("support"), "empty", "rank", "repaired", "ord", "pool_id")
    return other.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select(
        "idx", "place", "pool_id", "score", "base_id", "base_score")


def corrected(judged: DataFrame, min_confidence: float = 0.72, min_gain: float = 1.0) -> DataFrame:
    """(idx, pool_id, switches): the base candidate after the judgments of a question, in their order.

    Judgments have place, pool_id, winner (A or B), confidence, total_a, total_b; a question has at most a few.
    """
    steps = F.array_sort(F.collect_list(F.struct("place", "pool_id", "winner", "confidence", "total_a", "total_b")))
    per = judged.groupBy("idx").agg(F.first("base_id").alias("base_id"), steps.alias("steps"))
    start = F.struct(F.col("base_id").alias("pool_id"), F.lit(0).alias("switches"))

    def step(acc: Column, s: Column) -> Column:
        take = (s["winner"] == "B") & (s["confidence"] >= min_confidence) & (s["total_b"] >= s["total_a"] + min_gain)
        return F.when(take, F.struct(s["pool_id"].alias("pool_id"), (acc["switches"] + 1).alias("switches"))).otherwise(acc)

    return per.select("idx", F.aggregate("steps", start, step).alias("x")).select("idx", "x.*")


# What a judge scores each side by.
CRITERIA = ("selected_output", "filters", "aggregation_grouping", "join_schema_grounding", "ordering_limit_distinct", "result_plausibility")


def rubric_total(scores: Column, side: str) -> Column:
    """The sum of a side's scores over all criteria; a missing or unreadable one counts nothing."""
    return sum((F.coalesce(F.try_element_at(scores, F.lit(c))[side], F.lit(0.0)) for c in CRITERIA), F.lit(0.0))


def with_judgments(alternatives: DataFrame, cache: DataFrame) -> DataFrame:
    """Alternatives with the recorded judgment of their ``cache_key``; without one the base wins, without confidence.

    The cache has (cache_key, response); of several entries the last in order of the text counts.
    """
    from ..functions.text import judgment

    last = cache.groupBy("cache_key").agg(F.max("response").alias("response"))
    read = alternatives.join(last, "cache_key", "left").withColumn("j", judgment(F.col("response")))
    return read.select(*alternatives.columns, F.col("j.winner").alias("winner"), F.col("j.confidence").alias("confidence"),
                       rubric_total(F.col("j.scores"), "A").alias("total_a"), rubric_total(F.col("j.scores"), "B").alias("total_b"))


def matched_choice(choices: DataFrame, pool: DataFrame) -> DataFrame:
    """(choice_id, pool_id): the first candidate of a question that a recorded choice (choice_id, idx, source, variant, sql) means.

    What the choice leaves open (null or '') is not compared; statements are compared without case and outer blanks.
    Choices with a statement meet candidates by it, those without by source and variant, so that no question is paired with itself.
    """
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    plain = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    asked = choices.filter("idx IS NOT NULL").select("choice_id", "idx", some("source").alias("c_source"), some("variant").alias("c_variant"), plain("sql").alias("text"))
    there = pool.withColumn("text", plain("sql"))
    by_text = first_by(there, ["idx", "text", "source", "variant"], _col("ord", "pool_id"), ["ord", "pool_id"])
    by_source = first_by(there, ["idx", "source", "variant"], _col("ord", "pool_id"), ["ord", "pool_id"])
    fits = (F.col("c_source").isNull() | (F.col("c_source") == F.col("source"))) & (F.col("c_variant").isNull() | (F.col("c_variant") == F.col("variant")))
    told = asked.filter("text <> ''").join(by_text, ["idx", "text"]).filter(fits)
    bare = asked.filter("text = ''").join(by_source, "idx").filter(fits)
    both = told.select("choice_id", "ord", "pool_id").unionByName(bare.select("choice_id", "ord", "pool_id"))
    return first_by(both, ["choice_id"], _col("ord", "pool_id"), ["pool_id"])


def aligned(a: DataFrame, b: DataFrame, key: str = "idx") -> DataFrame:
    """The rows of both by key, a's columns as ``a`` and b's as ``b``; an error if any row has no partner or a key repeats."""
    left = a.groupBy(key).agg(F.first(F.struct(*[c for c in a.columns if c != key])).alias("a"), F.count("*").alias("n_a"))
    right = b.groupBy(key).agg(F.first(F.struct(*[c for c in b.columns if c != key])).alias("b"), F.count("*").alias("n_b"))
    fine = (F.col("n_a") == 1) & (F.col("n_b") == 1)
    checked = F.when(fine, F.col("a")).otherwise(F.raise_error(F.concat(F.lit("not aligned by key: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    return left.join(right, key, "full").select(key, checked.alias("a"), "b")


def judged_by_score(pool: DataFrame) -> DataFrame:
    """A stand-in judge: the alternatives of every question, compared with its base by score."""
    gap = F.col("score") - F.col("base_score")
    return alternatives(pool).select(
        "idx", "place", "pool_id", "base_id", F.when(gap > 0, "B").otherwise("A").alias("winner"),
        F.least(F.lit(1.0), 0.5 + F.abs(gap) / 50).alias("confidence"), (F.col("base_score") / 10).alias("total_a"), (F.col("score") / 10).alias("total_b"))


SELECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "rule_priority": rule_priority, "vote": vote, "repaired_last": repaired_last, "oracle_repaired": oracle_repaired, "practical": practical,
    "by_score": by_score, "fixed_model": fixed_model, "consensus_model": consensus_model, "conservative_switch": conservative_switch,
    "oracle_model": oracle_model, "priority_with_variant": priority_with_variant, "consensus": consensus, "oracle_consensus": oracle_consensus,
    "semantic_score": semantic_score, "hybrid": hybrid,
}


def correction_cases(pool: DataFrame, min_alternatives: int = 1) -> DataFrame:
    """(idx, results, alternatives): questions worth judging: the consensus runs, others differ from it, results disagree.

    Distinct results are counted over one row per question and result.
    """
    results = pool.filter("ok").groupBy("idx", "key").agg(F.count("*").alias("n")).groupBy("idx").agg(F.count("*").alias("results"))
    others = alternatives(pool).groupBy("idx").agg(F.count("*").alias("alternatives"))
    runs = consensus(pool).filter("ok").select("idx")
    return runs.join(results.filter("results >= 2"), "idx").join(others.filter(F.col("alternatives") >= min_alternatives), "idx")
