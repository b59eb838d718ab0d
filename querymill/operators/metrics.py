"""Metrics of pools, selections, repairs, evidence and paired outcomes.

Rates are 0 where nothing is counted and rounded to six places. Whatever needs "any candidate of a question" is
aggregated by question first, then over questions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.equality import MISSING, is_empty, typed_key
from .pool import first_by


def rate(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0)), 6)


def share(flag: Column) -> Column:
    return rate(F.count_if(flag), F.count("*"))


def by_source(pool: DataFrame) -> DataFrame:
    """Candidates, executable and correct ones, rates and mean latency of every source."""
    ok, right = F.col("ok"), F.col("correct")
    return pool.groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(ok).alias("exec_ok"), F.count_if(right).alias("correct"), share(ok).alias("exec_rate"),
        share(right).alias("accuracy"), F.round(F.avg("latency_ms"), 4).alias("mean_latency_ms"))


def coverage(pool: DataFrame) -> DataFrame:
    """Over questions: any executable candidate, any correct one, all failed."""
    per = pool.groupBy("idx").agg(F.max("ok").alias("ok"), F.max("correct").alias("correct"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("questions"), F.sum("n").alias("candidates"), share(F.col("ok")).alias("exec_coverage"),
                   share(F.col("correct")).alias("oracle_accuracy"), F.count_if(~F.col("ok")).alias("all_failed"))


def source_and_all(pool: DataFrame) -> DataFrame:
    """The candidate rates of every source and of all together, in one pass."""
    g = pool.groupBy("idx", "source").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.count_if("correct").alias("n_correct"))
    return g.rollup("source").agg(F.sum("n").alias("total"), rate(F.sum("n_ok"), F.sum("n")).alias("exec_rate"), rate(F.sum("n_correct"), F.sum("n")).alias("accuracy")).select(
        F.coalesce("source", F.lit("(all)")).alias("source"), "total", "exec_rate", "accuracy")


def selected(choice: DataFrame) -> DataFrame:
    """Of a selection: executable and correct shares, share and number of repaired variants, mean latency where one is known."""
    repaired = F.col("variant").isin("repair", "strong_repair")
    latency = F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 4) if "latency_ms" in choice.columns else F.lit(0.0)
    return choice.agg(F.count("*").alias("questions"), share(F.col("ok")).alias("exec_rate"), share(F.col("correct")).alias("accuracy"),
                      share(repaired).alias("repair_share"), F.count_if(repaired).alias("repairs"), latency.alias("mean_latency_ms"))


def with_latency(choice: DataFrame, pool: DataFrame) -> DataFrame:
    return choice.join(pool.select("pool_id", "latency_ms"), "pool_id")


def exec_accuracy(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Executed predictions (idx, ok, result) against executed gold statements of the same columns: equal bags of typed rows are right."""
    g = gold.select("idx", F.col("ok").alias("gold_ok"), typed_key(F.col("result")).alias("gold_key"))
    p = predicted.select("idx", F.col("ok").alias("pred_ok"), typed_key(F.col("result")).alias("pred_key"))
    ok = lambda c: F.coalesce(F.col(c), F.lit(False))
    right = ok("gold_ok") & ok("pred_ok") & F.coalesce(F.col("gold_key") == F.col("pred_key"), F.lit(False))
    return p.join(g, "idx", "left").agg(
        F.count("*").alias("total"), F.count_if(ok("gold_ok")).alias("gold_executable"), F.count_if(ok("pred_ok")).alias("pred_executable"),
        share(ok("gold_ok")).alias("gold_exec_rate"), share(ok("pred_ok")).alias("pred_exec_rate"), F.count_if(right).alias("exec_correct"), share(right).alias("exec_acc"))


def histogram(df: DataFrame, by: str, right: str = "correct") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(right).alias("n_correct"))


def labeled(choice: DataFrame, pool: DataFrame) -> DataFrame:
    """Accuracy over labelled questions, and over those where a correct and a wrong executable candidate compete."""
    per = pool.groupBy("idx").agg(F.max("labeled").alias("labeled"), F.max(F.col("ok") & F.col("correct")).alias("right"),
                                  F.max(F.col("ok") & F.col("labeled") & ~F.col("correct")).alias("wrong"))
    hard = F.col("right") & F.col("wrong")
    joined = choice.select("idx", "correct").join(per.filter("labeled"), "idx")
    return joined.agg(F.count("*").alias("labeled"), F.count_if("correct").alias("labeled_correct"), F.count_if(hard).alias("hard"),
                      F.count_if(hard & F.col("correct")).alias("hard_correct"), share(F.col("correct")).alias("accuracy"),
                      rate(F.count_if(hard & F.col("correct")), F.count_if(hard)).alias("hard_accuracy"))


def subsets(pool: DataFrame, named: Mapping[str, Sequence[str]]) -> DataFrame:
    """Candidate rates, coverage and oracle of every named subset of sources.

    A question's candidates are summed by source first; the subsets, a handful, are exploded over those sums.
    """
    table = [F.struct(F.lit(n).alias("subset"), F.array(*[F.lit(s) for s in sources]).alias("sources")) for n, sources in named.items()]
    g = pool.groupBy("idx", "source").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.count_if("correct").alias("n_correct"))
    each = g.withColumn("s", F.explode(F.array(*table))).filter(F.array_contains("s.sources", F.col("source")))
    per = each.groupBy("s.subset", "idx").agg(*[F.sum(c).alias(c) for c in ("n", "n_ok", "n_correct")])
    return per.groupBy("subset").agg(
        F.count("*").alias("questions"), rate(F.sum("n_ok"), F.sum("n")).alias("exec_rate"), rate(F.sum("n_correct"), F.sum("n")).alias("accuracy"),
        share(F.col("n_ok") > 0).alias("coverage"), share(F.col("n_correct") > 0).alias("oracle"))


def unique_correct(pool: DataFrame) -> DataFrame:
    """How often a source alone has the correct candidate of a question."""
    right = pool.filter("correct").groupBy("idx", "source").agg(F.count("*").alias("n"))
    alone = right.groupBy("idx").agg(F.count("*").alias("sources"), F.max("source").alias("source")).filter("sources = 1")
    return alone.groupBy("source").agg(F.count("*").alias("unique_correct"))


def repairs(pool: DataFrame) -> DataFrame:
    """Per source: repaired candidates, repairs that run, that are correct, and that mend a failed original."""
    done = pool.filter("repaired = 1")
    return done.groupBy("source").agg(
        F.count("*").alias("attempted"), F.count_if("ok").alias("repaired_ok"), F.count_if("correct").alias("repaired_correct"),
        share(F.col("ok")).alias("repair_rate"), F.count_if(F.col("ok") & ~F.col("original_ok")).alias("mended"))


def first_before_after(pool: DataFrame) -> DataFrame:
    """Per source, of the first candidate of each question: rates before repair, and after a repair that runs took the place of a failed original.

    Rates over no question are null.
    """
    first = first_by(pool.filter("repaired = 0"), ["idx", "source"], [F.col("ord"), F.col("pool_id")], ["candidate_index", "ok", "correct"])
    fixed = pool.filter("repaired = 1").groupBy("idx", "source", "candidate_index").agg(F.max("ok").alias("r_ok"), F.max(F.col("ok") & F.col("correct")).alias("r_right"))
    both = first.join(fixed, ["idx", "source", "candidate_index"], "left").na.fill(False, ["r_ok", "r_right"])
    after_ok, after_right = F.col("ok") | F.col("r_ok"), F.when(F.col("ok"), F.col("correct")).when(F.col("r_ok"), F.col("r_right")).otherwise(F.col("correct"))
    exact = lambda flag: F.round(F.try_divide(F.count_if(flag).cast("double"), F.count("*")), 6)
    return both.groupBy("source").agg(F.count("*").alias("questions"), exact(F.col("ok")).alias("exec_before"), exact(F.col("correct")).alias("accuracy_before"),
                                      exact(after_ok).alias("exec_after"), exact(after_right).alias("accuracy_after"))


def before_after(pool: DataFrame) -> DataFrame:
    """Per source and question: the best original, and with repairs that run or are right in its place."""
    per = pool.groupBy("source", "idx").agg(
        F.max(F.col("ok") & (F.col("repaired") == 0)).alias("b_ok"), F.max(F.col("correct") & (F.col("repaired") == 0)).alias("b_right"),
        F.max("ok").alias("a_ok"), F.max("correct").alias("a_right"))
    return per.groupBy("source").agg(
        F.count("*").alias("questions"), share(F.col("b_ok")).alias("exec_before"), share(F.col("a_ok")).alias("exec_after"),
        share(F.col("b_right")).alias("accuracy_before"), share(F.col("a_right")).alias("accuracy_after"))


def dialect_repairs(repair: DataFrame) -> DataFrame:
    """The MySQL stage, counted both ways: repairs added to what ran before, and either of the two."""
    ok = F.coalesce("mysql_exec_ok", F.lit(False))
    mended = F.coalesce("mysql_dialect_repair_exec_ok", F.lit(False))
    tried = F.coalesce("mysql_dialect_repair_attempted", F.lit(False))
    return repair.groupBy(F.coalesce("mysql_dialect_repair_stage", F.lit("(none)")).alias("stage")).agg(
        F.count("*").alias("total"), F.count_if(ok).alias("ok_before"), F.count_if(tried).alias("attempted"), F.count_if(tried & mended).alias("repaired"),
        rate(F.count_if(ok) + F.count_if(tried & mended), F.count("*")).alias("after_added"), share(ok | mended).alias("after_either"),
        F.coalesce(F.sum("mysql_dialect_repair_rounds_used"), F.lit(0)).alias("rounds"), F.round(F.avg("mysql_dialect_repair_rounds_used"), 6).alias("mean_rounds"))


def shape_classes(pool: DataFrame) -> DataFrame:
    """Candidates by what their result looks like."""
    kind = F.when(~F.col("ok"), "failed").when(F.col("key") == MISSING, "missing").when(is_empty(F.col("key")), "empty").otherwise("rows")
    return pool.groupBy("source", kind.alias("kind")).agg(F.count("*").alias("n"))


def switches(base: DataFrame, other: DataFrame) -> DataFrame:
    """A selector against another: same choice, gained and lost questions."""
    a, b = base.select("idx", F.col("pool_id").alias("a"), F.col("correct").alias("ca")), other.select("idx", F.col("pool_id").alias("b"), F.col("correct").alias("cb"))
    j = a.join(b, "idx")
    return j.agg(F.count("*").alias("questions"), F.count_if(F.col("a") != F.col("b")).alias("switched"),
                 F.count_if(~F.col("ca") & F.col("cb")).alias("gained"), F.count_if(F.col("ca") & ~F.col("cb")).alias("lost"))
