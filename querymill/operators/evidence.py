"""Evidence of candidates on several backends: merging, selection by agreement, best repair, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sql_key
from .metrics import share
from .pool import first_by

# Stages from the most to the least original, backends in the order they are run.
STAGES = {"raw": 3, "normalize": 2, "llm_repair": 1}
BACKENDS = ("duckdb", "postgres", "mysql")


def _rank(c: Column, table: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, value in reversed(list(table.items())):
        out = F.when(c == name, value).otherwise(out)
    return out


def evidence(df: DataFrame) -> DataFrame:
    """Distinct evidence with one spelling of backends; rows without a question, backend or statement are left out."""
    backend = F.lower(F.trim("backend"))
    typed = df.filter("idx IS NOT NULL AND backend IS NOT NULL AND sql IS NOT NULL").select(
        "idx", backend.alias("backend"), F.coalesce("stage", F.lit("raw")).alias("stage"), "sql", F.coalesce("exec_ok", F.lit(False)).alias("ok"),
        F.coalesce("same_result", F.lit(False)).alias("same"), "result_key", "error")
    return typed.distinct().withColumns({
        "sql_key": sql_key(F.col("sql")), "stage_rank": _rank(F.col("stage"), STAGES, 0),
        "arrival": _rank(F.col("backend"), {b: i for i, b in enumerate(BACKENDS)}, 9) * 10 + (3 - _rank(F.col("stage"), STAGES, 0))})


def merged(ev: DataFrame) -> DataFrame:
    """One row per question and statement: on how many backends it agrees, runs, exists, and its best stage."""
    return ev.groupBy("idx", "sql_key").agg(
        F.count_distinct(F.when(F.col("same"), F.col("backend"))).alias("n_same"), F.count_distinct(F.when(F.col("ok"), F.col("backend"))).alias("n_ok"),
        F.count_distinct("backend").alias("n_backends"), F.max("stage_rank").alias("best_stage"), F.min("arrival").alias("arrival"),
        # the statement as the last evidence wrote it
        F.length(F.max_by("sql", F.struct("arrival", "sql"))).alias("length"))


def by_evidence(ev: DataFrame) -> DataFrame:
    """Per question the statement with most agreement, then most backends that run it, most original, shortest."""
    order = [-F.col("n_same"), -F.col("n_ok"), -F.col("n_backends"), -F.col("best_stage"), F.col("length"), F.col("arrival"), F.col("sql_key")]
    return first_by(merged(ev), ["idx"], order, ["sql_key", "n_same", "n_ok", "n_backends"])


def stage_mode(ev: DataFrame) -> DataFrame:
    """Per question the stage that most of the evidence of its selected statement has, then the more original, then the name."""
    chosen = by_evidence(ev).select("idx", "sql_key")
    votes = ev.join(chosen, ["idx", "sql_key"], "left_semi").groupBy("idx", "stage", "stage_rank").agg(F.count("*").alias("votes"))
    return first_by(votes, ["idx"], [-F.col("votes"), -F.col("stage_rank"), F.col("stage")], ["stage", "votes"])


def output_summary(ev: DataFrame) -> DataFrame:
    """(measure, value): how many selected statements agree and run, on any and on all three backends, and their evidence by stage."""
    chosen = by_evidence(ev)
    flags = {"total": F.lit(True), "has_same_result": F.col("n_same") > 0, "has_exec_ok": F.col("n_ok") > 0, "all_three_same_result": F.col("n_same") == 3, "all_three_exec_ok": F.col("n_ok") == 3}
    counted = chosen.agg(*[F.count_if(c).alias(n) for n, c in flags.items()])
    stages = ev.join(chosen.select("idx", "sql_key"), ["idx", "sql_key"], "left_semi").groupBy("stage").agg(F.count("*").alias("value"))
    long = counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("value")) for n in flags])).alias("x")).select("x.*")
    return long.unionByName(stages.select(F.concat(F.lit("stage:"), "stage").alias("measure"), "value"))


def long_evidence(wide: DataFrame, backend: str = "mysql", prefix: str = "mysql_") -> DataFrame:
    """Evidence of a backend's wide rows: the raw run, the normalised statement if one was used, the model's repair if one was attempted.

    The raw statement is the backend's own, or the selected one where it has none.
    """
    c = lambda name: F.col(f"{prefix}{name}")
    stage = c("dialect_repair_stage")
    row = lambda name, sql, ok, same, error, used: F.when(used, F.struct(
        F.lit(name).alias("stage"), sql.alias("sql"), F.coalesce(ok, F.lit(False)).alias("exec_ok"), F.coalesce(same, F.lit(False)).alias("same_result"), error.alias("error")))
    repaired = lambda name, used: row(name, c("dialect_repair_sql"), c("dialect_repair_exec_ok"), c("dialect_repair_exec_ok"), c("dialect_repair_error"), used)
    rows = F.array(
        row("raw", F.coalesce(c("sql"), F.col("selected_sql")), c("exec_ok"), c("crossdb_same_result"), c("exec_error"), F.lit(True)),
        repaired("normalize", F.coalesce(stage == "normalize", F.lit(False))),
        repaired("llm_repair", F.coalesce((stage == "llm") & c("dialect_repair_attempted"), F.lit(False))))
    long = wide.filter("idx IS NOT NULL").select("repair_id", "idx", F.lit(backend).alias("backend"), F.explode(rows).alias("x")).filter("x IS NOT NULL")
    return long.select("repair_id", "idx", "backend", "x.*").filter("sql IS NOT NULL")


def dialect_stage(wide: DataFrame, budget: int) -> DataFrame:
    """(repair_id, due): pass where the raw run gave the same result, normalize where that mended it, else a model's turn while the budget lasts, by identifier."""
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    normalised = F.coalesce(F.col("mysql_dialect_repair_stage") == "normalize", F.lit(False)) & flag("mysql_dialect_repair_exec_ok")
    staged = wide.filter("repair_id IS NOT NULL").select("repair_id", F.when(flag("mysql_exec_ok") & flag("mysql_crossdb_same_result"), "pass").when(normalised, "normalize").otherwise("llm").alias("due"))
    within = staged.filter("due = 'llm'").select("repair_id").orderBy("repair_id").limit(budget).withColumn("within", F.lit(True))  # the budget is the feature
    return staged.join(within, "repair_id", "left").select(
        "repair_id", F.when((F.col("due") == "llm") & F.col("within").isNull(), "over_budget").otherwise(F.col("due")).alias("due"))


def base_row(ev: DataFrame) -> DataFrame:
    """(idx, backend, sql): the raw statement of the first backend, in their order, that has one."""
    return first_by(ev.filter("stage = 'raw'"), ["idx"], [F.col("arrival"), F.col("backend"), F.col("sql")], ["backend", "sql"])


def mismatch_hint(target: Column, candidate: Column, rows: int = 3) -> Column:
    """What a repair is told of two results: their numbers of rows and first rows in normal order."""
    from ..functions.equality import normal_rows

    part = lambda c: F.coalesce(normal_rows(c), F.array().cast("array<array<string>>"))
    text = lambda c: F.concat(F.size(part(c)).cast("string"), F.lit(", sample="), F.to_json(F.slice(part(c), 1, rows)))
    return F.concat(F.lit("target rows="), text(target), F.lit("; candidate rows="), text(candidate))


def portability(ev: DataFrame) -> DataFrame:
    """Per question: runs on all backends, same result on all, raw and with the later stages."""
    flags = {f"{name}_{what}": F.count_distinct(F.when(cond & F.col(what), F.col("backend")))
             for name, cond in (("raw", F.col("stage") == "raw"), ("any", F.lit(True))) for what in ("ok", "same")}
    per = ev.groupBy("idx").agg(*[c.alias(n) for n, c in flags.items()], F.count_distinct("backend").alias("n_backends"))
    return per.select("idx", "n_backends", *[(F.col(n) == F.col("n_backends")).alias(f"{n}_everywhere") for n in flags])


def backend_summary(ev: DataFrame) -> DataFrame:
    """Per backend over questions: raw rates, and rates after any stage."""
    raw = F.col("stage") == "raw"
    per = ev.groupBy("backend", "idx").agg(F.max(raw & F.col("ok")).alias("r_ok"), F.max(raw & F.col("same")).alias("r_same"),
                                           F.max("ok").alias("a_ok"), F.max("same").alias("a_same"))
    return per.groupBy("backend").agg(F.count("*").alias("questions"), *[share(F.col(c)).alias(n) for c, n in (
        ("r_ok", "exec_raw"), ("a_ok", "exec_after"), ("r_same", "same_raw"), ("a_same", "same_after"))])


def agreement(ev: DataFrame) -> DataFrame:
    """How many selected statements agree on at least one, two, all three backends."""
    return by_evidence(ev).agg(F.count("*").alias("questions"), *[share(F.col("n_same") >= k).alias(f"same_on_{k}") for k in (1, 2, 3)],
                               F.sum("n_same").alias("votes"))


def error_classes(ev: DataFrame) -> DataFrame:
    """Failed evidence by backend, stage and the error's words without names and numbers."""
    text = F.regexp_replace(F.lower(F.coalesce("error", F.lit("(none)"))), r"'[^']*'|[a-z]+_[a-z_]+|[0-9]+", "?")
    return ev.filter("NOT ok").groupBy("backend", "stage", F.regexp_replace(text, r"[^a-z?() ]+", " ").alias("kind")).agg(F.count("*").alias("n"))


def best_repair(repair: DataFrame) -> DataFrame:
    """Per question the best pass of the repair stage: same result, runs, fewest rounds, first logged."""
    typed = repair.filter("idx IS NOT NULL").select(
        "idx", "repair_id", F.coalesce("mysql_crossdb_same_result", F.lit(False)).alias("same"),
        (F.coalesce("mysql_exec_ok", F.lit(False)) | F.coalesce("mysql_dialect_repair_exec_ok", F.lit(False))).alias("ok"),
        F.coalesce("mysql_dialect_repair_rounds_used", F.lit(0)).alias("rounds"))
    return first_by(typed, ["idx"], [~F.col("same"), ~F.col("ok"), F.col("rounds"), F.col("repair_id")], ["repair_id", "same", "ok", "rounds"])


def within_budget(repair: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` repairs of the stage that need a model, by identifier; a limit that is the feature."""
    due = repair.filter(F.coalesce("mysql_dialect_repair_attempted", F.lit(False)) & (F.col("mysql_dialect_repair_stage") == "llm"))
    return due.orderBy("repair_id").limit(budget).select("repair_id", "idx")




def first_success(ev: DataFrame) -> DataFrame:
    """Per question and backend the first stage that ran, else the last one tried."""
    last_first = F.when(F.col("ok"), -F.col("stage_rank")).otherwise(F.col("stage_rank"))
    return first_by(ev, ["idx", "backend"], [~F.col("ok"), last_first, F.col("sql_key"), F.col("stage")], ["stage", "ok"])


def support_histogram(ev: DataFrame) -> DataFrame:
    """How many questions have their selected statement agreed on by how many backends."""
    return by_evidence(ev).groupBy("n_same").agg(F.count("*").alias("questions"), F.sum("n_ok").alias("runs"))
