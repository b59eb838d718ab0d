"""Running candidate statements: each is planned and run by Spark, and its result stays there.

Of a result the driver sees a count and an order-free digest of the rows, two numbers that make equal bags
equal, however large they are. A statement that fails leaves its error condition. Only SELECT and WITH run.
"Backends" are sessions with other settings over the same views.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.equality import MISSING
from ..schemas import OUTCOME

# The settings of the profiles.
PROFILES: dict[str, dict[str, str]] = {
    "ansi": {"spark.sql.ansi.enabled": "true", "spark.sql.ansi.doubleQuotedIdentifiers": "false"},
    "lenient": {"spark.sql.ansi.enabled": "false", "spark.sql.ansi.doubleQuotedIdentifiers": "false"},
    "quoted_names": {"spark.sql.ansi.enabled": "true", "spark.sql.ansi.doubleQuotedIdentifiers": "true"},
}
#: Statements run at the same time; each is a Spark job of its own.
THREADS = 4


@dataclass(frozen=True)
class Outcome:
    ok: bool
    condition: str | None = None
    error: str | None = None
    n_rows: int | None = None
    key: str = MISSING
    latency_ms: float = 0.0


def readable(sql: str | None) -> bool:
    """Whether the text is one SELECT or WITH statement."""
    if not isinstance(sql, str):
        return False
    body = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S).strip().rstrip(";").strip()
    outside = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`", "", body)
    return bool(re.match(r"(?is)(select|with)\b", body)) and ";" not in outside


def digest(df: DataFrame) -> tuple[int, str]:
    """Rows and a key of the bag of rows: columns by position, cells as text, null as 'None'."""
    cells = [F.coalesce(F.col(f"`c{i}`").cast("string"), F.lit("None")) for i in range(len(df.columns))]
    row = F.concat_ws("\x1f", *cells) if cells else F.lit("")
    one = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).agg(
        F.count("*").alias("n"), F.sum(F.xxhash64(row).cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64(row, F.lit(1))).alias("b")).first()
    return one.n, "[]" if one.n == 0 else f"{one.n}:{one.a}:{one.b}"


def condition_of(e: Exception) -> str:
    """The error condition, for errors of the driver and of executors alike."""
    if isinstance(e, PySparkException) and (name := e.getCondition()):
        return name
    found = re.search(r"\[([A-Z][A-Z0-9_.]+)\]", str(e))
    return found.group(1) if found else type(e).__name__


def execute(spark: SparkSession, sql: str | None, timeout_s: float | None = None) -> Outcome:
    if not readable(sql):
        return Outcome(False, "EMPTY_OR_INVALID_SQL", "empty_or_invalid_sql")
    began = time.monotonic()
    took = lambda: round((time.monotonic() - began) * 1000, 3)
    tag = f"statement-{id(sql)}-{began}"
    timer = None
    try:
        if timeout_s:
            import threading

            spark.addTag(tag)
            timer = threading.Timer(timeout_s, lambda: spark.interruptTag(tag))
            timer.start()
        n, key = digest(spark.sql(sql.strip().rstrip(";")))
        return Outcome(True, n_rows=n, key=key, latency_ms=took())
    except Exception as e:  # noqa: BLE001  a guest statement may fail in any way
        return Outcome(False, condition_of(e), str(e).split("\n")[0][:500], latency_ms=took())
    finally:
        if timer is not None:
            timer.cancel()
            spark.removeTag(tag)


def profile(spark: SparkSession, name: str, views: dict[str, DataFrame] | None = None) -> SparkSession:
    """A session of its own with the settings of a profile and the given views."""
    session = spark.newSession()
    for key, value in PROFILES[name].items():
        session.conf.set(key, value)
    for view, df in (views or {}).items():
        df.createOrReplaceGlobalTempView(f"shared_{view}")  # temporary views belong to one session, global ones don't
        session.table(f"global_temp.shared_{view}").createOrReplaceTempView(view)
    return session


def validate(spark: SparkSession, candidates: Iterable[tuple[int, int, str, str | None]], run: Callable[[SparkSession, str | None], Outcome] = execute) -> DataFrame:
    """Outcomes of (idx, candidate_index, source, sql); each distinct statement runs once."""
    rows = list(candidates)
    texts = list(dict.fromkeys(sql for *_, sql in rows))
    with ThreadPoolExecutor(THREADS) as pool:
        done = dict(zip(texts, pool.map(lambda s: run(spark, s), texts)))
    return spark.createDataFrame(
        [(i, k, src, sql, o.ok, o.condition, o.error, o.n_rows, o.key, o.latency_ms) for i, k, src, sql in rows for o in [done[sql]]], OUTCOME)


def labelled(outcomes: DataFrame, gold: DataFrame) -> DataFrame:
    """Outcomes with ``correct``: the key equals that of the question's gold statement, which ran."""
    right = gold.filter("ok").select("idx", F.col("key").alias("gold_key"))
    return outcomes.join(right, "idx", "left").withColumn("correct", F.col("ok") & F.coalesce(F.col("key") == F.col("gold_key"), F.lit(False)))


def as_pool(outcomes: DataFrame) -> DataFrame:
    """Outcomes in the shape that the selectors take."""
    from ..operators.pool import source_rank

    return outcomes.select(
        "idx", F.monotonically_increasing_id().alias("arrival"), F.col("candidate_index").cast("bigint").alias("pool_id"), F.col("candidate_index").alias("ord"), "source",
        F.lit("original").alias("variant"), "sql", "ok", F.lit(False).alias("correct"), F.lit(False).alias("labeled"), "key", F.col("key").isin("[]", MISSING).alias("empty"),
        "latency_ms", F.col("latency_ms").alias("latency"), F.lit(-1e9).alias("score"), source_rank(F.col("source")).alias("rank"), F.lit(0).alias("repaired")).drop("arrival")
