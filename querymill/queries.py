"""Registered queries of the core and the SQL that states them for another engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import equality as EQ
from .functions import text as TX
from .operators import catalog as C
from .operators import evidence as E
from .operators import metrics as M
from .operators import pairs as PR
from .operators import pool as P
from .operators import ranker as RK
from .operators import retrieval as R
from .operators import scoring as SC
from .operators import select as S
from .operators import stats as ST
from .plans import validate as V
from .plans.engine import Engine
from .runtime import cut, shared_folder
from .sources import files as FI
from .streaming import ingest as ST_IN

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def pool_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.candidate_pool(read(spark, sf_dir, "candidate_pool"))


#: The pool for the other engine.
POOL = """
WITH base AS (
  SELECT idx, pool_id, COALESCE(ord, 0) AS ord, COALESCE(source, 'unknown') AS source, COALESCE(variant, 'original') AS variant, sql, result,
    COALESCE(exec_ok, FALSE) AS ok, COALESCE(exec_correct, FALSE) AS correct, COALESCE(label_available, FALSE) AS labeled,
    latency_ms, COALESCE(latency_ms, 999999) AS latency, COALESCE(repair_available, FALSE) AS repair_available,
    COALESCE(repair_exec_ok, FALSE) AS repair_ok, COALESCE(original_exec_ok, FALSE) AS original_ok,
    CASE WHEN score IS NULL OR isnan(score) THEN -1e9 ELSE score END AS score,
    CASE WHEN result IS NULL THEN 'NULL_RESULT' ELSE CAST(to_json(list_sort(list_transform(CAST(from_json(result, '[["VARCHAR"]]') AS VARCHAR[][]),
      lambda r: list_transform(r, lambda c: COALESCE(c, 'None'))))) AS VARCHAR) END AS key,
    CASE source WHEN 'embedrag' THEN 1 WHEN 'bm25rag' THEN 2 WHEN 'lora_rag' THEN 3 WHEN 'loraonly_ep3' THEN 4 WHEN 'promptonly' THEN 5 ELSE 999 END AS rank,
    CASE WHEN variant = 'strong_repair' THEN 1 ELSE 0 END AS repaired
  FROM candidate_pool WHERE idx IS NOT NULL),
pool AS (
  SELECT *, key IN ('[]', 'NULL_RESULT') AS empty,
    CASE WHEN ok AND key <> 'NULL_RESULT' THEN COUNT(*) FILTER (ok) OVER (PARTITION BY idx, key) ELSE 0 END AS support,
    CASE WHEN ok THEN COUNT(*) FILTER (ok) OVER (PARTITION BY idx, key) ELSE 0 END AS votes,
    MAX(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY idx) AS any_ok
  FROM base)
"""


def _choice(order: str, where: str = "TRUE") -> str:
    return POOL + f"""
SELECT idx, pool_id, source, variant, ok, correct FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY idx ORDER BY {order}, ord, pool_id) AS place FROM pool WHERE {where}) t WHERE place = 1"""


def _voted(inner: str, nonempty: bool = True) -> str:
    """Results ranked by votes, emptiness and their best candidate; then that candidate."""
    empty = "CASE WHEN ok AND empty THEN 1 ELSE 0 END" if nonempty else "0"
    return POOL + f""", inside AS (
  SELECT *, CASE WHEN ok THEN key ELSE chr(0) END AS grp,
    ROW_NUMBER() OVER (PARTITION BY idx, CASE WHEN ok THEN key ELSE chr(0) END ORDER BY {inner}, ord, pool_id) AS place FROM pool),
 outside AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY idx ORDER BY CASE WHEN ok THEN 0 ELSE 1 END, -votes, {empty}, {inner}, ord, pool_id) AS top FROM inside WHERE place = 1)
SELECT idx, pool_id, source, variant, ok, correct FROM outside WHERE top = 1"""


def _selector(name: str, sql: str | None) -> None:
    def run(spark: SparkSession, sf_dir: str, f: Callable[[DataFrame], DataFrame] = S.SELECTORS[name]) -> DataFrame:
        return f(pool_of(spark, sf_dir))

    run.__name__ = f"select_{name}"
    query(sql)(run)


_OK = "CASE WHEN ok THEN 0 ELSE 1 END"
_LATENCY = "CASE WHEN ok THEN latency ELSE 0 END"
_selector("rule_priority", _choice(f"{_OK}, rank"))
_selector("repaired_last", _choice(f"{_OK}, repaired, rank"))
_selector("oracle_repaired", _choice(f"{_OK}, CASE WHEN correct THEN 0 ELSE 1 END, repaired, rank"))
_selector("by_score", _choice("-score, CASE source WHEN 'embedrag' THEN 0 WHEN 'bm25rag' THEN 1 WHEN 'lora_rag' THEN 2 WHEN 'promptonly' THEN 3 WHEN 'loraonly_ep3' THEN 4 ELSE 999 END, repaired"))
_selector("fixed_model", _choice(f"CASE WHEN source = 'embedrag' THEN 0 ELSE 1 END, CASE WHEN source = 'embedrag' THEN 0 ELSE {_OK} END, CASE WHEN source = 'embedrag' THEN 0 ELSE rank END"))
_selector("oracle_model", _choice("CASE WHEN correct THEN 0 WHEN ok THEN 1 ELSE 2 END, rank"))
_selector("priority_with_variant", _choice(f"{_OK}, rank, repaired"))
_selector("semantic_score", _choice(f"{_OK}, -score, rank, repaired"))
_selector("vote", _voted("rank", nonempty=False))
_selector("practical", _voted(f"rank, repaired, {_LATENCY}"))
_selector("consensus_model", _voted(f"rank, {_LATENCY}"))
_selector("consensus", _voted("rank, repaired"))
_selector("oracle_consensus", _voted("rank, repaired").replace("SELECT idx, pool_id, source, variant, ok, correct FROM outside WHERE top = 1", """, chosen AS (SELECT 1 AS p, idx, pool_id, source, variant, ok, correct FROM outside WHERE top = 1
  UNION ALL SELECT 0, idx, pool_id, source, variant, ok, correct FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY idx ORDER BY rank, repaired, ord, pool_id) AS r FROM pool WHERE labeled AND correct) q WHERE r = 1)
SELECT idx, pool_id, source, variant, ok, correct FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY idx ORDER BY p) AS r FROM chosen) c WHERE r = 1"""))
_selector("hybrid", _voted("rank, repaired").replace("SELECT idx, pool_id, source, variant, ok, correct FROM outside WHERE top = 1", f""", b AS (SELECT * FROM outside WHERE top = 1),
 o AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY idx ORDER BY {_OK}, -score, rank, repaired, ord, pool_id) AS r FROM pool) q WHERE r = 1)
SELECT b.idx, CASE WHEN o.score >= b.score + 0.25 THEN o.pool_id ELSE b.pool_id END AS pool_id, CASE WHEN o.score >= b.score + 0.25 THEN o.source ELSE b.source END AS source,
  CASE WHEN o.score >= b.score + 0.25 THEN o.variant ELSE b.variant END AS variant, CASE WHEN o.score >= b.score + 0.25 THEN o.ok ELSE b.ok END AS ok,
  CASE WHEN o.score >= b.score + 0.25 THEN o.correct ELSE b.correct END AS correct
FROM b JOIN o ON b.idx = o.idx"""))
_FULL = "ok AND NOT empty"
_selector("conservative_switch", POOL + f""", g AS (SELECT *, COUNT(*) FILTER (ok AND source <> 'embedrag') OVER (PARTITION BY idx, key) AS others FROM pool),
 c AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY idx ORDER BY {_OK}, -votes, CASE WHEN ok AND empty THEN 1 ELSE 0 END, rank, ord, pool_id) AS any_place,
    ROW_NUMBER() OVER (PARTITION BY idx ORDER BY CASE WHEN {_FULL} THEN 0 ELSE 1 END, -votes, rank, ord, pool_id) AS full_place,
    ROW_NUMBER() OVER (PARTITION BY idx ORDER BY CASE WHEN {_FULL} AND source <> 'embedrag' AND others >= 2 THEN 0 ELSE 1 END, -votes, rank, ord, pool_id) AS agreed_place,
    ROW_NUMBER() OVER (PARTITION BY idx ORDER BY CASE WHEN source = 'embedrag' THEN 0 ELSE 1 END, ord, pool_id) AS default_place FROM g),
 q AS (SELECT idx, MAX(any_ok) AS any_ok, BOOL_OR(source = 'embedrag') AS has_default, BOOL_OR(source = 'embedrag' AND default_place = 1 AND ok) AS d_ok,
    MAX(CASE WHEN default_place = 1 THEN votes END) AS d_votes, BOOL_OR(default_place = 1 AND empty) AS d_empty, MAX(CASE WHEN {_FULL} THEN votes END) AS full_votes,
    BOOL_OR({_FULL}) AS has_full, BOOL_OR({_FULL} AND source <> 'embedrag' AND others >= 2) AS has_agreed FROM c GROUP BY idx),
 d AS (SELECT *, CASE WHEN any_ok = 0 AND has_default THEN 'default' WHEN any_ok = 0 OR NOT has_default OR NOT d_ok THEN 'any' WHEN d_votes >= 2 AND NOT d_empty THEN 'default'
    WHEN COALESCE(full_votes, 0) >= 3 OR (d_empty AND has_full) THEN 'full' WHEN d_votes = 1 AND has_agreed THEN 'agreed' ELSE 'default' END AS way FROM q)
SELECT c.idx, pool_id, source, variant, ok, correct FROM c JOIN d ON c.idx = d.idx
WHERE (way = 'any' AND any_place = 1) OR (way = 'full' AND full_place = 1) OR (way = 'agreed' AND agreed_place = 1) OR (way = 'default' AND default_place = 1)""")


@query(POOL + "SELECT idx, pool_id, support FROM pool")
def pool_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_support(pool_of(spark, sf_dir)).select("idx", "pool_id", "support")


@query(POOL + "SELECT idx, pool_id FROM pool WHERE ok OR any_ok = 0")
def pool_executable_or_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.executable_or_all(pool_of(spark, sf_dir)).select("idx", "pool_id")


@query(POOL + """SELECT idx, pool_id, support, CASE WHEN n_ok > 0 THEN ROUND(CAST(support AS DOUBLE) / n_ok, 6) ELSE 0 END AS support_share
FROM (SELECT *, COUNT(*) FILTER (ok) OVER (PARTITION BY idx) AS n_ok FROM pool) t""")
def pool_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.enriched(pool_of(spark, sf_dir)).select("idx", "pool_id", "support", "support_share")


@query(POOL + """SELECT idx, pool_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY idx, source, variant, COALESCE(sql, '') ORDER BY ord, pool_id) AS r FROM pool) t WHERE r = 1""")
def pool_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.distinct_candidates(pool_of(spark, sf_dir))


@query(POOL + """SELECT idx, pool_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY idx, LOWER(TRIM(COALESCE(sql, ''), ' ')) ORDER BY ord, pool_id) AS r FROM pool) t WHERE r = 1""")
def pool_distinct_lowered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.distinct_candidates(pool_of(spark, sf_dir), lowered=True)


@query(POOL + """SELECT idx, pool_id, CASE WHEN NOT ok THEN 'execution_error' WHEN key = 'NULL_RESULT' THEN 'no_result' WHEN empty THEN 'empty_result' ELSE 'check_literals' END AS signal
FROM pool WHERE NOT ok OR empty OR regexp_matches(COALESCE(sql, ''), '''[^'']*''|"[^"]*"')""")
def repair_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = pool_of(spark, sf_dir)
    return pool.filter(P.needs_repair(pool)).select("idx", "pool_id", P.repair_signal().alias("signal"))


_ALT = _voted("rank, repaired").replace("SELECT idx, pool_id, source, variant, ok, correct FROM outside WHERE top = 1", """, b AS (SELECT * FROM outside WHERE top = 1),
 alt AS (SELECT * FROM (SELECT p.idx, p.pool_id, p.score, b.pool_id AS base_id, b.score AS base_score,
   ROW_NUMBER() OVER (PARTITION BY p.idx ORDER BY -p.support, CASE WHEN p.empty THEN 1 ELSE 0 END, p.rank, p.repaired, p.ord, p.pool_id) AS place
   FROM pool p JOIN b ON p.idx = b.idx WHERE p.ok AND TRIM(COALESCE(p.sql, ''), ' ') <> '' AND (p.key <> b.key OR p.sql IS DISTINCT FROM b.sql)) t WHERE place <= 3)
""")


@query(_ALT + "SELECT idx, CAST(place AS INTEGER) AS place, pool_id, score, base_id, base_score FROM alt")
def top_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.alternatives(pool_of(spark, sf_dir))


@query(_ALT + """, take AS (SELECT *, score > base_score AND LEAST(1.0, 0.5 + ABS(score - base_score) / 50) >= 0.72 AND score / 10 >= base_score / 10 + 1.0 AS good FROM alt)
SELECT idx, COALESCE(arg_max(pool_id, place) FILTER (good), MIN(base_id)) AS pool_id, CAST(COUNT(*) FILTER (good) AS INTEGER) AS switches FROM take GROUP BY idx""")
def pairwise_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.corrected(S.judged_by_score(pool_of(spark, sf_dir)))


# --- metrics

_RATE = "ROUND(COALESCE(CAST({} AS DOUBLE) / NULLIF({}, 0), 0), 6)"


def _rate(part: str, whole: str = "COUNT(*)") -> str:
    return _RATE.format(part, whole)


def _share(flag: str) -> str:
    return _rate(f"COUNT(*) FILTER ({flag})")


@query(POOL + f"SELECT source, COUNT(*) AS total, COUNT(*) FILTER (ok) AS exec_ok, COUNT(*) FILTER (correct) AS correct, {_share('ok')} AS exec_rate, {_share('correct')} AS accuracy, ROUND(AVG(latency_ms), 4) AS mean_latency_ms FROM pool GROUP BY source")
def metrics_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.by_source(pool_of(spark, sf_dir)).orderBy("source")


@query(POOL + f"SELECT COUNT(*) AS questions, CAST(SUM(n) AS BIGINT) AS candidates, {_share('o')} AS exec_coverage, {_share('c')} AS oracle_accuracy, COUNT(*) FILTER (NOT o) AS all_failed FROM (SELECT idx, BOOL_OR(ok) AS o, BOOL_OR(correct) AS c, COUNT(*) AS n FROM pool GROUP BY idx) t")
def metrics_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.coverage(pool_of(spark, sf_dir))


@query(POOL + f"SELECT COALESCE(source, '(all)') AS source, CAST(COUNT(*) AS BIGINT) AS total, {_share('ok')} AS exec_rate, {_share('correct')} AS accuracy FROM pool GROUP BY ROLLUP(source)")
def metrics_source_and_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.source_and_all(pool_of(spark, sf_dir))


@query(f"SELECT COUNT(*) AS questions, {_share('s.ok')} AS exec_rate, {_share('s.correct')} AS accuracy, " + _share("s.variant IN ('repair', 'strong_repair')") +
       f" AS repair_share, COUNT(*) FILTER (s.variant IN ('repair', 'strong_repair')) AS repairs, ROUND(COALESCE(AVG(p.latency_ms), 0), 4) AS mean_latency_ms FROM ({SQL['select_practical']}) s JOIN candidate_pool p ON p.pool_id = s.pool_id")
def metrics_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = pool_of(spark, sf_dir)
    return M.selected(M.with_latency(S.practical(pool), pool))


@query(f"SELECT source, COUNT(*) AS n, COUNT(*) FILTER (correct) AS n_correct FROM ({SQL['select_practical']}) s GROUP BY source")
def metrics_selected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.histogram(S.practical(pool_of(spark, sf_dir)), "source")


@query(f"WITH s AS ({SQL['select_consensus']}), p AS (SELECT idx, BOOL_OR(COALESCE(label_available, FALSE)) AS l, BOOL_OR(COALESCE(exec_ok, FALSE) AND COALESCE(exec_correct, FALSE)) AS r, BOOL_OR(COALESCE(exec_ok, FALSE) AND COALESCE(label_available, FALSE) AND NOT COALESCE(exec_correct, FALSE)) AS w FROM candidate_pool GROUP BY idx), "
       f"j AS (SELECT s.correct, r AND w AS hard FROM s JOIN p ON s.idx = p.idx WHERE l) SELECT COUNT(*) AS labeled, COUNT(*) FILTER (correct) AS labeled_correct, COUNT(*) FILTER (hard) AS hard, COUNT(*) FILTER (hard AND correct) AS hard_correct, {_share('correct')} AS accuracy, {_rate('COUNT(*) FILTER (hard AND correct)', 'COUNT(*) FILTER (hard)')} AS hard_accuracy FROM j")
def metrics_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = pool_of(spark, sf_dir)
    return M.labeled(S.consensus(pool), pool)


SUBSETS = {
    "all": ("embedrag", "bm25rag", "lora_rag", "loraonly_ep3", "promptonly"), "retrieval": ("embedrag", "bm25rag"), "tuned": ("lora_rag", "loraonly_ep3"),
    "without_embedrag": ("bm25rag", "lora_rag", "loraonly_ep3", "promptonly"), "without_tuned": ("embedrag", "bm25rag", "promptonly"),
    "embedrag": ("embedrag",), "prompt_and_bm25": ("promptonly", "bm25rag"),
}
_SUBSETS = " UNION ALL ".join(f"SELECT '{n}' AS subset, '{s}' AS src" for n, ss in SUBSETS.items() for s in ss)


@query(POOL + f", sub AS ({_SUBSETS}), per AS (SELECT subset, idx, COUNT(*) AS n, COUNT(*) FILTER (ok) AS n_ok, COUNT(*) FILTER (correct) AS n_correct FROM pool JOIN sub ON src = source GROUP BY subset, idx) "
       f"SELECT subset, COUNT(*) AS questions, {_rate('SUM(n_ok)', 'SUM(n)')} AS exec_rate, {_rate('SUM(n_correct)', 'SUM(n)')} AS accuracy, {_share('n_ok > 0')} AS coverage, {_share('n_correct > 0')} AS oracle FROM per GROUP BY subset")
def metrics_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.subsets(pool_of(spark, sf_dir), SUBSETS)


@query(POOL + "SELECT source, COUNT(*) AS unique_correct FROM (SELECT idx, MAX(source) AS source FROM pool WHERE correct GROUP BY idx HAVING COUNT(DISTINCT source) = 1) t GROUP BY source")
def metrics_unique_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.unique_correct(pool_of(spark, sf_dir))


@query(POOL + f"SELECT source, COUNT(*) AS attempted, COUNT(*) FILTER (ok) AS repaired_ok, COUNT(*) FILTER (correct) AS repaired_correct, {_share('ok')} AS repair_rate, COUNT(*) FILTER (ok AND NOT original_ok) AS mended FROM pool WHERE repaired = 1 GROUP BY source")
def metrics_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.repairs(pool_of(spark, sf_dir))


@query(POOL + f"SELECT source, COUNT(*) AS questions, {_share('b_ok')} AS exec_before, {_share('a_ok')} AS exec_after, {_share('b_right')} AS accuracy_before, {_share('a_right')} AS accuracy_after FROM (SELECT source, idx, BOOL_OR(ok AND repaired = 0) AS b_ok, BOOL_OR(correct AND repaired = 0) AS b_right, BOOL_OR(ok) AS a_ok, BOOL_OR(correct) AS a_right FROM pool GROUP BY source, idx) t GROUP BY source")
def metrics_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.before_after(pool_of(spark, sf_dir))


_MOK, _MREP, _MTRY = "COALESCE(mysql_exec_ok, FALSE)", "COALESCE(mysql_dialect_repair_exec_ok, FALSE)", "COALESCE(mysql_dialect_repair_attempted, FALSE)"


@query(f"SELECT COALESCE(mysql_dialect_repair_stage, '(none)') AS stage, COUNT(*) AS total, COUNT(*) FILTER ({_MOK}) AS ok_before, COUNT(*) FILTER ({_MTRY}) AS attempted, COUNT(*) FILTER ({_MTRY} AND {_MREP}) AS repaired, "
       f"{_rate(f'(COUNT(*) FILTER ({_MOK}) + COUNT(*) FILTER ({_MTRY} AND {_MREP}))')} AS after_added, {_share(f'{_MOK} OR {_MREP}')} AS after_either, CAST(COALESCE(SUM(mysql_dialect_repair_rounds_used), 0) AS BIGINT) AS rounds, ROUND(AVG(mysql_dialect_repair_rounds_used), 6) AS mean_rounds FROM mysql_repair GROUP BY 1")
def metrics_dialect_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.dialect_repairs(read(spark, sf_dir, "mysql_repair"))


@query(POOL + "SELECT source, CASE WHEN NOT ok THEN 'failed' WHEN key = 'NULL_RESULT' THEN 'missing' WHEN empty THEN 'empty' ELSE 'rows' END AS kind, COUNT(*) AS n FROM pool GROUP BY 1, 2")
def metrics_result_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.shape_classes(pool_of(spark, sf_dir))


@query(f"WITH a AS ({SQL['select_rule_priority']}), b AS ({SQL['select_conservative_switch']}) SELECT COUNT(*) AS questions, COUNT(*) FILTER (a.pool_id <> b.pool_id) AS switched, COUNT(*) FILTER (NOT a.correct AND b.correct) AS gained, COUNT(*) FILTER (a.correct AND NOT b.correct) AS lost FROM a JOIN b ON a.idx = b.idx")
def metrics_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = pool_of(spark, sf_dir)
    return M.switches(S.rule_priority(pool), S.conservative_switch(pool))


# --- evidence

EVIDENCE = """
WITH ev AS (SELECT DISTINCT idx, LOWER(TRIM(backend, ' ')) AS backend, COALESCE(stage, 'raw') AS stage, sql, COALESCE(exec_ok, FALSE) AS ok, COALESCE(same_result, FALSE) AS same, result_key, error,
    LOWER(regexp_replace(TRIM(regexp_replace(sql, '\\s+', ' ', 'g'), ' '), '[; ]+$', '')) AS sql_key,
    CASE stage WHEN 'normalize' THEN 2 WHEN 'llm_repair' THEN 1 WHEN 'raw' THEN 3 ELSE CASE WHEN stage IS NULL THEN 3 ELSE 0 END END AS stage_rank
  FROM evidence WHERE idx IS NOT NULL AND backend IS NOT NULL AND sql IS NOT NULL),
 came AS (SELECT *, CASE backend WHEN 'duckdb' THEN 0 WHEN 'postgres' THEN 10 WHEN 'mysql' THEN 20 ELSE 90 END + 3 - stage_rank AS arrival FROM ev),
 merged AS (SELECT idx, sql_key, COUNT(DISTINCT CASE WHEN same THEN backend END) AS n_same, COUNT(DISTINCT CASE WHEN ok THEN backend END) AS n_ok, COUNT(DISTINCT backend) AS n_backends,
    MAX(stage_rank) AS best_stage, MIN(arrival) AS arrival, LENGTH(arg_max(sql, ROW(arrival, sql))) AS written FROM came GROUP BY idx, sql_key),
 chosen AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY idx ORDER BY n_same DESC, n_ok DESC, n_backends DESC, best_stage DESC, written, arrival, sql_key) AS r FROM merged) t WHERE r = 1)
"""


def evidence_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.evidence(read(spark, sf_dir, "evidence"))


@query(EVIDENCE + "SELECT idx, sql_key, n_same, n_ok, n_backends FROM merged")
def evidence_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.merged(evidence_of(spark, sf_dir)).select("idx", "sql_key", "n_same", "n_ok", "n_backends")


@query(EVIDENCE + "SELECT idx, sql_key, n_same, n_ok, n_backends FROM chosen")
def evidence_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.by_evidence(evidence_of(spark, sf_dir))


@query(EVIDENCE + "SELECT idx, stage, votes FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY idx ORDER BY votes DESC, stage_rank DESC, stage) AS r FROM (SELECT ev.idx, stage, stage_rank, COUNT(*) AS votes FROM ev JOIN chosen c ON c.idx = ev.idx AND c.sql_key = ev.sql_key GROUP BY ev.idx, stage, stage_rank) v) t WHERE r = 1")
def evidence_stage_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.stage_mode(evidence_of(spark, sf_dir))


@query(EVIDENCE + "SELECT idx, n AS n_backends, " + ", ".join(f"COUNT(DISTINCT CASE WHEN {c} AND {w} THEN backend END) = n AS {a}_{w}_everywhere" for a, c in (("raw", "stage = 'raw'"), ("any", "TRUE")) for w in ("ok", "same")) + " FROM (SELECT ev.*, n FROM ev JOIN (SELECT idx AS i, COUNT(DISTINCT backend) AS n FROM ev GROUP BY idx) c ON i = idx) t GROUP BY idx, n")
def evidence_portability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.portability(evidence_of(spark, sf_dir))


@query(EVIDENCE + f"SELECT backend, COUNT(*) AS questions, {_share('r_ok')} AS exec_raw, {_share('a_ok')} AS exec_after, {_share('r_same')} AS same_raw, {_share('a_same')} AS same_after FROM (SELECT backend, idx, BOOL_OR(stage = 'raw' AND ok) AS r_ok, BOOL_OR(stage = 'raw' AND same) AS r_same, BOOL_OR(ok) AS a_ok, BOOL_OR(same) AS a_same FROM ev GROUP BY backend, idx) t GROUP BY backend")
def evidence_backend_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.backend_summary(evidence_of(spark, sf_dir))


@query(EVIDENCE + f"SELECT COUNT(*) AS questions, {_share('n_same >= 1')} AS same_on_1, {_share('n_same >= 2')} AS same_on_2, {_share('n_same >= 3')} AS same_on_3, CAST(SUM(n_same) AS BIGINT) AS votes FROM chosen")
def evidence_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.agreement(evidence_of(spark, sf_dir))


@query(EVIDENCE + "SELECT backend, stage, regexp_replace(regexp_replace(LOWER(COALESCE(error, '(none)')), '''[^'']*''|[a-z]+_[a-z_]+|[0-9]+', '?', 'g'), '[^a-z?() ]+', ' ', 'g') AS kind, COUNT(*) AS n FROM ev WHERE NOT ok GROUP BY 1, 2, 3")
def evidence_error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.error_classes(evidence_of(spark, sf_dir))


@query(f"SELECT idx, repair_id, same, ok, rounds FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY idx ORDER BY CASE WHEN same THEN 0 ELSE 1 END, CASE WHEN ok THEN 0 ELSE 1 END, rounds, repair_id) AS r FROM (SELECT idx, repair_id, COALESCE(mysql_crossdb_same_result, FALSE) AS same, {_MOK} OR {_MREP} AS ok, COALESCE(mysql_dialect_repair_rounds_used, 0) AS rounds FROM mysql_repair WHERE idx IS NOT NULL) t) s WHERE r = 1")
def repair_best_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.best_repair(read(spark, sf_dir, "mysql_repair"))


@query(f"SELECT repair_id, idx FROM mysql_repair WHERE {_MTRY} AND mysql_dialect_repair_stage = 'llm' ORDER BY repair_id LIMIT 100")
def repair_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.within_budget(read(spark, sf_dir, "mysql_repair"), 100)


# --- paired statistics

_PAIRED = POOL + ", o AS (SELECT idx, BOOL_OR(correct) FILTER (source = 'embedrag') AS a, BOOL_OR(correct) FILTER (source = 'bm25rag') AS b FROM pool WHERE repaired = 0 GROUP BY idx), q AS (SELECT * FROM o WHERE a IS NOT NULL AND b IS NOT NULL)"


@query(_PAIRED + ", c AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (a AND b) AS \"both\", COUNT(*) FILTER (a AND NOT b) AS only_a, COUNT(*) FILTER (NOT a AND b) AS only_b, COUNT(*) FILTER (NOT a AND NOT b) AS neither FROM q) "
       "SELECT *, ROUND(COALESCE(POWER(ABS(only_a - only_b) - 1, 2) / NULLIF(only_a + only_b, 0), 0), 6) AS chi2 FROM c")
def stats_discordant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.discordant(ST.paired_outcomes(pool_of(spark, sf_dir), "embedrag", "bm25rag"))


@query()
def stats_paired_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.paired_report(ST.paired_outcomes(pool_of(spark, sf_dir), "embedrag", "bm25rag"))


# --- rule scores


# The rules for the other engine, with patterns of their own: name, when it applies, what it adds.

def _asks(pattern: str) -> str:
    return f"regexp_matches(q, '{pattern}')"


def _has(pattern: str) -> str:
    return f"regexp_matches(s, '{pattern}')"


def _sign(good: str, plus: float, minus: float) -> str:
    return f"CASE WHEN {good} THEN {plus} ELSE {minus} END"


_COUNTS = f"({_asks(r'\bhow many\b')} OR {_asks(r'\bcount\b')} OR ({_asks(r'\bnumber\b')} AND NOT {_asks(r'\bnumber\s+of\s+(years?|times?)\b')}))"
_EACH = _asks(r"\b(each|per)\b")
_GROUPS = f"({_EACH} OR ({_asks(r'\bby\b')} AND NOT {_asks(r'\b(?:not\s+used|used|written|composed|sung|performed|owned|created)\s+by\b')}))"
_STRENGTH = f"CASE WHEN {_EACH} THEN 1.5 ELSE 0.75 END"
_TOP = _asks(r"\b(most|greatest|largest)\b")
_S_COUNT, _S_AVG, _S_MAX, _S_MIN = (_has(rf"\b{f}\s*\(") for f in ("count", "avg", "max", "min"))
_S_GROUP, _S_ORDER, _S_JOIN, _S_LIMIT = (_has(p) for p in (r"\bgroup\s+by\b", r"\border\s+by\b", r"\bjoin\b", r"\blimit\b"))
_S_LEFT, _S_ANTI, _S_DATED = _has(r"\bleft\s+(?:outer\s+)?join\b"), _has(r"\bnot\s+in\s*\(|\bnot\s+exists\b"), _has("date|year|birth|born")
_DESC, _ASC = (f"({_S_ORDER} AND {_has(rf'\b{d}\b')} AND {_S_LIMIT})" for d in ("desc", "asc"))
_SPACED = "len(list_filter(regexp_extract_all(COALESCE(sql, ''), '''([^'']*)''', 1), lambda x: x <> TRIM(x, ' '))) > 0"
_RANKS = f"({_TOP} AND {_S_COUNT} AND {_S_GROUP} AND {_DESC})"
_RULES: tuple[tuple[str, str, str], ...] = (
    ("execution", "TRUE", _sign("ok", 10, -10)),
    ("source_reliability", "TRUE", "CASE source WHEN 'embedrag' THEN 5 WHEN 'bm25rag' THEN 4 WHEN 'lora_rag' THEN 3 WHEN 'promptonly' THEN 1 WHEN 'loraonly_ep3' THEN 0.5 ELSE 0 END"),
    ("repair_variant", "repaired = 1", "CASE WHEN ok AND NOT original_ok THEN 1 WHEN ok THEN 0.25 ELSE -2 END"),
    ("repair_spaced_literal", f"repaired = 1 AND {_SPACED}", "-2"),
    ("repair_guard", "repaired = 0 AND ok AND repair_available AND repair_ok", "0.25"),
    ("keyword_count", _COUNTS, _sign(_S_COUNT, 2, -3)),
    ("keyword_average", _asks(r"\b(average|avg|mean)\b"), _sign(_S_AVG, 2, -2.5)),
    ("keyword_maximum", f"({_asks(r'\b(maximum|max|highest|oldest)\b')} OR {_TOP})", _sign(f"{_S_MAX} OR {_DESC} OR ({_asks(r'\boldest\b')} AND {_ASC} AND {_S_DATED})", 2, -2.5)),
    ("keyword_minimum", _asks(r"\b(minimum|min|lowest|youngest)\b"), _sign(f"{_S_MIN} OR {_ASC} OR ({_asks(r'\byoungest\b')} AND {_DESC} AND {_S_DATED})", 2, -2.5)),
    ("keyword_group", _GROUPS, f"CASE WHEN {_S_GROUP} THEN {_STRENGTH} ELSE -({_STRENGTH}) END"),
    ("count_each_left_join", f"{_COUNTS} AND {_EACH} AND {_S_COUNT} AND {_S_LEFT}", "0.75"),
    ("count_each_inner_join", f"{_COUNTS} AND {_EACH} AND {_S_COUNT} AND NOT {_S_LEFT} AND {_S_JOIN} AND {_S_GROUP}", "-0.5"),
    ("keyword_order", _asks(r"\b(order|ordered|sort|sorted)\b"), _sign(_S_ORDER, 1.5, -1.5)),
    ("mismatch_ranking_outputs_count", f"{_TOP} AND regexp_matches(chosen, '\\bcount\\s*\\(') AND contains(chosen, ',') AND NOT {_asks(r'\b(and|with)\s+(the\s+)?(number|count|total)\b')}", "-2"),
    ("ranking_group_by_id", f"{_RANKS} AND regexp_matches(grouped, '\\b\\w*id\\b')", "0.75"),
    ("ranking_group_by_name", f"{_RANKS} AND NOT regexp_matches(grouped, '\\b\\w*id\\b') AND regexp_matches(grouped, '\\bname\\b')", "-0.75"),
    ("not_used_antijoin", f"{_asks(r'\bnot\s+used\b')} AND {_S_ANTI}", "1"),
    ("not_used_left_join_null", f"{_asks(r'\bnot\s+used\b')} AND NOT {_S_ANTI} AND {_S_LEFT} AND {_has(r'\bis\s+null\b')}", "-0.5"),
    ("mismatch_us_territory_column", "contains(q, 'us territory') AND NOT contains(s, 'governmentform')", "-2"),
    ("mismatch_enrollment_id_column", f"{_asks(r'\benrollment\s+id\b')} AND NOT contains(s, 'enrollment')", "-2"),
    ("mismatch_entity_count_distinct", f"{_asks(r'\bwho\s+participated\b|\bnumber\s+of\b.*\b(winners?|players?|students?|people|owners?)\b.*\bwho\b')} AND {_has(r'\bcount\s*\(\s*\*\s*\)')} AND NOT {_has(r'\bcount\s*\(\s*distinct\b')}", "-1.25"),
    ("mismatch_avg_join_duplicates", f"{_asks(r'\b(who|that|which)\s+have\b|\bgone\s+through\b|\bany\s+(friends?|treatments?)\b')} AND {_S_AVG} AND {_S_JOIN} AND NOT {_has(r'\bin\s*\(|\bexists\b|\bdistinct\b')}", "-2"),
    ("mismatch_unasked_official_filter", f"{_asks(r'\b(use|uses|speak|speaks|spoken)\b')} AND NOT contains(q, 'official') AND contains(s, 'isofficial')", "-2"),
    ("mismatch_count_select_text", f"{_COUNTS} AND NOT {_S_COUNT} AND regexp_matches(chosen, '\\b(name|text|title|first_name|last_name|fname|lname)\\b')", "-2"),
    ("mismatch_simple_count_complex_sql", f"{_COUNTS} AND NOT {_GROUPS} AND q_words <= 12 AND {_S_JOIN} AND {_S_GROUP} AND {_S_ORDER} AND {_S_LIMIT}", "-2"),
    ("mismatch_long_sql_short_question", "q_words <= 8 AND s_words >= 50", "CASE WHEN s_words >= 80 THEN -1 ELSE -0.5 END"),
    ("empty_result", "ok AND empty", "-0.5"),
    ("result_consistency", "ok AND support > 1", "LEAST(2, 0.5 * (support - 1))"),
)
_CASES = " + ".join(f"CASE WHEN {when} THEN {adds} ELSE 0 END" for _, when, adds in _RULES)
_NORMAL_SQL = "LOWER(TRIM(regexp_replace(regexp_replace(regexp_replace(COALESCE({}, ''), '--[^\\n]*', ' ', 'g'), '(?s)/\\*.*?\\*/', ' ', 'g'), '\\s+', ' ', 'g'), ' '))"
_SCORED = POOL + f""", texts AS (SELECT p.*, LOWER(COALESCE(i.question, '')) AS q, {_NORMAL_SQL.format('p.sql')} AS s FROM pool p LEFT JOIN question_items i ON p.idx = i.idx),
 parts AS (SELECT *, TRIM(regexp_extract(s, '(?s)\\bselect\\b\\s+(.*?)\\s+\\bfrom\\b', 1), ' ') AS chosen, TRIM(regexp_extract(s, '(?s)\\bgroup\\s+by\\b\\s+(.*?)(?:\\border\\s+by\\b|\\bhaving\\b|\\blimit\\b|;|$)', 1), ' ') AS grouped,
   len(regexp_extract_all(q, '[a-z0-9_'']+')) AS q_words, len(regexp_extract_all(s, '[a-z0-9_'']+')) AS s_words FROM texts),
 scored AS (SELECT *, ROUND(CAST({_CASES} AS DOUBLE), 4) AS rule_score FROM parts)
"""


@query(_SCORED + "SELECT pool_id, rule_score FROM scored")
def score_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.scored(pool_of(spark, sf_dir), read(spark, sf_dir, "question_items")).select("pool_id", "rule_score")


@query(_SCORED + "SELECT idx, pool_id, source, variant, ok, correct FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY idx ORDER BY -rule_score, CASE source WHEN 'embedrag' THEN 0 WHEN 'bm25rag' THEN 1 WHEN 'lora_rag' THEN 2 WHEN 'promptonly' THEN 3 WHEN 'loraonly_ep3' THEN 4 ELSE 999 END, repaired, ord, pool_id) AS r FROM scored) t WHERE r = 1")
def select_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = SC.scored(pool_of(spark, sf_dir), read(spark, sf_dir, "question_items"))
    return S.by_score(scored.withColumn("score", F.col("rule_score")))


@query(_SCORED + " UNION ALL ".join(f"SELECT '{name}' AS rule, COUNT(*) AS n, ROUND(AVG(CAST({adds} AS DOUBLE)), 4) AS mean_delta FROM parts WHERE {when} HAVING COUNT(*) > 0" for name, when, adds in _RULES))
def score_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often every rule applies and what it adds on average."""
    scored = SC.scored(pool_of(spark, sf_dir), read(spark, sf_dir, "question_items"))
    each = scored.select(F.explode("breakdown").alias("b")).select("b.*")
    return each.groupBy("rule").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 4).alias("mean_delta"))


_STRUCTURE = ", ".join(f"'{k}=' || CAST({v} AS VARCHAR)" for k, v in {
    "select_items": "CASE WHEN chosen <> '' THEN len(string_split(chosen, ',')) ELSE 0 END", "joins": "len(regexp_extract_all(s, '\\bjoin\\b'))", "where": _has(r"\bwhere\b"), "group_by": _S_GROUP,
    "order_by": _S_ORDER, "limit": _S_LIMIT, "distinct": _has(r"\bdistinct\b"), "count": _S_COUNT, "avg": _S_AVG, "sum": _has(r"\bsum\s*\("), "max": _S_MAX, "min": _S_MIN, "not_in_or_exists": _S_ANTI}.items())


@query(_SCORED + f"SELECT pool_id, concat_ws(', ', {_STRUCTURE}) AS structure FROM parts")
def score_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.structures(pool_of(spark, sf_dir)).select("pool_id", "structure")


_SHAPE = "CASE WHEN result IS NULL THEN 'none' ELSE CAST(len(CAST(from_json(result, '[[\"VARCHAR\"]]') AS VARCHAR[][])) AS VARCHAR) || 'x' || CAST(COALESCE(len((CAST(from_json(result, '[[\"VARCHAR\"]]') AS VARCHAR[][]))[1]), 0) AS VARCHAR) END"
_KINDS = POOL + f""", shaped AS (SELECT *, {_SHAPE} AS shape FROM pool), good AS (SELECT DISTINCT idx, shape FROM shaped WHERE labeled AND correct),
 kinds AS (SELECT a.*, CASE WHEN labeled AND ok AND NOT correct THEN CASE WHEN support >= 2 THEN 'hard_supported_executable_wrong' WHEN g.idx IS NOT NULL THEN 'hard_same_shape_executable_wrong' WHEN NOT empty THEN 'hard_non_empty_executable_wrong' ELSE 'hard_empty_executable_wrong' END
   WHEN labeled AND ok AND correct THEN 'positive_execution_correct' WHEN ok AND NOT labeled THEN 'hard_executable_wrong' WHEN NOT ok THEN 'easy_execution_error' ELSE 'other_semantic_wrong' END AS kind
  FROM shaped a LEFT JOIN good g ON a.idx = g.idx AND a.shape = g.shape)
"""


@query(_KINDS + "SELECT pool_id, shape, kind FROM kinds")
def candidate_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.candidate_kinds(pool_of(spark, sf_dir)).select("pool_id", "shape", "kind")


_PRIORITY = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(SC.KINDS)) + " ELSE 999 END"
_PAIRS = _KINDS + f""", rights AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY idx ORDER BY md5('42:' || CAST(pool_id AS VARCHAR)), pool_id) AS turn FROM kinds WHERE labeled AND correct) t WHERE turn <= 80),
 wrongs AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY idx ORDER BY {_PRIORITY}, ord, pool_id) AS spot FROM kinds WHERE labeled AND NOT correct),
 every AS (SELECT w.idx, ROW_NUMBER() OVER (PARTITION BY w.idx ORDER BY spot, turn) AS place, r.pool_id AS positive, w.pool_id AS negative, w.kind FROM wrongs w JOIN rights r ON r.idx = w.idx WHERE spot <= 80),
 pairs AS (SELECT idx, CAST(place AS INTEGER) AS place, positive, negative, kind FROM every WHERE place <= 80)
"""


@query(_PAIRS + "SELECT * FROM pairs")
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PR.preference_pairs(pool_of(spark, sf_dir))


@query(_PAIRS + "SELECT kind, COUNT(*) AS pairs, COUNT(DISTINCT idx) AS questions FROM pairs GROUP BY kind")
def preference_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PR.pair_counts(PR.preference_pairs(pool_of(spark, sf_dir)))


_FOLDS = """WITH RECURSIVE sizes AS (SELECT COALESCE(NULLIF(LOWER(TRIM(db_id, ' ')), ''), 'unknown') AS db_id, COUNT(*) AS n FROM question_items GROUP BY 1),
 o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY n DESC, db_id) AS i FROM sizes),
 r AS (SELECT CAST(0 AS BIGINT) AS i, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS loads, CAST(NULL AS VARCHAR) AS db_id, CAST(NULL AS BIGINT) AS n, CAST(NULL AS INTEGER) AS fold
   UNION ALL SELECT o.i, list_transform(r.loads, lambda x, k: CASE WHEN k = list_position(r.loads, list_min(r.loads)) THEN x + o.n ELSE x END), o.db_id, o.n, CAST(list_position(r.loads, list_min(r.loads)) - 1 AS INTEGER)
   FROM r JOIN o ON o.i = r.i + 1),
 folds AS (SELECT db_id, n AS rows, fold FROM r WHERE i > 0)
"""


@query(_FOLDS + "SELECT db_id, rows, fold FROM folds")
def database_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PR.database_folds(read(spark, sf_dir, "question_items"), 5)


@query(_FOLDS + "SELECT idx, CASE WHEN fold = 2 THEN 'eval' ELSE 'train' END AS split FROM question_items q JOIN folds f ON f.db_id = COALESCE(NULLIF(LOWER(TRIM(q.db_id, ' ')), ''), 'unknown')")
def fold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "question_items")
    return PR.fold_rows(items, PR.database_folds(items, 5), 2)


# --- text

_STOP = ", ".join(f"'{w}'" for w in TX.STOP_WORDS)
_STEM = "CASE WHEN suffix(w, 'ies') AND LENGTH(w) > 4 THEN LEFT(w, LENGTH(w) - 3) || 'y' WHEN suffix(w, 'es') AND LENGTH(w) > 3 THEN LEFT(w, LENGTH(w) - 2) WHEN suffix(w, 's') AND LENGTH(w) > 3 THEN LEFT(w, LENGTH(w) - 1) ELSE w END"


def _tokens(text: str) -> str:
    return (f"list_transform(list_filter(regexp_extract_all(LOWER(COALESCE({text}, '')), '{TX.TOKEN}'), lambda w: LENGTH(w) >= 2 AND NOT list_contains([{_STOP}], w)), lambda w: {_STEM})")


@query(f"SELECT idx, array_to_string({_tokens('question')}, ' ') AS tokens FROM question_items")
def text_retrieval_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "question_items").select("idx", F.array_join(TX.retrieval_tokens(F.col("question")), " ").alias("tokens"))


@query("SELECT idx, TRIM(regexp_replace(regexp_replace(regexp_replace(LOWER(question), '[‘’]', '''', 'g'), '[^a-z0-9_'']+', ' ', 'g'), ' +', ' ', 'g'), ' ') AS normal, len(regexp_extract_all(LOWER(COALESCE(question, '')), '[a-z0-9_'']+')) AS words FROM question_items")
def text_normal_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("question")
    return read(spark, sf_dir, "question_items").select("idx", TX.normal_question(q).alias("normal"), TX.word_count(q).alias("words"))


@query(f"SELECT pool_id, {_NORMAL_SQL.format('sql')} AS normal, LOWER(regexp_replace(TRIM(regexp_replace(COALESCE(sql, ''), '\\s+', ' ', 'g'), ' '), '[; ]+$', '')) AS key FROM candidate_pool")
def text_normal_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = F.col("sql")
    return read(spark, sf_dir, "candidate_pool").select("pool_id", TX.normal_sql(sql).alias("normal"), TX.sql_key(sql).alias("key"))


@query("SELECT pool_id, TRIM(regexp_extract(n, '(?s)\\bselect\\b\\s+(.*?)\\s+\\bfrom\\b', 1), ' ') AS fields, TRIM(regexp_extract(n, '(?s)\\bgroup\\s+by\\b\\s+(.*?)(?:\\border\\s+by\\b|\\bhaving\\b|\\blimit\\b|;|$)', 1), ' ') AS groups FROM (SELECT pool_id, " + _NORMAL_SQL.format("sql") + " AS n FROM candidate_pool) t")
def text_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal = read(spark, sf_dir, "candidate_pool").select("pool_id", TX.normal_sql(F.col("sql")).alias("n"))
    return normal.select("pool_id", TX.field_list(F.col("n")).alias("fields"), TX.group_fields(F.col("n")).alias("groups"))


_LITERALS = "list_filter(list_transform(list_concat(regexp_extract_all(sql, '''([^'']*)''', 1), regexp_extract_all(sql, '\"([^\"]*)\"', 1)), lambda x: TRIM(x, ' ')), lambda x: x <> '')"


@query(f"SELECT pool_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS literals FROM (SELECT pool_id, {_LITERALS} AS l FROM candidate_pool WHERE sql IS NOT NULL) t")
def text_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = read(spark, sf_dir, "candidate_pool").filter("sql IS NOT NULL")
    return pool.select("pool_id", F.array_join(TX.string_literals(F.col("sql")), "|").alias("literals"))


@query("SELECT doc_id, CASE WHEN LENGTH(text) > 500 THEN RTRIM(LEFT(text, 500), ' ') || ' ...' ELSE text END AS short, sha256(COALESCE(LOWER(source), '') || chr(31) || COALESCE(CAST(n_chars AS VARCHAR), '') || chr(31) || COALESCE(text, '')) AS key FROM documents")
def text_shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", TX.shorten(F.col("text"), 500).alias("short"), TX.stable_key(F.lower("source"), F.col("n_chars"), F.col("text")).alias("key"))


@query()
def text_clean_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement of every model answer."""
    raw = F.col("mysql_dialect_repair_raw_response")
    return read(spark, sf_dir, "mysql_repair").filter(raw.isNotNull()).select("repair_id", TX.clean_answer(raw).alias("statement"))


@query()
def text_answer_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many statements the JSON of every model answer holds."""
    raw = F.col("mysql_dialect_repair_raw_response")
    return read(spark, sf_dir, "mysql_repair").filter(raw.isNotNull()).select("repair_id", F.size(TX.answer_statements(raw)).alias("candidates"))


@query("SELECT event_type, COUNT(*) AS n, CAST(SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, COUNT(DISTINCT json_extract_string(props, '$.k')) AS kinds FROM events GROUP BY event_type")
def json_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k.cast("bigint")).alias("total"), F.count_distinct(k).alias("kinds"))


# --- equality of results

_ROWS_JSON = "CAST(CAST(result AS JSON) AS JSON[])"
_ROWS = "CAST(from_json(result, '[[\"VARCHAR\"]]') AS VARCHAR[][])"


@query(POOL + f"SELECT pool_id, md5(key) AS key_digest, CASE WHEN result IS NOT NULL THEN len({_ROWS}) END AS n_rows, CASE WHEN result IS NOT NULL THEN COALESCE(len(({_ROWS})[1]), 0) END AS n_cols FROM pool")
def result_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = pool_of(spark, sf_dir).withColumn("shape", EQ.shape(F.col("result")))
    return pool.select("pool_id", F.md5("key").alias("key_digest"), F.col("shape.rows").alias("n_rows"), F.col("shape.cols").alias("n_cols"))


@query(POOL + """SELECT idx, COUNT(DISTINCT key) AS untyped, COUNT(DISTINCT CASE WHEN result IS NULL THEN 'NULL_RESULT' ELSE CAST(list_sort(list_transform(CAST(CAST(result AS JSON) AS JSON[]), lambda r: CAST(r AS VARCHAR))) AS VARCHAR) END) AS typed,
 COUNT(DISTINCT COALESCE(CAST(to_json(CAST(from_json(result, '[["VARCHAR"]]') AS VARCHAR[][])) AS VARCHAR), '')) AS ordered FROM pool GROUP BY idx""")
def result_keys_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the four rules of equality split the results of a question."""
    r = F.col("result")
    keyed = pool_of(spark, sf_dir).select("idx", "key", EQ.typed_key(r).alias("typed"), F.coalesce(EQ.ordered_key(r), F.lit("")).alias("ordered"))
    return keyed.groupBy("idx").agg(F.count_distinct("key").alias("untyped"), F.count_distinct("typed").alias("typed"), F.count_distinct("ordered").alias("ordered"))


_GOLD = POOL + ", g AS (SELECT DISTINCT idx, key FROM pool WHERE correct) SELECT p.idx, p.pool_id, g.key IS NOT NULL AS same_as_correct FROM pool p LEFT JOIN g ON p.idx = g.idx AND p.key = g.key WHERE p.ok"


@query(_GOLD)
def label_by_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose result equals that of a correct one of the question."""
    pool = pool_of(spark, sf_dir)
    right = pool.filter("correct").select("idx", "key").distinct().withColumn("hit", F.lit(True))
    return pool.filter("ok").join(right, ["idx", "key"], "left").select("idx", "pool_id", F.coalesce("hit", F.lit(False)).alias("same_as_correct"))


# --- items

@query("SELECT idx, CAST(position - 1 AS INTEGER) AS position, c.source AS source, c.sql AS sql, c.model AS model FROM (SELECT idx, UNNEST(candidates) AS c, UNNEST(range(1, len(candidates) + 1)) AS position FROM question_items WHERE candidates IS NOT NULL) t")
def item_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.nested_candidates(read(spark, sf_dir, "question_items")).select("idx", "position", "source", "sql", "model")


@query("SELECT idx, CAST(c AS INTEGER) AS chunk, CAST(LEAST(len(candidates) - 1000 * c, 1000) AS INTEGER) AS n FROM (SELECT idx, candidates, UNNEST(range(0, (len(candidates) + 999) // 1000)) AS c FROM question_items WHERE len(candidates) > 0) t")
def item_renested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates taken apart and nested again."""
    items = read(spark, sf_dir, "question_items")
    return P.nest(P.nested_candidates(items)).select("idx", "chunk", F.size("candidates").alias("n"))


@query("WITH c AS (SELECT idx, UNNEST(candidates) AS c FROM question_items WHERE candidates IS NOT NULL), b AS (SELECT DISTINCT idx FROM question_items WHERE split = 'dev') "
       "SELECT c.idx, CAST(CASE c.c.source WHEN 'embedrag' THEN 0 ELSE 1 END AS INTEGER) AS position, c.c.source AS source, c.c.sql AS sql FROM c JOIN b ON b.idx = c.idx WHERE c.c.source IN ('embedrag', 'promptonly')")
def item_zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictions of two sources beside the items of the dev split."""
    items = read(spark, sf_dir, "question_items")
    made = P.nested_candidates(items)
    return P.zipped(items.filter("split = 'dev'").select("idx").distinct(), {n: made.filter(F.col("source") == n) for n in ("embedrag", "promptonly")}).select("idx", "position", "source", "sql")


@query("WITH n AS (SELECT idx, split, LOWER(TRIM(db_id, ' ')) AS db, TRIM(regexp_replace(regexp_replace(regexp_replace(LOWER(question), '[‘’]', '''', 'g'), '[^a-z0-9_'']+', ' ', 'g'), ' +', ' ', 'g'), ' ') AS q FROM question_items) "
       "SELECT a.idx, MIN(b.idx) AS found FROM n a JOIN n b ON a.db = b.db AND a.q = b.q WHERE a.q <> '' AND a.split IN ('dev', 'test') AND b.split = 'train' GROUP BY a.idx")
def question_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of dev and test that a cache of the train questions would answer."""
    items = read(spark, sf_dir, "question_items")
    return C.question_lookup(items.filter("split IN ('dev', 'test')"), items.filter("split = 'train'"))


@query("SELECT q.idx FROM question_items q WHERE NOT EXISTS (SELECT 1 FROM mysql_repair m WHERE m.idx = q.idx)")
def item_not_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that the repair stage has no row of: what a resumed run would take up."""
    return read(spark, sf_dir, "question_items").join(read(spark, sf_dir, "mysql_repair").select("idx"), "idx", "left_anti").select("idx")


# --- catalog

_COLS = """
WITH raw AS (SELECT db_id, table_names_original AS tn, column_types AS ct, primary_keys AS pk, UNNEST(column_names_original) AS c, UNNEST(range(0, len(column_names_original))) AS col FROM db_catalog),
 cols AS (SELECT db_id, c.tbl AS tbl, tn[c.tbl + 1] AS tname, col, c.name AS cname, COALESCE(ct[col + 1], 'unknown') AS ctype, COALESCE(list_contains(pk, col), FALSE) AS is_key FROM raw WHERE c.tbl >= 0),
 fkr AS (SELECT db_id, table_names_original AS tn, column_names_original AS cn, UNNEST(foreign_keys) AS fk, UNNEST(range(0, len(foreign_keys))) AS pos FROM db_catalog WHERE foreign_keys IS NOT NULL),
 fks AS (SELECT db_id, pos, tn[cn[fk[1] + 1].tbl + 1] AS tname, cn[fk[1] + 1].name AS cname, tn[cn[fk[2] + 1].tbl + 1] AS to_table, cn[fk[2] + 1].name AS to_column FROM fkr WHERE len(fk) >= 2 AND cn[fk[1] + 1].tbl >= 0 AND cn[fk[2] + 1].tbl >= 0),
 tabs AS (SELECT db_id, UNNEST(table_names_original) AS tname, UNNEST(range(0, len(table_names_original))) AS tbl FROM db_catalog),
 tcols AS (SELECT t.db_id, t.tbl, t.tname, col, cname, ctype, is_key FROM tabs t LEFT JOIN cols c ON t.db_id = c.db_id AND t.tbl = c.tbl),
 docs AS (SELECT db_id || '::table::' || tname AS doc_id, db_id, 'table' AS type, 'Database: ' || db_id || chr(10) || 'Table: ' || tname || chr(10) || 'Columns: ' || COALESCE(string_agg(cname || ':' || ctype || CASE WHEN is_key THEN ' [PK]' ELSE '' END, ', ' ORDER BY col), '') AS text, [tname] AS tabs FROM tcols GROUP BY db_id, tbl, tname
  UNION ALL SELECT db_id || '::col::' || tname || '.' || cname, db_id, 'column', 'Database: ' || db_id || chr(10) || 'Column: ' || tname || '.' || cname || chr(10) || 'Type: ' || ctype || CASE WHEN is_key THEN ' [PK]' ELSE '' END, [tname] FROM cols
  UNION ALL SELECT db_id || '::fk::' || CAST(pos AS VARCHAR), db_id, 'fk', 'Database: ' || db_id || chr(10) || 'ForeignKey: ' || tname || '.' || cname || ' -> ' || to_table || '.' || to_column || chr(10) || 'JoinHint: ' || tname || ' JOIN ' || to_table || ' ON ' || tname || '.' || cname || ' = ' || to_table || '.' || to_column, [tname, to_table] FROM fks)
"""


def catalog_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "db_catalog")


@query(_COLS + "SELECT db_id, tname AS \"table\", cname AS \"column\", ctype AS type, is_key FROM cols")
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.columns(catalog_of(spark, sf_dir)).select("db_id", "table", "column", "type", "is_key")


@query(_COLS + "SELECT doc_id, db_id, type, text FROM docs")
def catalog_schema_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.schema_docs(catalog_of(spark, sf_dir)).drop("tables")


@query(_COLS + "SELECT type, COUNT(*) AS docs, COUNT(DISTINCT db_id) AS databases FROM docs GROUP BY type")
def catalog_doc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.doc_counts(C.schema_docs(catalog_of(spark, sf_dir)))


@query(_COLS + ", l AS (SELECT db_id, tbl, 'Table ' || tname || COALESCE(': ' || string_agg(cname || ' ' || ctype || CASE WHEN is_key THEN ' primary_key' ELSE '' END, '; ' ORDER BY col), '') || '.' AS line FROM tcols GROUP BY db_id, tbl, tname), "
       "k AS (SELECT db_id, chr(10) || 'Foreign keys: ' || string_agg(tname || '.' || cname || ' -> ' || to_table || '.' || to_column, '; ' ORDER BY pos) || '.' AS line FROM fks WHERE pos < 60 GROUP BY db_id) "
       "SELECT l.db_id, 'Database ' || l.db_id || '.' || chr(10) || string_agg(l.line, chr(10) ORDER BY tbl) || COALESCE(MIN(k.line), '') AS text FROM l LEFT JOIN k ON l.db_id = k.db_id GROUP BY l.db_id")
def catalog_schema_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.schema_text(catalog_of(spark, sf_dir))


@query("SELECT pool_id, CAST(len(list_filter(t, lambda x: list_contains(w, x))) AS INTEGER) AS n_tables, CAST(len(list_filter(c, lambda x: list_contains(w, x.name) OR contains(low, x.qualified))) AS INTEGER) AS n_columns "
       "FROM (SELECT pool_id, LOWER(TRIM(db_id, ' ')) AS db, LOWER(COALESCE(sql, '')) AS low, regexp_extract_all(LOWER(COALESCE(sql, '')), '[a-z_][a-z0-9_]*') AS w FROM candidate_pool) p "
       "JOIN (SELECT LOWER(TRIM(db_id, ' ')) AS db, list_transform(table_names_original, lambda x: LOWER(x)) AS t, list_transform(list_filter(column_names_original, lambda x: x.tbl >= 0), "
       "lambda x: {'name': LOWER(x.name), 'qualified': LOWER(table_names_original[x.tbl + 1] || '.' || x.name)}) AS c FROM db_catalog) d ON p.db = d.db")
def catalog_schema_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.schema_links(read(spark, sf_dir, "candidate_pool"), catalog_of(spark, sf_dir))


_IDENT = "list_filter(list_transform(regexp_split_to_array(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda w: LOWER(w)), lambda w: LENGTH(w) >= 2)"
_PLURAL = "CASE WHEN suffix(w, 'ies') AND LENGTH(w) > 4 THEN LEFT(w, LENGTH(w) - 3) || 'y' WHEN suffix(w, 'es') AND LENGTH(w) > 4 THEN LEFT(w, LENGTH(w) - 2) WHEN suffix(w, 's') AND LENGTH(w) > 3 THEN LEFT(w, LENGTH(w) - 1) ELSE w END"
_RELEVANT = _COLS + f""", t AS (SELECT LOWER(TRIM(db_id, ' ')) AS db, tbl, tname, list_distinct({_IDENT.format('tname')}) AS tw, list_distinct(flatten(list({_IDENT.format('cname')}))) AS cw, list({_IDENT.format('cname')}) AS each FROM cols GROUP BY db_id, tbl, tname),
 a AS (SELECT idx, LOWER(TRIM(db_id, ' ')) AS db, {_IDENT.format('question')} AS w0 FROM question_items WHERE question IS NOT NULL AND db_id IS NOT NULL),
 b AS (SELECT idx, db, list_distinct(list_concat(w0, list_transform(w0, lambda w: {_PLURAL}))) AS q FROM a),
 m AS (SELECT idx, tbl, tname, 3 * len(list_intersect(q, tw)) + 2 * len(list_intersect(q, cw)) + len(list_filter(each, lambda e: len(list_intersect(q, e)) > 0)) AS score FROM b JOIN t ON b.db = t.db),
 r AS (SELECT idx, tname AS "table", CAST(score AS INTEGER) AS score, CAST(ROW_NUMBER() OVER (PARTITION BY idx ORDER BY score DESC, tname) AS INTEGER) AS place FROM m WHERE score > 0
  UNION ALL SELECT idx, tname, 0, CAST(place AS INTEGER) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY idx ORDER BY tbl) AS place, MAX(score) OVER (PARTITION BY idx) AS top FROM m) f WHERE top = 0 AND place <= 2)
"""


@query(_RELEVANT + "SELECT * FROM r WHERE place <= 3")
def catalog_relevant_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.relevant_tables(read(spark, sf_dir, "question_items"), catalog_of(spark, sf_dir))


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, catalog = read(spark, sf_dir, "question_items"), catalog_of(spark, sf_dir)
    return C.relevant_tables(items, catalog, 1).join(items.select("idx", F.lower(F.trim("db_id")).alias("db")), "idx").select("idx", "db", "table")


_EDGES = ", fk2 AS (SELECT LOWER(TRIM(db_id, ' ')) AS db, tname, to_table FROM fks), e AS (SELECT db, tname AS a, to_table AS b FROM fk2 UNION ALL SELECT db, to_table, tname FROM fk2), ch AS (SELECT r.idx, b.db, r.\"table\" FROM r JOIN b ON r.idx = b.idx WHERE place <= {})"


@query(_RELEVANT + _EDGES.format(1) + ' SELECT ch.idx, e.b AS "table", COUNT(*) AS links FROM ch JOIN e ON ch.db = e.db AND ch."table" = e.a WHERE NOT EXISTS (SELECT 1 FROM ch x WHERE x.idx = ch.idx AND x."table" = e.b) GROUP BY ch.idx, e.b')
def catalog_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.bridges(_chosen(spark, sf_dir), catalog_of(spark, sf_dir))


@query(_RELEVANT + _EDGES.format(3) + ' SELECT DISTINCT x.idx, f.tname AS "table", f.to_table FROM ch x JOIN fk2 f ON x.db = f.db AND x."table" = f.tname JOIN ch y ON y.idx = x.idx AND y."table" = f.to_table')
def catalog_induced_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, catalog = read(spark, sf_dir, "question_items"), catalog_of(spark, sf_dir)
    chosen = C.relevant_tables(items, catalog).join(items.select("idx", F.lower(F.trim("db_id")).alias("db")), "idx").select("idx", "db", "table")
    return C.induced_keys(chosen, catalog)


# --- retrieval

def _bm25(docs: str, doc: str, doc_text: str, queries: str, query_id: str, query_text: str, keep: str = "", same: str = "") -> str:
    """docs and queries are relations; same compares d.* with q.*."""
    return f""" tok AS (SELECT {doc} AS doc{keep}, {_tokens(doc_text)} AS ts FROM {docs}), st AS (SELECT COUNT(*) AS n, AVG(len(ts)) AS av FROM tok),
 tf AS (SELECT doc, term, COUNT(*) AS tf FROM (SELECT doc, UNNEST(ts) AS term FROM tok) x GROUP BY doc, term), dfs AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY term),
 qt AS (SELECT query, term, COUNT(*) AS times, MIN(pos) AS pos FROM (SELECT query, UNNEST(ts) AS term, UNNEST(range(0, len(ts))) AS pos FROM (SELECT {query_id} AS query, {_tokens(query_text)} AS ts FROM {queries}) a) b GROUP BY query, term),
 bm AS (SELECT qt.query, tf.doc, ROUND(SUM(times * LN(1 + (n - df + 0.5) / (df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * len(d.ts) / (av + 1e-9)) + 1e-9)), 6) AS score, MIN(pos) AS first
  FROM qt JOIN tf ON qt.term = tf.term JOIN dfs ON dfs.term = tf.term JOIN tok d ON d.doc = tf.doc {same} CROSS JOIN st GROUP BY qt.query, tf.doc)
"""


@query("WITH" + _bm25("documents", "doc_id", "text", "eval_passages", "item_id", "text") + "SELECT query, doc, score, CAST(place AS INTEGER) AS place FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, first, doc) AS place FROM bm) t WHERE place <= 5")
def retrieval_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = R.build_index(read(spark, sf_dir, "documents"), "doc_id", "text")
    return R.top_docs(R.bm25(index, read(spark, sf_dir, "eval_passages"), "item_id", "text"), 5).select("query", "doc", "score", "place")


@query("WITH" + _bm25("documents", "doc_id", "text", "eval_passages", "item_id", "text") + "SELECT term, df FROM dfs")
def retrieval_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.build_index(read(spark, sf_dir, "documents"), "doc_id", "text").terms.select("term", "df")


_CONTEXT = _COLS + ", asked AS (SELECT idx, question, LOWER(TRIM(db_id, ' ')) AS db FROM question_items WHERE idx % 100 = 0 AND question IS NOT NULL AND db_id IS NOT NULL), " + _bm25(
    "docs", "doc_id", "text", "asked", "idx", "question", keep=", LOWER(TRIM(db_id, ' ')) AS db, type, tabs, text", same="JOIN asked ak ON ak.idx = qt.query AND ak.db = d.db") + """
, deep AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, first, doc) AS p FROM bm) t WHERE p <= 200),
 typed AS (SELECT deep.*, tok.type, tok.tabs, tok.text FROM deep JOIN tok ON tok.doc = deep.doc),
 picked AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query, type ORDER BY score DESC, first, doc) AS place FROM typed WHERE type <> 'fk') x WHERE place <= CASE type WHEN 'table' THEN 5 ELSE 8 END),
 touching AS (SELECT * FROM typed k WHERE type = 'fk' AND EXISTS (SELECT 1 FROM picked c WHERE c.query = k.query AND list_has_any(c.tabs, k.tabs))),
 keys AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, first, doc) AS place FROM touching) x WHERE place <= 8),
 context AS (SELECT query, doc, type, score, CAST(place AS INTEGER) AS place, text FROM picked UNION ALL SELECT query, doc, type, score, CAST(place AS INTEGER), text FROM keys)
"""


@query(_CONTEXT + "SELECT query, doc, type, score, place FROM context")
def retrieval_schema_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "question_items").filter("idx % 100 = 0")
    return R.schema_context(C.schema_docs(catalog_of(spark, sf_dir)), asked)


def _block(kind: str, title: str) -> str:
    return f"'{title}' || chr(10) || COALESCE(string_agg(CASE WHEN type = '{kind}' THEN text END, chr(10) || chr(10) ORDER BY place), '(EMPTY)') || chr(10)"


_CONTEXT_TEXT = _CONTEXT + ", shown AS (SELECT query, " + " || ".join((_block("table", "=== TABLES (Top) ==="), _block("column", "=== COLUMNS (Top) ==="), _block("fk", "=== FOREIGN KEYS / JOIN HINTS ==="))) + " AS text FROM context GROUP BY query)"


@query(_CONTEXT_TEXT + "SELECT query, text FROM shown")
def retrieval_context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.schema_docs(catalog_of(spark, sf_dir))
    return R.context_text(R.schema_context(docs, read(spark, sf_dir, "question_items").filter("idx % 100 = 0")), docs)


def _names(what: str, most: int) -> str:
    found = f"list_sort(list_distinct(list_transform(regexp_extract_all(schema, '(?m)^\\s*{what}: (.*)$', 1), lambda x: TRIM(x, ' '))))[1:{most}]"
    return f"CASE WHEN len({found}) > 0 THEN array_to_string({found}, chr(10)) ELSE '(none)' END"


@query(_CONTEXT_TEXT + ", cut AS (SELECT query, LEFT(text, 1800) AS schema FROM shown) SELECT idx, db_id, md5('Schema context:' || chr(10) || schema || chr(10) || 'Allowed tables:' || chr(10) || " + _names("Table", 50) + " || chr(10) || 'Allowed columns:' || chr(10) || "
       + _names("Column", 200) + " || chr(10) || 'Question:' || chr(10) || TRIM(question, ' ') || chr(10) || 'SQL:') AS input_digest, CASE WHEN TRIM(COALESCE(gold, ''), ' ') <> '' AND NOT suffix(TRIM(gold, ' '), ';') THEN TRIM(gold, ' ') || ';' ELSE TRIM(COALESCE(gold, ''), ' ') END AS target_text "
       "FROM cut JOIN question_items ON idx = query")
def prompt_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.schema_docs(catalog_of(spark, sf_dir))
    asked = read(spark, sf_dir, "question_items").filter("idx % 100 = 0")
    made = R.prompt_cache(R.context_text(R.schema_context(docs, asked), docs), asked)
    return made.select("idx", "db_id", F.md5("input_text").alias("input_digest"), "target_text")


@query(SQL["retrieval_bm25"])
def retrieval_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over an index that was written and read back."""
    at = f"{_scratch(spark)}/index"
    R.save_index(R.build_index(read(spark, sf_dir, "documents"), "doc_id", "text"), at)
    return R.top_docs(R.bm25(R.load_index(spark, at), read(spark, sf_dir, "eval_passages"), "item_id", "text"), 5).select("query", "doc", "score", "place")


def _dense(same: str, k: int) -> str:
    return (f"SELECT query, doc, score, CAST(place AS INTEGER) AS place FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, doc) AS place FROM (SELECT q.vec_id AS query, d.vec_id AS doc, "
            f"ROUND(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id{same}) s) t WHERE place <= {k}")


@query(_dense("", 10))
def retrieval_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return R.dense_search(vectors, vectors.filter("vec_id % 100 = 0"), 10)


@query(_dense(" AND q.label = d.label", 3))
def retrieval_dense_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return R.dense_search(vectors, vectors.filter("vec_id % 100 = 0"), 3, group="label")


# --- streams

def _scratch(spark: SparkSession) -> str:
    """A new folder in the folder that all executors share."""
    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"


@query("SELECT date_trunc('day', ts) AS window_start, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _scratch(spark)
    ST_IN.sink_complete(ST_IN.event_windows(ST_IN.file_stream(spark, f"{sf_dir}/events.parquet")), f"{at}/table", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/table")


@query("SELECT COUNT(*) AS n, COUNT(DISTINCT idx) AS questions FROM (SELECT DISTINCT idx, LOWER(TRIM(backend, ' ')) AS backend, stage, sql, checked_at FROM evidence WHERE checked_at IS NOT NULL) t")
def stream_new_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _scratch(spark)
    ST_IN.sink_append(ST_IN.new_evidence(ST_IN.file_stream(spark, f"{sf_dir}/evidence.parquet")), f"{at}/table", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/table").agg(F.count("*").alias("n"), F.count_distinct("idx").alias("questions"))


# --- statements that are run

# Each question: its text, the right statement, candidates by source.
QUESTIONS = (
    ("How many customers are in each nation?", "SELECT n.n_name, COUNT(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name", (
        ("embedrag", "SELECT n_name, COUNT(*) FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name;"),
        ("bm25rag", "SELECT n.n_name, COUNT(c.c_custkey) FROM customer c, nation n WHERE c.c_nationkey = n.n_nationkey GROUP BY n.n_name"),
        ("lora_rag", "SELECT n_name, COUNT(*) FROM nations JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name"),
        ("loraonly_ep3", "SELECT n_name, COUNT(*) FROM nation JOIN customer ON n_nationkey = c_custkey WHERE c_custkey < 0 GROUP BY n_name"), ("promptonly", "SELECT [n_name] FROM [nation]"))),
    ("What is the highest account balance of suppliers in each nation?", "SELECT s_nationkey, MAX(s_acctbal) AS m FROM supplier GROUP BY s_nationkey", (
        ("embedrag", "SELECT s_nationkey, MAX(s_acctbal) FROM supplier"), ("bm25rag", "SELECT s_nationkey, MAX(s_acctbal) FROM supplier GROUP BY s_nationkey"),
        ("promptonly", "SELECT MAX(s_acctbal) FROM supplier"))),
    ("How many lines does every order status have?", "SELECT o_orderstatus, COUNT(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderstatus", (
        ("embedrag", "SELECT o_orderstatus, COUNT(*) FROM orders JOIN lineitem ON o_orderkey = l_ordrkey GROUP BY o_orderstatus"),
        ("bm25rag", "SELECT o_orderstatus, COUNT(*) FROM orders GROUP BY o_orderstatus"), ("lora_rag", "SELECT o_orderstatus, COUNT(*) FROM lineitem, orders WHERE l_orderkey = o_orderkey GROUP BY 1"), ("promptonly", "DROP TABLE orders"))),
)
STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def engine_of(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, {t: read(spark, sf_dir, t) for t in STAR})


@query()
def engine_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of the questions run and compared with the right statement."""
    engine_of(spark, sf_dir)
    outcomes = V.validate(spark, [(i, k, source, sql) for i, (_, _, cands) in enumerate(QUESTIONS) for k, (source, sql) in enumerate(cands)])
    gold = V.validate(spark, [(i, 0, "gold", sql) for i, (_, sql, _) in enumerate(QUESTIONS)])
    return V.labelled(outcomes, gold).select("idx", "candidate_index", "source", "ok", "condition", "n_rows", "correct")


def _answer(k: int, names: tuple[str, str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = engine_of(spark, sf_dir)
        question, _, cands = QUESTIONS[k]
        chosen, _ = engine.run(question, list(cands))
        return engine.execute(chosen.sql).toDF(*names)

    run.__name__ = f"engine_answer_{k}"
    return run


query("SELECT n.n_name AS name, COUNT(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")(_answer(0, ("name", "n")))
query("SELECT s_nationkey AS nation, MAX(s_acctbal) AS most FROM supplier GROUP BY s_nationkey")(_answer(1, ("nation", "most")))
query("SELECT o_orderstatus AS status, COUNT(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderstatus")(_answer(2, ("status", "n")))


@query()
def engine_portability(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_of(spark, sf_dir)
    parts = [engine.portability(sql).withColumn("idx", F.lit(i)) for i, sql in enumerate((
        QUESTIONS[0][1], "SELECT \"o_orderstatus\", COUNT(*) FROM orders GROUP BY \"o_orderstatus\"", "SELECT SUM(1 / (l_linenumber - 1)) FROM lineitem"))]
    return parts[0].union(parts[1]).union(parts[2])


# --- learned ranking

@query()
def ranker_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on the pairs of four fifths of the databases, measured on the rest."""
    pool, items = pool_of(spark, sf_dir), read(spark, sf_dir, "question_items")
    pairs = PR.preference_pairs(pool)
    held = items.select("idx", (F.pmod(F.xxhash64(F.lower(F.trim(F.coalesce("db_id", F.lit(""))))), F.lit(5)) == 0).alias("held"))
    differences = cut(RK.pair_differences(pairs.join(held, "idx"), RK.candidate_features(pool, items)))
    return RK.pair_accuracy(differences.filter("held"), RK.train(differences.filter("NOT held")))


@query()
def select_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per question the candidate with the highest learned score."""
    pool, items = pool_of(spark, sf_dir), read(spark, sf_dir, "question_items")
    features = cut(RK.candidate_features(pool, items))
    weights = RK.train(RK.pair_differences(PR.preference_pairs(pool), features))
    scored = pool.drop("score").join(features, "pool_id").withColumn("score", F.round(RK.weighted(F.col("features"), weights), 6))
    return S.semantic_score(scored)


# --- more of evidence, selection and catalog

@query(EVIDENCE + "SELECT idx, backend, stage, ok FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY idx, backend ORDER BY CASE WHEN ok THEN 0 ELSE 1 END, CASE WHEN ok THEN -stage_rank ELSE stage_rank END, sql_key, stage) AS r FROM ev) t WHERE r = 1")
def evidence_first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.first_success(evidence_of(spark, sf_dir))


@query(EVIDENCE + "SELECT n_same, COUNT(*) AS questions, CAST(SUM(n_ok) AS BIGINT) AS runs FROM chosen GROUP BY n_same")
def evidence_support_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.support_histogram(evidence_of(spark, sf_dir))


@query(_ALT + ", a AS (SELECT idx, COUNT(*) AS alternatives FROM alt GROUP BY idx), r AS (SELECT idx, COUNT(DISTINCT key) AS results FROM pool WHERE ok GROUP BY idx) SELECT b.idx, results, alternatives FROM b JOIN r ON b.idx = r.idx JOIN a ON b.idx = a.idx WHERE b.ok AND results >= 2")
def correction_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.correction_cases(pool_of(spark, sf_dir))


@query(POOL + "SELECT COUNT(*) AS questions, CAST(SUM(n) AS BIGINT) AS candidates, COUNT(*) FILTER (l) AS labeled, COUNT(*) FILTER (r) AS with_right, COUNT(*) FILTER (h) AS with_hard_wrong, COUNT(*) FILTER (r AND h) AS with_both, COUNT(*) FILTER (f) AS with_failed "
       "FROM (SELECT idx, COUNT(*) AS n, BOOL_OR(labeled) AS l, BOOL_OR(labeled AND ok AND correct) AS r, BOOL_OR(labeled AND ok AND NOT correct) AS h, BOOL_OR(NOT ok) AS f FROM pool GROUP BY idx) t")
def training_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.training_counts(pool_of(spark, sf_dir))


@query(f"WITH r AS (SELECT pool_id, CASE WHEN result IS NULL THEN NULL ELSE flatten(list_transform(({_ROWS_JSON})[1:5], lambda x: CAST(x AS JSON[]))) END AS cells FROM candidate_pool WHERE idx IS NOT NULL), "
       "n AS (SELECT pool_id, list_transform(cells, lambda c: CASE json_type(c) WHEN 'VARCHAR' THEN 'text' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'bool' WHEN 'DOUBLE' THEN 'float' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' ELSE 'other' END) AS t FROM r) "
       "SELECT pool_id, CASE WHEN t IS NULL OR len(t) = 0 THEN 'types=unknown' ELSE 'types=' || array_to_string(list_filter(list_transform(['bool', 'float', 'int', 'null', 'other', 'text'], lambda k: CASE WHEN list_contains(t, k) THEN k || ':' || CAST(len(list_filter(t, lambda x: x = k)) AS VARCHAR) END), lambda z: z IS NOT NULL), ',') END AS profile FROM n")
def result_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool_of(spark, sf_dir).select("pool_id", SC.type_profile(F.col("result")).alias("profile"))


@query()
def candidate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and digest of what a ranker reads of every candidate."""
    texts = SC.candidate_text(pool_of(spark, sf_dir), read(spark, sf_dir, "question_items"), C.schema_text(catalog_of(spark, sf_dir)))
    return texts.select("pool_id", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query(_RELEVANT + _EDGES.format(3) + ', br AS (SELECT ch.idx, e.b AS t, COUNT(*) AS links FROM ch JOIN e ON ch.db = e.db AND ch."table" = e.a WHERE NOT EXISTS (SELECT 1 FROM ch x WHERE x.idx = ch.idx AND x."table" = e.b) GROUP BY ch.idx, e.b), '
       'u AS (SELECT idx, "table", 0 AS bridge, place AS o FROM r WHERE place <= 3 UNION ALL SELECT idx, t, 1, -links FROM br) SELECT idx, "table", CAST(place AS INTEGER) AS place FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY idx ORDER BY bridge, o, "table") AS place FROM u) v WHERE place <= 3')
def catalog_tables_with_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tables_with_bridges(read(spark, sf_dir, "question_items"), catalog_of(spark, sf_dir))


@query(_COLS + "SELECT db_id, doc_id, CAST(place AS INTEGER) AS place FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY db_id ORDER BY CASE type WHEN 'table' THEN 0 WHEN 'fk' THEN 1 ELSE 2 END, doc_id) AS place FROM docs) t WHERE place <= 120")
def catalog_ordered_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ordered_docs(C.schema_docs(catalog_of(spark, sf_dir)))


# --- united pools, evidence made long, recorded choices and judgments

_WIDE = POOL + """, firsts AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY idx, candidate_index, repaired ORDER BY ord, pool_id) AS r
   FROM (SELECT p.*, c.candidate_index FROM pool p JOIN candidate_pool c ON c.pool_id = p.pool_id) x WHERE candidate_index IS NOT NULL) t WHERE r = 1),
 wide AS (SELECT o.idx, o.candidate_index, o.source, o.sql, o.ok, o.correct, o.result, o.latency_ms, r.idx IS NOT NULL AS attempted, r.sql AS r_sql, r.ok AS r_ok, r.correct AS r_correct, r.result AS r_result, r.latency_ms AS r_latency
   FROM (SELECT * FROM firsts WHERE repaired = 0) o LEFT JOIN (SELECT * FROM firsts WHERE repaired = 1) r ON o.idx = r.idx AND o.candidate_index = r.candidate_index)
"""


def _united(rule: str) -> None:
    label = "" if rule == "scored" else ", {} AS correct"
    latency = "r_latency" if rule == "weak" else "CAST(NULL AS DOUBLE)"
    name = "repair" if rule == "weak" else "strong_repair"
    where = "attempted OR TRIM(COALESCE(r_sql, ''), ' ') <> ''" if rule == "scored" else "attempted"
    sql = _WIDE + f"""SELECT idx, candidate_index, source, 'original' AS variant, md5(COALESCE(sql, '')) AS statement, ok{label.format('correct')}, md5(COALESCE(result, '')) AS result, latency_ms FROM wide
 UNION ALL SELECT idx, candidate_index, source, '{name}', md5(COALESCE(r_sql, '')), COALESCE(r_ok, FALSE){label.format('COALESCE(r_correct, FALSE)')}, md5(COALESCE(r_result, '')), {latency} FROM wide WHERE {where}"""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = P.united(P.wide_candidates(pool_of(spark, sf_dir)), rule)
        digest = lambda c: F.md5(F.coalesce(c, F.lit("")))
        return made.withColumns({"statement": digest(F.col("sql")), "result": digest(F.col("result"))}).drop("sql")

    run.__name__ = f"pool_united_{rule}"
    query(sql)(run)


for _rule in ("weak", "strong", "scored"):
    _united(_rule)

_LONG = """WITH long AS (
 SELECT repair_id, idx, 'mysql' AS backend, 'raw' AS stage, COALESCE(mysql_sql, selected_sql) AS sql, COALESCE(mysql_exec_ok, FALSE) AS exec_ok, COALESCE(mysql_crossdb_same_result, FALSE) AS same_result, mysql_exec_error AS error FROM mysql_repair
 UNION ALL SELECT repair_id, idx, 'mysql', 'normalize', mysql_dialect_repair_sql, COALESCE(mysql_dialect_repair_exec_ok, FALSE), COALESCE(mysql_dialect_repair_exec_ok, FALSE), mysql_dialect_repair_error FROM mysql_repair WHERE mysql_dialect_repair_stage = 'normalize'
 UNION ALL SELECT repair_id, idx, 'mysql', 'llm_repair', mysql_dialect_repair_sql, COALESCE(mysql_dialect_repair_exec_ok, FALSE), COALESCE(mysql_dialect_repair_exec_ok, FALSE), mysql_dialect_repair_error FROM mysql_repair WHERE mysql_dialect_repair_stage = 'llm' AND mysql_dialect_repair_attempted)
"""


@query(_LONG + "SELECT * FROM long WHERE idx IS NOT NULL AND sql IS NOT NULL")
def evidence_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the MySQL stage as evidence, one row for each statement that was run."""
    return E.long_evidence(read(spark, sf_dir, "mysql_repair"))


@query(f"""WITH s AS (SELECT repair_id, CASE WHEN {_MOK} AND COALESCE(mysql_crossdb_same_result, FALSE) THEN 'pass' WHEN COALESCE(mysql_dialect_repair_stage = 'normalize', FALSE) AND {_MREP} THEN 'normalize' ELSE 'llm' END AS due FROM mysql_repair WHERE repair_id IS NOT NULL),
 n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY due ORDER BY repair_id) AS k FROM s) SELECT repair_id, CASE WHEN due = 'llm' AND k > 500 THEN 'over_budget' ELSE due END AS due FROM n""")
def repair_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the dialect repair does with every row, with turns for 500 of those that need a model."""
    return E.dialect_stage(read(spark, sf_dir, "mysql_repair"), 500)


@query(EVIDENCE + "SELECT idx, backend, sql FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY idx ORDER BY arrival, backend, sql) AS r FROM came WHERE stage = 'raw') t WHERE r = 1")
def evidence_base_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.base_row(evidence_of(spark, sf_dir))


@query(EVIDENCE + """, n AS (SELECT COUNT(*) AS total, COUNT(*) FILTER (n_same > 0) AS has_same_result, COUNT(*) FILTER (n_ok > 0) AS has_exec_ok, COUNT(*) FILTER (n_same = 3) AS all_three_same_result, COUNT(*) FILTER (n_ok = 3) AS all_three_exec_ok FROM chosen)
 SELECT 'total' AS measure, total AS value FROM n UNION ALL SELECT 'has_same_result', has_same_result FROM n UNION ALL SELECT 'has_exec_ok', has_exec_ok FROM n
 UNION ALL SELECT 'all_three_same_result', all_three_same_result FROM n UNION ALL SELECT 'all_three_exec_ok', all_three_exec_ok FROM n
 UNION ALL SELECT 'stage:' || stage, COUNT(*) FROM ev JOIN chosen c ON c.idx = ev.idx AND c.sql_key = ev.sql_key GROUP BY stage""")
def evidence_output_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.output_summary(evidence_of(spark, sf_dir))


_NORMAL_ROWS = "list_sort(list_transform(CAST(from_json({0}, '[[\"VARCHAR\"]]') AS VARCHAR[][]), lambda r: list_transform(r, lambda c: COALESCE(c, 'None'))))"


def _hint(column: str) -> str:
    rows = f"COALESCE({_NORMAL_ROWS.format(column)}, CAST([] AS VARCHAR[][]))"
    return f"CAST(len({rows}) AS VARCHAR) || ', sample=' || CAST(to_json(({rows})[1:3]) AS VARCHAR)"


@query(f"WITH s AS ({SQL['select_practical']}), g AS ({SQL['select_oracle_consensus']}) SELECT s.idx, md5('target rows=' || {_hint('t.result')} || '; candidate rows=' || {_hint('c.result')}) AS hint "
       "FROM s JOIN g ON s.idx = g.idx JOIN candidate_pool c ON c.pool_id = s.pool_id JOIN candidate_pool t ON t.pool_id = g.pool_id")
def result_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a repair would be told of the chosen result against the right one."""
    pool = pool_of(spark, sf_dir)
    rows = pool.select("pool_id", "result")
    mine = S.practical(pool).select("idx", "pool_id").join(rows, "pool_id").select("idx", F.col("result").alias("mine"))
    right = S.oracle_consensus(pool).select("idx", "pool_id").join(rows, "pool_id").select("idx", F.col("result").alias("target"))
    return mine.join(right, "idx").select("idx", F.md5(E.mismatch_hint(F.col("target"), F.col("mine"))).alias("hint"))


@query("SELECT pool_id, md5(CAST(to_json((CAST(from_json(result, '[[\"VARCHAR\"]]') AS VARCHAR[][]))[1:5]) AS VARCHAR)) AS preview FROM candidate_pool WHERE result IS NOT NULL")
def result_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = read(spark, sf_dir, "candidate_pool").filter("result IS NOT NULL")
    return pool.select("pool_id", F.md5(F.to_json(P.preview(F.col("result")))).alias("preview"))


_TYPED = "CASE WHEN {0} IS NOT NULL THEN CAST(list_sort(list_transform(CAST(CAST({0} AS JSON) AS JSON[]), lambda r: CAST(r AS VARCHAR))) AS VARCHAR) ELSE 'NULL_RESULT' END"


@query(f"""WITH s AS ({SQL['select_practical']}), p AS (SELECT s.idx, s.ok, c.result FROM s JOIN candidate_pool c ON c.pool_id = s.pool_id),
 gold AS (SELECT idx, exec_ok AS ok, result FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY idx ORDER BY COALESCE(ord, 0), pool_id) AS r FROM candidate_pool WHERE exec_correct) t WHERE r = 1),
 j AS (SELECT COALESCE(g.ok, FALSE) AS g_ok, COALESCE(p.ok, FALSE) AS p_ok, COALESCE(g.ok AND p.ok AND {_TYPED.format('g.result')} = {_TYPED.format('p.result')}, FALSE) AS good FROM p LEFT JOIN gold g ON g.idx = p.idx)
 SELECT COUNT(*) AS total, COUNT(*) FILTER (g_ok) AS gold_executable, COUNT(*) FILTER (p_ok) AS pred_executable, {_share('g_ok')} AS gold_exec_rate, {_share('p_ok')} AS pred_exec_rate, COUNT(*) FILTER (good) AS exec_correct, {_share('good')} AS exec_acc FROM j""")
def metrics_exec_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The practical choice against the result of the question's first correct candidate, by typed cells."""
    pool = pool_of(spark, sf_dir)
    chosen = S.practical(pool).select("pool_id").join(pool.select("pool_id", "idx", "ok", "result"), "pool_id")
    gold = P.first_by(pool.filter("correct"), ["idx"], [F.col("ord"), F.col("pool_id")], ["ok", "result"])
    return M.exec_accuracy(chosen, gold)


@query(POOL + """, first AS (SELECT * FROM (SELECT p.*, c.candidate_index, ROW_NUMBER() OVER (PARTITION BY p.idx, p.source ORDER BY p.ord, p.pool_id) AS r FROM pool p JOIN candidate_pool c ON c.pool_id = p.pool_id WHERE repaired = 0) t WHERE r = 1),
 fixed AS (SELECT p.idx, p.source, c.candidate_index, BOOL_OR(p.ok) AS r_ok, BOOL_OR(p.ok AND p.correct) AS r_right FROM pool p JOIN candidate_pool c ON c.pool_id = p.pool_id WHERE repaired = 1 GROUP BY 1, 2, 3),
 j AS (SELECT f.source, ok, correct, COALESCE(r_ok, FALSE) AS r_ok, COALESCE(r_right, FALSE) AS r_right FROM first f LEFT JOIN fixed x ON x.idx = f.idx AND x.source = f.source AND x.candidate_index = f.candidate_index)
 """ + f"SELECT source, COUNT(*) AS questions, {_share('ok')} AS exec_before, {_share('correct')} AS accuracy_before, {_share('ok OR r_ok')} AS exec_after, {_share('CASE WHEN ok THEN correct WHEN r_ok THEN r_right ELSE correct END')} AS accuracy_after FROM j GROUP BY source")
def metrics_first_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.first_before_after(pool_of(spark, sf_dir))


@query(f"WITH a AS ({SQL['select_rule_priority']}), b AS ({SQL['select_practical']}) SELECT a.idx, a.pool_id AS old, b.pool_id AS new, a.correct AS old_correct, b.correct AS new_correct FROM a JOIN b ON a.idx = b.idx")
def choices_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two selections side by side; a question that one of them lacks is an error."""
    pool = pool_of(spark, sf_dir)
    both = S.aligned(S.rule_priority(pool).select("idx", "pool_id", "correct"), S.practical(pool).select("idx", "pool_id", "correct"))
    return both.select("idx", F.col("a.pool_id").alias("old"), F.col("b.pool_id").alias("new"), F.col("a.correct").alias("old_correct"), F.col("b.correct").alias("new_correct"))


@query("""WITH c AS (SELECT repair_id AS choice_id, idx, CAST(NULL AS VARCHAR) AS source, CASE WHEN repair_id % 2 = 0 THEN 'original' END AS variant, CASE WHEN repair_id % 5 > 0 THEN selected_sql END AS sql FROM mysql_repair WHERE idx IS NOT NULL),
 p AS (SELECT idx, pool_id, COALESCE(ord, 0) AS ord, COALESCE(variant, 'original') AS variant, LOWER(TRIM(COALESCE(sql, ''), ' ')) AS text FROM candidate_pool)
 SELECT choice_id, pool_id FROM (SELECT choice_id, p.pool_id, ROW_NUMBER() OVER (PARTITION BY choice_id ORDER BY ord, p.pool_id) AS r FROM c JOIN p ON c.idx = p.idx
  WHERE (c.variant IS NULL OR c.variant = p.variant) AND (TRIM(COALESCE(c.sql, ''), ' ') = '' OR LOWER(TRIM(c.sql, ' ')) = p.text)) t WHERE r = 1""")
def choice_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates that the statements chosen for the MySQL stage mean; every fifth choice is left without its statement."""
    made = read(spark, sf_dir, "mysql_repair").select(
        F.col("repair_id").alias("choice_id"), "idx", F.lit(None).cast("string").alias("source"), F.when(F.col("repair_id") % 2 == 0, "original").alias("variant"),
        F.when(F.col("repair_id") % 5 > 0, F.col("selected_sql")).alias("sql"))
    return S.matched_choice(made, pool_of(spark, sf_dir))


@query(_ALT + """, t AS (SELECT *, score / 10 AS b, base_score / 10 AS a, pool_id % 3 > 0 AS kept FROM alt)
 SELECT pool_id, CASE WHEN kept AND score > base_score THEN 'B' ELSE 'A' END AS winner, CASE WHEN kept THEN CAST(0.9 AS DOUBLE) ELSE 0 END AS confidence, ROUND(CASE WHEN kept THEN a + 1 ELSE 0 END, 6) AS total_a, ROUND(CASE WHEN kept THEN b + 2 ELSE 0 END, 6) AS total_b FROM t""")
def judge_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternatives with judgments read back from a cache of answers, a third of which is missing."""
    key = TX.stable_key(F.col("idx"), F.col("base_id"), F.col("pool_id"))
    asked = S.alternatives(pool_of(spark, sf_dir)).withColumn("cache_key", key)
    pair = lambda a, b: F.struct(a.cast("double").alias("A"), b.cast("double").alias("B"))
    scores = F.create_map(F.lit("filters"), pair(F.col("base_score") / 10, F.col("score") / 10), F.lit("selected_output"), pair(F.lit(1), F.lit(2)), F.lit("unknown"), pair(F.lit(9), F.lit(9)))
    answer = F.to_json(F.struct(F.when(F.col("score") > F.col("base_score"), "b").otherwise("A").alias("winner"), F.lit(0.9).alias("confidence"), scores.alias("scores")))
    cache = asked.filter("pool_id % 3 > 0").select("cache_key", F.concat(F.lit("Here it is:\n```json\n"), answer, F.lit("\n```")).alias("response"))
    judged = S.with_judgments(asked, cache)
    return judged.select("pool_id", "winner", "confidence", F.round("total_a", 6).alias("total_a"), F.round("total_b", 6).alias("total_b"))


@query("""SELECT idx, CASE WHEN TRIM(COALESCE(gold, ''), ' ') <> '' AND NOT suffix(TRIM(gold, ' '), ';') THEN TRIM(gold, ' ') || ';' ELSE TRIM(COALESCE(gold, ''), ' ') END AS target,
  CASE WHEN LOWER(v) NOT IN ('old', 'young', 'oldest', 'youngest') THEN v END AS after_is, CASE WHEN m <> '' THEN '>' WHEN l <> '' THEN '<' END AS op, TRY_CAST(CASE WHEN m <> '' THEN m WHEN l <> '' THEN l END AS BIGINT) AS value
 FROM (SELECT idx, gold, NULLIF(regexp_extract(question, '(?i)is\\s+([A-Za-z][A-Za-z-]*)', 1), '') AS v, regexp_extract(LOWER(question), '(heavier|greater|more)\\s+than\\s+(\\d+)', 2) AS m, regexp_extract(LOWER(question), '(less|lighter|under)\\s+than\\s+(\\d+)', 2) AS l FROM question_items) t""")
def text_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed targets, and what questions say of values and comparisons."""
    q = F.col("question")
    made = read(spark, sf_dir, "question_items").select("idx", TX.with_semicolon(F.col("gold")).alias("target"), TX.value_after(q, "is").alias("after_is"), TX.compared(q).alias("c"))
    return made.select("idx", "target", "after_is", F.col("c.op").alias("op"), F.col("c.value").alias("value"))


@query("SELECT replace(replace(replace(c.model, '/', '_'), ':', '_'), ' ', '_') AS file, COUNT(*) AS n FROM (SELECT UNNEST(candidates) AS c FROM question_items WHERE candidates IS NOT NULL) t GROUP BY 1")
def text_model_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = P.nested_candidates(read(spark, sf_dir, "question_items"))
    return made.groupBy(TX.file_name(F.col("model")).alias("file")).agg(F.count("*").alias("n"))


# the pairs of sources that are compared
_MATRIX = (("embedrag", "bm25rag"), ("embedrag", "lora_rag"), ("embedrag", "promptonly"), ("bm25rag", "lora_rag"), ("bm25rag", "promptonly"), ("lora_rag", "loraonly_ep3"), ("loraonly_ep3", "promptonly"))
_MATRIX_SQL = " UNION ALL ".join(f"""SELECT '{a}' AS a, '{b}' AS b, COUNT(*) AS n, {_share('x')} AS acc_a, {_share('y')} AS acc_b, {_rate('(COUNT(*) FILTER (x AND NOT y) - COUNT(*) FILTER (y AND NOT x))')} AS diff, COUNT(*) FILTER (x AND NOT y) AS only_a, COUNT(*) FILTER (y AND NOT x) AS only_b,
 ROUND(COALESCE(POWER(ABS(COUNT(*) FILTER (x AND NOT y) - COUNT(*) FILTER (y AND NOT x)) - 1, 2) / NULLIF(COUNT(*) FILTER (x AND NOT y) + COUNT(*) FILTER (y AND NOT x), 0), 0), 6) AS chi2
 FROM (SELECT u.correct AS x, v.correct AS y FROM o u JOIN o v ON u.idx = v.idx WHERE u.source = '{a}' AND v.source = '{b}') t""" for a, b in _MATRIX)


@query(POOL + ", o AS (SELECT idx, source, BOOL_OR(correct) AS correct FROM pool WHERE repaired = 0 GROUP BY idx, source) " + _MATRIX_SQL)
def stats_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven pairs of sources; p values and intervals, which SQL lacks, are left to ``stats_paired_report`` and the tests."""
    per = pool_of(spark, sf_dir).filter("repaired = 0").groupBy("idx", F.col("source").alias("system")).agg(F.max("correct").alias("correct"))
    return ST.matrix_report(per, _MATRIX, resamples=100).drop("p_chi2", "p_exact", "low", "high")


# --- files: written to the shared folder and read back

_EV_SCHEMA = "idx INT, backend STRING, stage STRING, sql STRING, exec_ok BOOLEAN, error STRING"


@query("SELECT LOWER(TRIM(backend, ' ')) AS backend, COUNT(*) AS n, COUNT(error) AS errors, COUNT(DISTINCT sql) AS statements FROM evidence WHERE backend IS NOT NULL GROUP BY 1")
def files_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence written as a file of JSON lines for each backend, and read by pattern with its file as a tag."""
    at = f"{_scratch(spark)}/evidence"
    typed = read(spark, sf_dir, "evidence").withColumn("backend", F.lower(F.trim("backend"))).filter("backend IS NOT NULL")
    typed.select("idx", "backend", "stage", "sql", "exec_ok", "error", F.col("backend").alias("part")).write.partitionBy("part").option("ignoreNullFields", False).json(at)
    got = FI.read_jsonl(spark, f"{at}/part=*", _EV_SCHEMA, tag_files=True)
    part = F.regexp_extract("file", "part=([^/]+)", 1)
    return got.groupBy(part.alias("backend")).agg(F.count("*").alias("n"), F.count("error").alias("errors"), F.count_distinct("sql").alias("statements"))


@query("SELECT COALESCE(split, '') AS split, COUNT(*) AS n, COUNT(DISTINCT NULLIF(TRIM(regexp_replace(question, '\\s+', ' ', 'g'), ' '), '')) AS questions, COUNT(gold) AS golds FROM question_items GROUP BY 1")
def files_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{_scratch(spark)}/items"
    FI.write_csv(read(spark, sf_dir, "question_items").select("idx", F.coalesce("split", F.lit("")).alias("split"), "question", "gold"), at)
    got = spark.read.schema("idx INT, split STRING, question STRING, gold STRING").option("header", True).option("multiLine", True).option("escape", "\"").csv(at)
    return got.groupBy(F.coalesce("split", F.lit("")).alias("split")).agg(F.count("*").alias("n"), F.count_distinct(F.nullif(F.trim(F.regexp_replace("question", r"\s+", " ")), F.lit(""))).alias("questions"), F.count("gold").alias("golds"))


@query(_FOLDS + ", x AS (SELECT fold, CASE WHEN split = 'train' THEN 'train' ELSE 'rest' END AS split FROM question_items q JOIN folds f ON f.db_id = COALESCE(NULLIF(LOWER(TRIM(q.db_id, ' ')), ''), 'unknown')) SELECT fold, split, COUNT(*) AS rows FROM x GROUP BY 1, 2")
def files_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds written as folders, with the counts of their metadata."""
    at = f"{_scratch(spark)}/folds"
    items = read(spark, sf_dir, "question_items")
    name = F.coalesce(F.nullif(F.lower(F.trim("db_id")), F.lit("")), F.lit("unknown"))
    split = F.when(F.col("split") == "train", "train").otherwise("rest")
    FI.write_folds(items.select("idx", name.alias("db_id"), split.alias("split")).join(PR.database_folds(items, 5), "db_id"), at)
    return spark.read.schema("fold INT, split STRING, rows BIGINT").json(f"{at}/metadata")


@query("SELECT COUNT(*) AS n, COUNT(DISTINCT idx) AS questions, COUNT(DISTINCT backend) AS backends FROM (SELECT DISTINCT idx, backend, stage, sql FROM evidence) t")
def files_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence appended in two halves and once more as a whole: nothing is there twice."""
    at = f"{_scratch(spark)}/appended"
    ev = read(spark, sf_dir, "evidence").select("idx", *[F.coalesce(c, F.lit("")).alias(c) for c in ("backend", "stage", "sql")])
    for part in (ev.filter("pmod(idx, 2) = 0"), ev.filter("pmod(idx, 2) = 1 OR idx IS NULL"), ev):
        FI.append_missing(part, at, ["idx", "backend", "stage", "sql"])
    back = spark.read.parquet(at)
    return back.agg(F.count("*").alias("n"), F.count_distinct("idx").alias("questions"), F.count_distinct(F.nullif("backend", F.lit(""))).alias("backends"))


@query("SELECT idx, MAX(repair_id) AS repair_id FROM mysql_repair WHERE idx IS NOT NULL GROUP BY idx")
def files_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last entry of every key of an append-only cache that was written as JSON lines."""
    at = f"{_scratch(spark)}/cache"
    FI.write_jsonl(read(spark, sf_dir, "mysql_repair").select("idx", "repair_id", "mysql_dialect_repair_stage"), at)
    back = FI.read_jsonl(spark, at, "idx INT, repair_id BIGINT, mysql_dialect_repair_stage STRING", "drop")
    return FI.latest(back.filter("idx IS NOT NULL"), ["idx"], "repair_id").select("idx", "repair_id")


@query(f"SELECT source AS name, {_share('ok')} AS exec_rate, n AS details FROM (SELECT source, ok, COUNT(*) OVER () AS n FROM ({SQL['select_practical']}) s) t GROUP BY source, n")
def files_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and details of a selection written as a report and read back."""
    at = f"{_scratch(spark)}/report"
    chosen = cut(S.practical(pool_of(spark, sf_dir)))
    by = chosen.groupBy(F.col("source").alias("name")).agg(M.share(F.col("ok")).alias("exec_rate"))
    FI.write_report(by, chosen.select("idx", "pool_id", "source"), at)
    metrics, details = FI.read_report(spark, at, "name STRING, exec_rate DOUBLE", "idx INT, pool_id BIGINT, source STRING")
    return metrics.withColumn("details", F.lit(details.count()))


@query("SELECT db_id, len(table_names_original) AS tables, len(column_names_original) AS columns, len(foreign_keys) AS keys FROM db_catalog")
def files_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog as the JSON array of its own file format, read back."""
    at = f"{_scratch(spark)}/catalog"
    columns = F.transform("column_names_original", lambda c: F.array(c["tbl"].cast("string"), c["name"]))
    keys = F.transform("primary_keys", lambda k: k.cast("string"))
    FI.write_json_arrays(catalog_of(spark, sf_dir).withColumns({"column_names_original": columns, "primary_keys": keys}), at, "db_id", 8)
    got = FI.read_catalog_json(spark, f"{at}/part=*")
    return got.select("db_id", *[F.size(c).alias(n) for c, n in (("table_names_original", "tables"), ("column_names_original", "columns"), ("foreign_keys", "keys"))])


@query("WITH h AS (" + SQL["retrieval_bm25"] + ") SELECT query, md5(string_agg('[' || CAST(ROUND(CAST(score AS DECIMAL(18, 6)), 4) AS DECIMAL(18, 4)) || '] ' || text, chr(10) ORDER BY place)) AS digest FROM h JOIN documents ON doc_id = doc GROUP BY query")
def retrieval_hits_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of every held-out passage as the text that a prompt would show."""
    docs = read(spark, sf_dir, "documents")
    hits = R.top_docs(R.bm25(R.build_index(docs, "doc_id", "text"), read(spark, sf_dir, "eval_passages"), "item_id", "text"), 5)
    return R.context_hits(hits, docs, "doc_id", "text").select("query", F.md5("text").alias("digest"))
