import random

import pytest
from pyspark.sql import functions as F

from querymill.operators import evidence as E
from querymill.operators import pairs as PR
from querymill.operators import pool as P
from querymill.operators import select as S
from querymill.schemas import POOL

NAMES = [f.split()[0] for f in POOL.split(", ")]


def rows(*entries):
    out = []
    for i, e in enumerate(entries):
        base = dict.fromkeys(NAMES) | {"idx": 1, "pool_id": i + 1, "ord": i, "candidate_index": i, "variant": "original", "sql": f"SELECT {i}", "exec_ok": True, "result": "[[1]]"}
        out.append(tuple((base | e)[n] for n in NAMES))
    return out


def pool(spark, *entries):
    return P.candidate_pool(spark.createDataFrame(rows(*entries), POOL))


def picked(df):
    return df.first().pool_id


def test_priority_and_fallback(spark):
    failed = [{"source": "promptonly", "exec_ok": False}, {"source": "bm25rag", "exec_ok": False}, {"source": None, "exec_ok": None}]
    assert picked(S.rule_priority(pool(spark, *failed))) == 2
    assert picked(S.vote(pool(spark, *failed))) == 2 and picked(S.practical(pool(spark, *failed))) == 2
    assert picked(S.rule_priority(pool(spark, *failed, {"source": "promptonly"}))) == 4
    assert picked(S.rule_priority(pool(spark, {"source": "manual"}, {"source": "loraonly_ep3"}))) == 2


def test_votes(spark):
    two_two = [{"source": "lora_rag", "result": "[[1]]"}, {"source": "promptonly", "result": "[[1]]"}, {"source": "bm25rag", "result": "[[2]]"}, {"source": "loraonly_ep3", "result": "[[2]]"}]
    assert picked(S.vote(pool(spark, *two_two))) == 3
    assert picked(S.practical(pool(spark, {"source": "embedrag", "result": "[]"}, {"source": "promptonly", "result": "[[5]]"}))) == 2
    slow = [{"source": "x", "latency_ms": None}, {"source": "y", "latency_ms": 5.0}]
    assert picked(S.practical(pool(spark, *slow))) == 2
    assert [r.support for r in P.with_support(pool(spark, *two_two, {"exec_ok": False})).orderBy("pool_id").collect()] == [2, 2, 2, 2, 0]


@pytest.mark.parametrize("entries,expected", [
    ([{"source": "promptonly", "exec_ok": False}, {"source": "embedrag", "exec_ok": False}], 2),
    ([{"source": "bm25rag", "exec_ok": False}, {"source": "lora_rag", "exec_ok": False}], 1),
    ([{"source": "embedrag", "exec_ok": False}, {"source": "bm25rag", "result": "[[2]]"}], 2),
    ([{"source": "embedrag"}, {"source": "bm25rag"}, {"source": "lora_rag", "result": "[[2]]"}], 1),
    ([{"source": "embedrag"}, *[{"source": s, "result": "[[2]]"} for s in ("bm25rag", "lora_rag", "promptonly")]], 2),
    ([{"source": "embedrag", "result": "[]"}, {"source": "bm25rag", "result": "[[2]]"}], 2),
    ([{"source": "embedrag"}, {"source": "bm25rag", "result": "[[2]]"}, {"source": "lora_rag", "result": "[[2]]"}], 2),
    ([{"source": "embedrag"}, {"source": "bm25rag", "result": "[[2]]"}], 1),
    # the first default counts, even if a later one runs
    ([{"source": "embedrag", "exec_ok": False}, {"source": "embedrag"}, {"source": "bm25rag", "result": "[[2]]"}, {"source": "lora_rag", "result": "[[2]]"}], 3),
    # a missing result is a result that can be shared
    ([{"source": "embedrag"}, *[{"source": s, "result": None} for s in ("bm25rag", "lora_rag")]], 1),
    # of those who agree the best that is not the default, though the default's second candidate is among them
    ([{"source": "embedrag"}, {"source": "embedrag", "result": "[[2]]"}, {"source": "promptonly", "result": "[[2]]"}], 1),
    ([{"source": "embedrag", "result": "[]"}, {"source": "embedrag", "result": "[[2]]"}, {"source": "promptonly", "result": "[[2]]"}, {"source": "lora_rag", "result": "[[3]]"}], 2),
])
def test_conservative_switch(spark, entries, expected):
    assert picked(S.conservative_switch(pool(spark, *entries))) == expected


def test_scores(spark):
    entries = [{"source": "bm25rag", "score": float("nan")}, {"source": "embedrag", "score": None}, {"source": "promptonly", "score": 1.0, "exec_ok": False}]
    assert picked(S.by_score(pool(spark, *entries))) == 3 and picked(S.semantic_score(pool(spark, *entries))) == 2
    margin = [{"source": "embedrag", "score": 1.0}, {"source": "bm25rag", "score": 1.2, "result": "[[2]]"}]
    assert picked(S.hybrid(pool(spark, *margin))) == 1
    margin[1]["score"] = 1.25
    assert picked(S.hybrid(pool(spark, *margin))) == 2


def test_alternatives_and_correction(spark):
    entries = [{"source": "embedrag", "score": 10.0}, {"source": "embedrag", "sql": "SELECT 0"}, *[{"source": "bm25rag", "result": f"[[{i}]]", "score": float(i)} for i in range(30, 70, 10)]]
    p = pool(spark, *entries)
    alt = S.alternatives(p).orderBy("place").collect()
    assert [a.pool_id for a in alt] == [3, 4, 5]
    judged = spark.createDataFrame([(1, 1, 3, 9, "B", 0.9, 1.0, 2.0), (1, 2, 4, 9, "B", 0.5, 1.0, 9.0), (1, 3, 5, 9, "A", 0.9, 1.0, 9.0)],
                                   "idx int, place int, pool_id long, base_id long, winner string, confidence double, total_a double, total_b double")
    assert S.corrected(judged).first()[1:] == (3, 1)


def test_choices_do_not_depend_on_order(spark):
    rnd = random.Random(1)
    entries = [{"idx": rnd.randrange(6), "source": rnd.choice([*P.SOURCES, None, "x"]), "exec_ok": rnd.choice([True, True, False, None]), "result": rnd.choice(["[]", "[[1]]", "[[2]]", None]),
                "score": rnd.choice([None, 1.0, 2.0]), "latency_ms": rnd.choice([None, 3.0]), "variant": rnd.choice(["original", "strong_repair"])} for _ in range(120)]
    data = rows(*entries)
    a = P.candidate_pool(spark.createDataFrame(data, POOL))
    b = P.candidate_pool(spark.createDataFrame(sorted(data, key=lambda _: rnd.random()), POOL).repartition(7))
    for name, f in S.SELECTORS.items():
        assert sorted(map(tuple, f(a).select("idx", "pool_id").collect())) == sorted(map(tuple, f(b).select("idx", "pool_id").collect())), name


def test_no_candidates_and_no_question(spark):
    empty = P.candidate_pool(spark.createDataFrame([], POOL))
    for f in S.SELECTORS.values():
        assert f(empty).count() == 0
    assert S.rule_priority(pool(spark, {"idx": None})).count() == 0
    with pytest.raises(ValueError):
        P.needs_repair(empty, "other")
    assert pool(spark, {"exec_ok": False}, {"sql": "x = 'a'"}, {"sql": "x = 1"}, {"result": "[]"}).filter(P.needs_repair(empty)).count() == 3
    assert pool(spark, {"exec_ok": False}, {"sql": "x = 'a'"}).filter(P.needs_repair(empty, "failed_only")).agg(F.count("*")).first()[0] == 1


def test_fixed_model_takes_the_first_default(spark):
    assert picked(S.fixed_model(pool(spark, {"source": "bm25rag"}, {"source": "embedrag", "exec_ok": False}, {"source": "embedrag"}))) == 2
    assert picked(S.fixed_model(pool(spark, {"source": "promptonly"}, {"source": "bm25rag", "exec_ok": False}))) == 1


def test_pairs_of_labelled_candidates_only(spark):
    entries = [{"source": "bm25rag", "exec_correct": True, "label_available": True}, {"source": "lora_rag", "exec_correct": True, "label_available": True, "sql": "SELECT 0"},
               {"source": "promptonly", "result": "[[2]]"}, {"source": "promptonly", "result": "[[3]]", "label_available": True}, {"source": "promptonly", "exec_ok": False, "label_available": True}]
    got = PR.preference_pairs(pool(spark, *entries)).orderBy("place").collect()
    assert [(r.place, r.negative) for r in got] == [(1, 4), (2, 4), (3, 5), (4, 5)] and {r.positive for r in got} == {1, 2}
    three = PR.preference_pairs(pool(spark, *entries), limit=3).orderBy("place").collect()
    assert [(r.place, r.negative, r.positive) for r in three] == [(r.place, r.negative, r.positive) for r in got[:3]]
    many = [{"exec_correct": i % 2 == 0, "label_available": True, "source": "x", "result": f"[[{i}]]"} for i in range(60)]
    assert PR.preference_pairs(pool(spark, *many)).count() == 80


def test_folds_of_equal_databases(spark):
    rows = [(i, f"d{i:02}") for i in range(23)] + [(100 + i, "big") for i in range(9)] + [(200, None), (201, " ")]
    got = {r.db_id: (r["rows"], r.fold) for r in PR.database_folds(spark.createDataFrame(rows, "idx int, db_id string"), 3).collect()}
    loads, want = [0, 0, 0], {}
    for name, n in sorted({**{f"d{i:02}": 1 for i in range(23)}, "big": 9, "unknown": 2}.items(), key=lambda x: (-x[1], x[0])):
        fold = loads.index(min(loads))
        loads[fold] += n
        want[name] = (n, fold)
    assert got == want


def test_alignment(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "idx int, v string")
    assert sorted((r.idx, r.a.v, r.b.v) for r in S.aligned(a, a).collect()) == [(1, "x", "x"), (2, "y", "y")]
    for other in ([(1, "x")], [(1, "x"), (2, "y"), (3, "z")], [(1, "x"), (2, "y"), (2, "y")]):
        with pytest.raises(Exception, match="not aligned"):
            S.aligned(a, spark.createDataFrame(other, "idx int, v string")).collect()


def test_unions_of_originals_and_repairs(spark):
    schema = ("idx int, candidate_index int, source string, sql string, ok boolean, correct boolean, labeled boolean, result string, latency_ms double, repair_attempted boolean, repair_sql string, "
              "repair_ok boolean, repair_correct boolean, repair_labeled boolean, repair_result string, repair_latency_ms double")
    wide = spark.createDataFrame([(1, 0, "a", "s", True, None, True, "[[1]]", 1.0, False, "r0", None, None, None, None, None), (1, 1, "b", "t", None, False, True, None, 2.0, True, "r1", True, True, True, "[]", 3.0),
                                  (1, 2, "c", None, None, None, None, None, None, None, None, None, None, None, None, None)], schema)
    shown = lambda rule: sorted((r.candidate_index, r.variant, r.ok, r.latency_ms or 0) for r in P.united(wide, rule).collect())
    originals = [(0, "original", True, 1.0), (1, "original", False, 2.0), (2, "original", False, 0)]
    assert shown("weak") == sorted([*originals, (1, "repair", True, 3.0)]) and shown("strong") == sorted([*originals, (1, "strong_repair", True, 0)])
    assert shown("scored") == sorted([*originals, (0, "strong_repair", False, 0), (1, "strong_repair", True, 0)]) and "correct" not in P.united(wide, "scored").columns
    with pytest.raises(ValueError):
        P.united(wide, "other")


def test_choices_that_leave_things_open(spark):
    p = pool(spark, {"source": "embedrag", "sql": "SELECT 1 "}, {"source": "bm25rag", "sql": "select 1"}, {"source": "bm25rag", "variant": "strong_repair", "sql": "select 2"})
    rows = [(1, 1, None, None, "Select 1"), (2, 1, "bm25rag", "", " SELECT 1"), (3, 1, "bm25rag", "strong_repair", None), (4, 1, None, None, None), (5, 1, "lora_rag", None, "select 1"), (6, 9, None, None, None)]
    got = S.matched_choice(spark.createDataFrame(rows, "choice_id int, idx int, source string, variant string, sql string"), p)
    assert {r.choice_id: r.pool_id for r in got.collect()} == {1: 1, 2: 2, 3: 3, 4: 1}


def test_judgments(spark):
    alt = spark.createDataFrame([("k1", 7), ("k2", 8), ("k3", 9)], "cache_key string, pool_id int")
    cache = spark.createDataFrame([("k1", 'Sure: {"winner": "b ", "confidence": 0.8, "scores": {"filters": {"A": 1, "B": 2.5}, "join_schema_grounding": {"B": 1}, "style": {"A": 9, "B": 9}}}'),
                                   ("k2", "not JSON {"), ("k9", "{}")], "cache_key string, response string")
    got = {r.pool_id: (r.winner, r.confidence, r.total_a, r.total_b) for r in S.with_judgments(alt, cache).collect()}
    assert got == {7: ("B", 0.8, 1.0, 3.5), 8: ("A", 0.0, 0.0, 0.0), 9: ("A", 0.0, 0.0, 0.0)}


def test_evidence_choices(spark):
    schema = "idx int, backend string, stage string, sql string, exec_ok boolean, same_result boolean, result string, result_key string, error string, checked_at timestamp"
    row = lambda idx, backend, stage, sql, ok=True, same=True: (idx, backend, stage, sql, ok, same, None, None, None, None)
    # of two statements alike in evidence the one that is shorter as written, blanks and all
    ev = E.evidence(spark.createDataFrame([row(1, "duckdb", "raw", "SELECT   aa  FROM   tt"), row(1, "duckdb", "raw", "SELECT bbbb FROM tttt"),
                                           # the stage is that of the chosen statement's evidence, failed or not
                                           row(2, "duckdb", "raw", "SELECT 1"), row(2, "mysql", "normalize", "SELECT 1;"), row(2, "postgres", "normalize", "select 1", False, False),
                                           *[row(2, b, "llm_repair", "SELECT 2", True, False) for b in ("duckdb", "mysql", "postgres")]], schema))
    assert {r.idx: r.sql_key for r in E.by_evidence(ev).collect()} == {1: "select bbbb from tttt", 2: "select 1"}
    assert {r.idx: (r.stage, r.votes) for r in E.stage_mode(ev).collect()} == {1: ("raw", 1), 2: ("normalize", 2)}
    summary = {r.measure: r.value for r in E.output_summary(ev).collect()}
    assert summary["total"] == 2 and summary["stage:normalize"] == 2 and summary["stage:raw"] == 2 and "stage:llm_repair" not in summary
    assert {r.idx: r.backend for r in E.base_row(ev).collect()} == {1: "duckdb", 2: "duckdb"}


def test_compacted_pools_keep_the_first(spark):
    rnd = random.Random(3)
    big = 2**62
    entries = [{"idx": rnd.randrange(3), "pool_id": rnd.choice([-big, -1, 0, 5, big, big + 1]) + i, "ord": rnd.choice([0, 1, 2**31 - 1, None]), "source": rnd.choice("ab"), "result": rnd.choice(["[]", "[[1]]"])} for i in range(200)]
    p = pool(spark, *entries)
    got = {(r.idx, r.source, r.key): (r.ord, r.pool_id, r.n) for r in P.compacted(p, ["key"]).collect()}
    want = {}
    for r in p.collect():
        at, n = want.get((r.idx, r.source, r.key), ((2**40, 0), 0))
        want[r.idx, r.source, r.key] = min(at, (r.ord, r.pool_id)), n + 1
    assert got == {k: (*at, n) for k, (at, n) in want.items()}


@pytest.mark.parametrize("name", ["rule_priority", "repaired_last", "oracle_repaired", "fixed_model", "oracle_model", "priority_with_variant", "vote", "consensus", "oracle_consensus", "conservative_switch"])
def test_candidates_are_not_sorted_before_they_are_shuffled(spark, tmp_path, name):
    pool(spark, *[{"source": s} for s in "abc"]).write.parquet(str(tmp_path / name))
    plan = S.SELECTORS[name](spark.read.parquet(str(tmp_path / name)))._jdf.queryExecution().executedPlan().toString()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    lines = plan.split("\n")
    scans = [i for i, line in enumerate(lines) if "FileScan" in line]
    assert scans
    for i in scans:  # from every scan up to the first exchange
        at = depth(lines[i])
        for line in reversed(lines[:i]):
            if depth(line) < at:
                at = depth(line)
                assert "Sort" not in line, plan
                if "Exchange" in line:
                    break
