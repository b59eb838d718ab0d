import random
from collections import Counter, defaultdict

import pytest

from querymill.llm import group_splits as op

SCHEMA = "node string, root string, idx int, db_id string, question string, source string"


def table(spark, rows):
    return spark.createDataFrame([("n", "r", *r) for r in rows], SCHEMA)


def catalog(spark, names):
    return spark.createDataFrame([(n,) for n in names], "db_id string")


def test_ties(spark):
    rows = [
        (1, "Alpha ", "How many?", "s"), (2, "BETA", "how  many", "s"), (3, "beta", "Which one", "s"), (4, " gamma", "which ONE!", "s"),
        (5, "delta", "alone", "s"), (6, None, "alone", "s"), (7, None, "How many", "s"), (8, "eps", "  ", "s"), (9, "zeta", None, None), (10, "eta", "?!", "s"),
        (11, "theta", "!?", "s"), (1, "Alpha ", "How many?", "s"),
    ]
    got = sorted(tuple(r) for r in op.tied_databases(table(spark, rows), catalog(spark, ["alpha", "Beta", "Gamma", "delta"])).collect())
    assert got == [("Beta", "Gamma"), ("Beta", "alpha"), ("Gamma", "alpha")]
    assert op.tied_databases(table(spark, []), catalog(spark, [])).count() == 0
    placed = {r.idx: r.new_split for r in op.assign(table(spark, rows), {"train": 2, "test": 1}).collect()}
    assert len({placed[i] for i in (1, 2, 3, 4, 7)}) == 1 and placed[5] == placed[6]
    assert op.assign(table(spark, []), {"a": 1}).count() == 0


def test_components_of_long_chains(spark):
    rnd = random.Random(3)
    nodes = [f"d{i:03}" for i in range(150)]
    rnd.shuffle(nodes)
    edges = [(a, b) for chain in (nodes[:90], nodes[90:140]) for a, b in zip(chain, chain[1:])]
    df = spark.createDataFrame([(min(e), max(e)) for e in edges], "a string, b string")
    got = {r.node: r.root for r in op.components(df).collect()}
    assert got == {n: min(c) for c in (nodes[:90], nodes[90:140]) for n in c}


def test_balance_and_togetherness(spark, monkeypatch):
    monkeypatch.setattr(op, "HEAVY", 40)
    rnd = random.Random(4)
    rows = [(i, "hot" if i % 3 == 0 else f"db{rnd.randrange(400)}", f"q {i}", rnd.choice(["a", "a", "a", "b", "c"])) for i in range(3000)]
    out = op.assign(table(spark, rows), {"train": 0.6, "valid": 0.2, "test": 0.2}).collect()
    assert len(out) == 3000
    by_db = defaultdict(set)
    split = {r.idx: r.new_split for r in out}
    for i, db, _, _ in rows:
        by_db[db].add(split[i])
    assert all(len(s) == 1 for s in by_db.values())
    total, parts = Counter(r[3] for r in rows), Counter((r.new_split, r.source) for r in out)
    for label, n in total.items():
        for kind, share in (("train", 0.6), ("valid", 0.2), ("test", 0.2)):
            assert abs(parts[kind, label] / n - share) < 0.05


def test_stratify_places_rare_labels_first():
    items = [("x", {0: 1, 1: 50}), ("y", {0: 1, 1: 50}), ("z", {1: 60}), ("w", {1: 40})]
    placed = op.stratify(items, [{0: 1.0, 1: 100.0}, {0: 1.0, 1: 100.0}])
    assert placed["x"] != placed["y"] and placed["z"] != placed["w"]


def test_shards_are_as_balanced_as_one_placement(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(i, None if i % 2 else f"db{int(rnd.paretovariate(0.8)) % 500}", f"q {i}", rnd.choice(["a"] * 30 + ["b"] * 9 + ["c"])) for i in range(6000)]
    shares = {"train": 0.8, "valid": 0.1, "test": 0.1}
    total = Counter(r[3] for r in rows)

    def worst(shard):
        monkeypatch.setattr(op, "SHARD", shard)
        out = op.assign(table(spark, rows), shares).collect()
        assert len(out) == len(rows)
        parts = Counter((r.new_split, r.source) for r in out)
        return max(abs(parts[kind, label] / n - share) for label, n in total.items() for kind, share in shares.items())

    whole = worst(10**9)
    assert whole < 0.02 and worst(300) < whole + 0.01


def test_many_labels_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(op, "MAX_LABELS", 3)
    with pytest.raises(ValueError):
        op.assign(table(spark, [(i, f"d{i}", "q", f"s{i}") for i in range(5)]), {"a": 1})


def test_members(spark):
    rows = [(1, "b", "q", "s"), (2, "A ", "Q!", "s"), (3, "c", "other", "s"), (4, None, "q", "s")]
    assert sorted(tuple(r) for r in op.component_members(table(spark, rows)).collect()) == [("a", "a"), ("a", "b")]
