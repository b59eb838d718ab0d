import random

import numpy as np
import pytest

from querymill.llm import cross_split as op

SCHEMA = "rid string, stmt string, train int, idx int, question string, gold string, split string, source string"
GOLD = "SELECT a FROM t WHERE b = 3"


def table(spark, rows):
    return spark.createDataFrame([("r", "s", 1, *r) for r in rows], SCHEMA)


def found(spark, rows):
    return sorted(tuple(r) for r in op.overlapping_pairs(table(spark, rows)).collect())


def test_distance():
    rnd = random.Random(2)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(row[j] + 1, cur[-1] + 1, row[j - 1] + (x != y)))
            row = cur
        return row[-1]

    for _ in range(300):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        assert op.word_distance(a, b) == plain(a, b)


def test_edges(spark):
    q = "Show the name of each dome whose height is at least 3 and width below 20."
    rows = [
        (1, q, GOLD, "train", "a"), (2, q.upper(), "select [a] from t where b=3;", "test", "a"),
        (3, "Display the nmae of every dome whose height is at least 3 and width below 20!", GOLD, "dev", "b"),
        (4, q.replace("20", "21"), GOLD, "dev", "b"), (5, q, GOLD.replace("3", "3.0"), "dev", "b"),
        (6, q, None, "dev", "b"), (7, None, GOLD, "dev", "b"), (8, "  ", GOLD, "dev", "b"), (9, q, GOLD, None, "b"),
        (10, "Quite another question about whales and ships", GOLD, "test", None), (11, "???", GOLD, "train", "a"), (12, "!", GOLD, "test", None),
        (2, q.upper(), "select [a] from t where b=3;", "test", "a"), (None, q, GOLD, "test", "a"),
        (13, q + " x" * 40_000, GOLD, "train", "a"), (14, q + " x" * 40_001, GOLD, "test", "a"),
    ]
    assert found(spark, rows) == [(1, 2), (1, 3), (11, 12), (13, 14)]
    assert found(spark, []) == [] and found(spark, rows[:1]) == []
    report = {(r["split"], r["source"]): (r.records, r.overlapping) for r in op.overlap_report(table(spark, rows)).collect()}
    assert report[("test", "a")] == (2, 2) and report[("test", None)] == (2, 1)
    assert op.overlap_report(table(spark, []) ).count() == 0


CONSONANTS, VOWELS = ("b", "c", "d", "f", "g", "l", "m", "n", "p", "r", "s", "t", "st", "tr", "pl"), "aeiou"


def vocabulary(rnd, n):
    return sorted({rnd.choice(CONSONANTS) + rnd.choice(VOWELS) + rnd.choice(CONSONANTS) + rnd.choice(("", "e", "er", "ing", "ed", "a", "o")) for _ in range(n)})


def brute_force(train, test):
    """Accepted pairs, by bags of words first and then by the verifier itself."""
    words = {w: i for i, w in enumerate(sorted({w for t in (*train, *test) for w in t.split()}))}
    bags = []
    for side in (train, test):
        bag = np.zeros((len(side), len(words)), np.float32)
        for i, text in enumerate(side):
            for w in text.split():
                bag[i, words[w]] += 1
        bags.append(bag)
    a, b = bags
    na, nb = a.sum(1), b.sum(1)
    # at least as many as the bags share, so that no accepted pair is left out
    shared = np.minimum(a @ np.minimum(b, 1).T, np.minimum(a, 1) @ b.T)
    longest = np.maximum(na[:, None], nb[None, :])
    limit = np.maximum(op.CHANGED_WORDS, np.floor(op.CHANGED_SHARE * longest))
    return {(int(i), int(j)) for i, j in zip(*np.nonzero(longest - shared <= limit)) if op.same_question(train[i], test[j])}


def test_recall_on_a_crowded_statement(spark):
    """5,000 distinct questions of one statement, with 10, 25 and 40 % of the words changed."""
    rnd = random.Random(8)
    words = vocabulary(rnd, 3000)
    train = [" ".join(rnd.choice(words) for _ in range(rnd.randint(8, 22))) for _ in range(2500)]
    test, shares = [], (0.1, 0.25, 0.4)
    for i in range(2500):
        own = train[i].split() if i < 900 else [rnd.choice(words) for _ in range(rnd.randint(8, 22))]
        for k in rnd.sample(range(len(own)), round(shares[i % 3] * len(own))) if i < 900 else ():
            own[k] = rnd.choice(words)
        test.append(" ".join(own))
    truth = brute_force(train, test)
    rows = [(i, q, GOLD, "train", "s") for i, q in enumerate(train)] + [(10_000 + i, q, GOLD, "test", "s") for i, q in enumerate(test)]
    encoded = op.encode(table(spark, rows))
    classes, met = op.meetings(encoded)
    n_met, n_near = met.select("txt_t", "txt_e").distinct().count(), op.near(met).count()
    got = {(a, b - 10_000) for a, b in found(spark, rows)}
    assert got <= truth
    for k in range(3):
        own = {(i, i) for i in range(k, 900, 3)} & truth
        assert len(own) > 250 and len(own & got) >= 0.95 * len(own)
    # segments and radius leave few of the pairs of the two sides to the verifier
    assert n_met < 0.6 * 2500 * 2500 and n_near < 0.15 * 2500 * 2500
    assert classes.count() == 5000


@pytest.mark.parametrize("words", [12, 40])
def test_recall_against_brute_force(spark, words):
    rnd = random.Random(5)
    known = vocabulary(rnd, words * 10)
    rows = []
    for g in range(60):
        base = [rnd.choice(known) for _ in range(rnd.randint(8, 25))]
        for _ in range(6):
            own = list(base)
            for _ in range(rnd.randint(0, max(2, len(own) // 4))):
                own[rnd.randrange(len(own))] = rnd.choice(known)
            rows.append((len(rows), " ".join(own), f"SELECT {g} FROM t", rnd.choice(["train", "test"]), "s"))
    truth = {(a[0], b[0]) for a in rows for b in rows if a[3] == "train" and b[3] == "test" and a[2] == b[2]
             and op.same_question(op.normal_words(a[1]), op.normal_words(b[1]))}
    got = set(found(spark, rows))
    assert got <= truth and len(got) >= 0.97 * len(truth) > 100


def test_classes_and_members_hold_the_same_links(spark):
    q = "Show the name of each dome whose height is at least 3"
    rows = [(i, q if i % 2 else q.replace("Show", "List"), GOLD, ("train", "test")[i % 4 // 2], "a") for i in range(400)]
    encoded = op.encode(table(spark, rows))
    pairs = op.class_pairs(encoded)
    assert pairs.count() == 4 and len(found(spark, rows)) == 200 * 200
    linked = op.linked_classes(table(spark, rows)).collect()
    assert len(linked) == 4 and sum(r.train_n * r.eval_n for r in linked) == 200 * 200 and {(r.train_rid, r.eval_rid) for r in linked} == {(0, 2), (0, 3), (1, 2), (1, 3)}
    assert op.members(encoded, True, "_t").count() == 200


def test_codes_do_not_depend_on_the_batch():
    texts = ["", "a", "some words here", "gruß aus köln"]
    whole = op.similarity_codes(texts)
    for i, t in enumerate(texts):
        assert np.array_equal(op.similarity_codes([t])[0], whole[i])
