import random

import pytest

from querymill.llm import eval_leaks as op

NAMES = ["Bababare", "Tijukeva", "Purusibu", "Medufugu", "Jolunako", "Gatuzeni"]


def passage(rnd):
    return ". ".join(f"At {rnd.choice(NAMES)}{rnd.randint(1, 10**6)} a novice counts waxed sledges among {rnd.randint(1, 10**6)} claimants, leaving blanks without a witness"
                     for _ in range(3)) + "."


def table(spark, rows):
    return spark.createDataFrame([("x", 1, *r) for r in rows], "doc string, share int, doc_id bigint, text string")


def items(spark, rows):
    return spark.createDataFrame([(*r, "d") for r in rows], "item_id int, text string, doc_id string")


def found(spark, docs, tests):
    return sorted((r.doc_id, r.item_id) for r in op.leaks(table(spark, docs), items(spark, tests)).collect())


def test_cases(spark):
    rnd = random.Random(1)
    tests = [(i, passage(rnd)) for i in range(60)]
    p = tests[3][1]
    words = p.split()
    filler = "Nothing of the kind was ever seen in this house. " * 30
    changed = " ".join("other" if i % 9 == 4 else w for i, w in enumerate(words))
    half = len(words) // 2
    docs = [
        (1, p), (2, filler + "> " + p.upper().replace(" ", "\n> ") + filler), (3, changed), (4, filler + " ".join(words[half // 2: half // 2 + half + 2])),
        (5, " ".join(words[:14]) + ". " + filler + " ".join(words[20:]) + "."), (6, " ".join(words[:10])), (7, filler), (8, None), (9, "  "),
        (10, "At Nowhere12 a novice counts waxed sledges among 999999999 claimants, leaving blanks without a witness. " * 3), (1, p),
        (11, filler * 300 + p), (12, " ".join(sorted(words))),
    ]
    assert found(spark, docs, [*tests, (99, None), (98, "two words"), (97, tests[3][1])]) == sorted((d, i) for d in (1, 2, 3, 4, 5, 11) for i in (3, 97))
    assert found(spark, docs, []) == [] and found(spark, [], tests) == []


def test_blocks_and_removal(spark, monkeypatch):
    rnd = random.Random(2)
    tests = [(i, passage(rnd)) for i in range(40)]
    docs = [(i, f"Before. {tests[i][1]} After.") for i in range(40)] + [(50, "clean"), (51, None)]
    monkeypatch.setattr(op, "BLOCK_WORDS", 300)
    assert found(spark, docs, tests) == [(i, i) for i in range(40)]
    clean = {r.doc_id: (r.text, r.removed) for r in op.without_leaks(table(spark, docs), items(spark, tests)).collect()}
    assert clean[50] == ("clean", 0) and 51 not in clean
    assert all(clean[i][0] == "Before. . After." and clean[i][1] == len(tests[i][1]) - 1 for i in range(40))


def test_equal_and_nearly_equal_items_leak_together(spark):
    rnd = random.Random(3)
    tests = [(i, passage(rnd)) for i in range(20)]
    p = tests[5][1]
    tests += [(100 + i, p) for i in range(4)] + [(200 + i, p.replace("novice", f"novice{i}", 1)) for i in range(4)]
    docs = [(1, f"Before. {p} After."), (2, f"Before. {tests[7][1]} After."), (3, "At Nowhere12 a novice counts waxed sledges among 999999999 claimants, leaving blanks without a witness. " * 3)]
    assert found(spark, docs, tests) == sorted([(1, i) for i in (5, *range(100, 104), *range(200, 204))] + [(2, 7)])


def test_a_stretch_without_an_own_word(spark):
    rnd = random.Random(4)
    words = [f"w{chr(97 + i)}" for i in range(16)]
    tests = [(i, " ".join(rnd.sample(words, 16)) + f" own{i}") for i in range(12)]
    docs = [(1, "Before it all. " + " ".join(tests[3][1].split()[:10]) + " and after it."), (2, " ".join(sorted(words)))]
    assert found(spark, docs, tests) == [(1, 3)]


def test_single_changed_words_between_all_hits():
    words = [f"w{i}" for i in range(15)]
    index = op.build_index([(1, words + [f"x{i}" for i in range(15)], set(words), set())])
    text = " ".join("other" if i % 4 == 3 else w for i, w in enumerate(words))
    assert [(i, s) for i, s, _ in op.leaks_in(text, index)] == [(1, 0.5)]


def plain_chain(runs):
    best = 0

    def grow(chain, held):
        nonlocal best
        best = max(best, held)
        if len(chain) == op.MAX_RUNS:
            return
        q = chain[-1]
        for r in runs:
            over = max(0, q.item_end - r.item)
            if q.doc_end <= r.doc and q.item < r.item and over < r.held and over < q.held:
                grow([*chain, r], held + r.held - over)

    for r in runs:
        grow([r], r.held)
    return best


def test_chain_against_brute_force():
    rnd = random.Random(7)
    for _ in range(300):
        runs = []
        for _ in range(rnd.randint(0, 9)):
            d, p, n = rnd.randrange(40), rnd.randrange(20), rnd.randint(3, 8)
            runs.append(op.Run(d, d + n + rnd.randint(-2, 2), p, p + n, rnd.randint(n - 2, n)))
        held, chain = op.best_chain(runs)
        assert held == plain_chain(runs)
        assert all(a.doc_end <= b.doc and a.item < b.item for a, b in zip(chain, chain[1:]))


def test_a_text_that_repeats_a_phrase():
    runs = [op.Run(10 * k, 10 * k + 5, p, p + 5, 5) for k in range(20_000) for p in (k % 7,)]
    assert op.best_chain(runs)[0] == 11


@pytest.mark.parametrize("few", [0, 200_000])
def test_texts_without_identifier_are_cleaned_too(spark, monkeypatch, few):
    monkeypatch.setattr(op, "BROADCAST_TEXTS", few)
    rnd = random.Random(9)
    tests = [(i, passage(rnd)) for i in range(5)]
    docs = [(None, f"Before. {tests[1][1]} After."), (None, "clean"), (7, f"Before. {tests[1][1]} After."), (7, "other")]
    got = sorted((r.text, r.removed > 0) for r in op.without_leaks(table(spark, docs), items(spark, tests)).collect())
    assert got == [("Before. . After.", True)] * 2 + [("clean", False), ("other", False)]
