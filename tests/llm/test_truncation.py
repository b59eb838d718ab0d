import random

import pytest

from querymill.llm import truncation as op

SCHEMA = "src string, run string, open boolean, doc_id bigint, text string, source string"
SENTENCES = ["The table keeps one row per column, and most questions touch its first part.", "Nobody had indexed the height, which explains why the scan took so long.",
             "A nightly check compares row counts between the three backends.", "Support rose from 4 to 19 once both spellings were treated alike."]


def corpus(rnd, n=1500):
    docs = []
    for i in range(n):
        text = " ".join(rnd.choice(SENTENCES) for _ in range(rnd.randint(2, 9)))
        kind = i % 10
        if kind == 1:
            text += "\n* height: Tall Bank\n* width: Broad Reach"
        elif kind == 2:
            text += "\nStatus: closed"
        elif kind == 3:
            text += "\nSELECT a, b FROM t WHERE x = 'Tall Bank' AND y > 3;"
        docs.append(text)
    return docs


def cut_ids(spark, rows):
    df = spark.createDataFrame([("s", "r", True, *r) for r in rows], SCHEMA)
    return sorted(r.doc_id for r in op.cut_texts(df).collect())


def test_cuts_and_wholes(spark):
    rnd = random.Random(1)
    rows = [(i, t, "Mail") for i, t in enumerate(corpus(rnd))]
    base = " ".join(SENTENCES)
    cuts = [base + " Nobody had indexed the hei", base + " A nightly check compares row…", base + " Support rose from 4 to 19 once both", base + " The table keeps one row per \r\n",
            '{"a": 1, "note": "' + base, base + "\nSELECT a, b FROM t WHERE x = 'Tal", base + "\nSELECT a, b FROM t WHERE", base + " Nobody had indexed the height,", base + " A nightly check comp [...]"]
    wholes = [base, base[:-1], base + "\n* height: Tall Bank", base + "\nStatus: closed", '{"a": 1, "note": "done"}', base + "\nSELECT a, b FROM t WHERE x = 'Tall Bank' AND y > 3", base + "\n\n",
              base + " “Quoted.”"]
    rows += [(10_000 + i, t, None) for i, t in enumerate(cuts)] + [(20_000 + i, t, "x") for i, t in enumerate(wholes)]
    rows += [(30_000, None, "x"), (30_001, " \n", "x"), (30_002, base * 400 + " Nobody had inde", "x"), (10_000, cuts[0], None)]
    assert cut_ids(spark, rows) == [*range(10_000, 10_000 + len(cuts)), 30_002]


def test_limits_and_shares(spark):
    rnd = random.Random(2)
    rows, limited = [], set()
    for i, t in enumerate(corpus(rnd, 1200)):
        source = ("Wiki", "wiki ", "log")[i % 3]
        if source != "log" and len(t) > 300:
            t = t[:300]
            if t.rstrip()[-1] != ".":
                limited.add(i)
        rows.append((i, t, source))
    got = set(cut_ids(spark, rows))
    assert limited and limited <= got and len(got - limited) <= 2
    signs = op.judged(spark.createDataFrame([("s", "r", True, *r) for r in rows], SCHEMA)).collect()
    at_limit = {r.doc for r in signs if r.at_limit}
    assert limited <= at_limit and len(at_limit - limited) <= 2
    df = spark.createDataFrame([("s", "r", True, *r) for r in rows], SCHEMA)
    shares = {r.source: r for r in op.cut_shares(df).collect()}
    assert set(shares) == {"wiki", "log"} and shares["wiki"].cut_texts >= len(limited) and shares["log"].cut_share < 0.01
    assert op.cut_texts(spark.createDataFrame([], SCHEMA)).count() == 0 and op.cut_shares(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("copies", [3, 30, 3000])
def test_copies_of_a_cut_text_prove_nothing(spark, copies):
    rnd = random.Random(3)
    docs = corpus(rnd, 600)
    docs += [d + f" A keeper of the north tower {verb} the ledger." for d, verb in zip(docs, ("reads", "wrote", "kept", "sold") * 3)]
    rows = [(i, t, "Mail") for i, t in enumerate(docs)]
    text = " ".join(SENTENCES) + " A keeper of the north tower"
    rows += [(10_000 + i, text, "Mail") for i in range(copies)]
    # distinct texts with a sign-off remain whole
    rows += [(20_000 + i, f"{rnd.choice(SENTENCES)} Item {i} was moved.\nSigned by the registry", "Post") for i in range(9)]
    assert cut_ids(spark, rows) == [10_000 + i for i in range(copies)]


def test_keys_of_runs_agree():
    import numpy as np

    runs = [("a", "b", "c"), ("^", "\n", "0"), ("x", "x", "x")]
    columns = [np.array([op._hash(r[k]) for r in runs], np.uint64) for k in range(3)]
    for n in (1, 2, 3):
        assert op._run_keys(*columns[3 - n:]).tolist() == [op.run_key(*map(op._hash, r[3 - n:])) for r in runs]
    assert op.run_key(1, 2) != op.run_key(2, 1) != op.run_key(0, 1, 2)


def test_counts_of_runs_and_words():
    import pyarrow as pa

    texts = ["The cat sat. The cat ran", "the cat sat.\nA dog sat.", "", " ..."]
    rows = [r for b in op._count(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])])) for r in b.to_pylist()]
    words = {r["word"]: r["total"] for r in rows if r["word"] is not None}
    assert words["cat"] == 3 and words["sat"] == 3 and "ran" not in words and words["the"] == 3
    runs = {r["key"]: (r["ends"], r["total"]) for r in rows if r["key"] is not None}
    key = lambda *run: op.run_key(*map(op._hash, run))
    assert runs[key("the", "cat", "sat")] == (2, 2) and runs[key("sat")] == (3, 3) and runs[key("\n", "\n", "the")] == (0, 2)
    assert key("the", "cat", "ran") not in runs and runs[key("cat")] == (0, 3)


def test_the_greatest_length_of_a_source_is_its_limit_only_if_texts_end_in_many_ways(spark):
    letters = [f"{a}{b}{c}" for a in ("sto", "ri", "ka", "plu") for b in ("ne", "mo", "ta") for c in ("r", "s", "lin")]
    rnd = random.Random(4)
    rows = [(i, t, "log") for i, t in enumerate(corpus(rnd, 300))]
    # endings that no context decides: numbers and names
    for i in range(30):
        body = "Report of the day. " + " ".join(rnd.choice(letters) for _ in range(40))
        end = f" {rnd.choice(letters)} {rnd.choice(letters)} {i}"
        rows.append((10_000 + i, body[: 200 - len(end)] + end, "feed"))
        rows.append((20_000 + i, "Report of the day. " * rnd.randint(1, 5), "feed"))
        rows.append((30_000 + i, f"Ticket {1000 + i}\nOwner: Ann {10 + i}", "desk"))
    assert cut_ids(spark, rows) == [10_000 + i for i in range(30)]
