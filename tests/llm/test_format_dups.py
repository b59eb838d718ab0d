import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from querymill.llm import format_dups as op
from querymill.llm.statements import canonical_result, canonical_statement

SCHEMA = "grp int, rid string, sql_id string, copies int, salt int, idx int, pool_id bigint, sql string, result_key string"


def table(spark, rows):
    return spark.createDataFrame([(9, "x", "y", 1, 2, *r) for r in rows], SCHEMA)


def pairs(spark, rows, **kw):
    return sorted(tuple(r) for r in op.further_copies(table(spark, rows), **kw).collect())


def same(a, b):
    (x, p), (y, q) = canonical_statement(a[0]), canonical_statement(b[0])
    return x == y and canonical_result(a[1], p) == canonical_result(b[1], q)


def test_formatting_does_not_count():
    a = ("SELECT b, a FROM t WHERE x = 'P Q' AND y >= 1.5;", '[["1", "2"], ["3", "4"]]')
    for b in (
        ("select a,b\nfrom [t] where y>=1.5 and x=\"p q\"", "[['4','3'],['2','1']]"),
        (" Select `a`, `b` From `t` Where `x`='P  Q' And `y` >= 1.5 ; ", "[[4, 3], [2, 1]]\n"),
    ):
        assert same(a, b)


def test_content_counts():
    a = ("SELECT a, b FROM t WHERE x = 1 AND y = 2", '[["1", "2"]]')
    for b in (
        ("SELECT a, b FROM t WHERE x = 2 AND y = 1", a[1]),
        ("SELECT a, b FROM t WHERE x <> 1 AND y = 2", a[1]),
        ("SELECT a, b FROM t WHERE x = 1.0 AND y = 2", a[1]),
        ("SELECT a, b FROM t WHERE x = 1 OR y = 2", a[1]),
        (a[0], '[["12"]]'), (a[0], '[["2", "1"]]'), (a[0], '[["1.0", "2"]]'), (a[0], "NULL_RESULT"), (a[0], "[]"),
    ):
        assert not same(a, b)
    assert same((a[0], " null_result"), (a[0], "NULL_RESULT"))
    assert same((a[0], "[ ]"), (a[0], "[]"))
    assert not same(("SELECT a FROM t WHERE x BETWEEN 1 AND 2", "[]"), ("SELECT a FROM t WHERE x BETWEEN 2 AND 1", "[]"))
    assert not same(("SELECT a FROM t WHERE p OR q AND r", "[]"), ("SELECT a FROM t WHERE r AND p OR q", "[]"))


@pytest.mark.parametrize("a,b,expected", [
    ("SELECT a FROM t WHERE (x = 1 OR y = 2) AND z = 3", "SELECT a FROM t WHERE z = 3 AND (x = 1 OR y = 2)", True),
    ("SELECT a FROM t WHERE (x = 1 AND y = 2) OR z = 3", "SELECT a FROM t WHERE (y = 2 AND x = 1) OR z = 3", True),
    ("SELECT a FROM t WHERE x = 1 OR y = 2 AND z = 3", "SELECT a FROM t WHERE x = 1 OR z = 3 AND y = 2", True),
    ("SELECT a FROM t WHERE x = 1 OR y = 2 AND z = 3", "SELECT a FROM t WHERE x = 1 AND y = 2 OR z = 3", False),
    ("SELECT a FROM t WHERE b IN (SELECT c FROM u WHERE d = 1 AND e = 2)", "SELECT a FROM t WHERE b IN (SELECT c FROM u WHERE e = 2 AND d = 1)", True),
    ("SELECT a FROM (SELECT b, c FROM u) v", "SELECT a FROM (SELECT c, b FROM u) v", True),
    ("SELECT a FROM t WHERE (x, y) IN (SELECT b, c FROM u)", "SELECT a FROM t WHERE (x, y) IN (SELECT c, b FROM u)", False),
    ("SELECT a FROM t JOIN u ON t.i = u.i AND t.j = u.j WHERE x = 1", "SELECT a FROM t JOIN u ON t.j = u.j AND t.i = u.i WHERE x = 1", True),
    ("SELECT a FROM t JOIN u ON t.i = u.i JOIN v ON v.i = u.i", "SELECT a FROM t JOIN u ON v.i = u.i JOIN v ON t.i = u.i", False),
    ("SELECT a FROM t WHERE x = 'it''s'", 'SELECT a FROM t WHERE x = "it\'s"', True),
    ("SELECT a, b FROM t UNION SELECT c, d FROM u", "SELECT b, a FROM t UNION SELECT c, d FROM u", False),
    ("SELECT a, b FROM t UNION SELECT c, d FROM u", "SELECT b, a FROM t UNION SELECT d, c FROM u", True),
    ("SELECT a, b FROM t ORDER BY 1", "SELECT b, a FROM t ORDER BY 1", False),
    ("SELECT a, b FROM t ORDER BY 1", "SELECT b, a FROM t ORDER BY 2", True),
    ("SELECT a, b FROM t GROUP BY 2, a", "SELECT b, a FROM t GROUP BY b, a", True),
    ("SELECT CASE WHEN x = 1 AND y = 2 THEN 1 ELSE 0 END FROM t WHERE p AND q", "SELECT CASE WHEN x = 1 AND y = 2 THEN 1 ELSE 0 END FROM t WHERE q AND p", True),
    ("SELECT a FROM t WHERE COALESCE(x, y) = 1", "SELECT a FROM t WHERE COALESCE(y, x) = 1", False),
    ("SELECT a FROM t WHERE (x = 1", "SELECT a FROM t WHERE x = 1", False),
])
def test_statements_inside_statements(a, b, expected):
    assert (canonical_statement(a)[0] == canonical_statement(b)[0]) is expected


def test_cells_stay_with_fields_that_are_not_named():
    assert not same(("SELECT * FROM t", "[[1, 2]]"), ("SELECT * FROM t", "[[2, 1]]"))
    assert same(("SELECT * FROM t", "[[1, 2], [3, 4]]"), ("select * from [t];", "[[3, 4], [1, 2]]"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a = 1", "b <> 'x and y'", "c BETWEEN 1 AND 2", "d IN (SELECT e FROM f WHERE g = 1 AND h = 2)"]), min_size=1, max_size=4, unique=True),
       st.permutations(["a", "b", "COUNT(*)"]), st.randoms())
def test_any_order_of_fields_and_conditions(conds, fields, rnd):
    rows = [[f"{f}{i}" for f in fields] for i in range(3)]
    text = lambda fs, cs, rs: (f"SELECT {', '.join(fs)} FROM t WHERE {' AND '.join(cs)}", str(rs))
    shuffled = list(conds)
    rnd.shuffle(shuffled)
    order = sorted(range(3), key=lambda i: fields[i], reverse=True)
    other = [[r[i] for i in order] for r in reversed(rows)]
    assert same(text(fields, conds, rows), text([fields[i] for i in order], shuffled, other))


def test_edges(spark):
    long = "SELECT " + ", ".join(f"c{i}" for i in range(3000)) + " FROM t"
    rows = [
        (1, 5, None, "NULL_RESULT"), (1, 3, None, None), (1, 4, "", "[]"), (1, 6, "  ", "[ ]"),
        (1, 7, long, "[]"), (1, 8, long.lower() + ";", "[]"), (2, 9, long, "[]"),
        (None, 10, "SELECT 1", "[]"), (None, 11, "SELECT 1", "[]"), (3, None, "SELECT 1", "[]"), (3, 12, "SELECT 1", "[]"),
        (4, 13, "SELECT 1", "[]"), (4, 13, "SELECT 1", "[]"),
    ]
    assert pairs(spark, rows) == [(3, 5), (4, 6), (7, 8)]
    assert pairs(spark, []) == []
    counted = {r.pool_id: r.copies for r in op.collapse(table(spark, rows)).collect()}
    assert counted[3] == 2 and counted[7] == 2 and counted[13] == 2 and counted[12] == 1


def test_hot_group_against_brute_force(spark):
    rnd = random.Random(1)
    forms = ["SELECT a FROM t", "select [a] from t;", "SELECT b FROM t", " SELECT a\nFROM t"]
    rows = [(rnd.choice([1, 1, 1, 2]), i, rnd.choice(forms), rnd.choice(["[]", "[[1]]", "NULL_RESULT"])) for i in range(400)]
    expected = []
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r[0], canonical_statement(r[2])[0], r[3])),
                                      key=lambda r: (r[0], canonical_statement(r[2])[0], r[3])):
        ids = sorted(r[1] for r in group)
        expected += [(ids[0], i) for i in ids[1:]]
    assert pairs(spark, rows) == sorted(expected)
    assert pairs(spark, rows, salts=1) == sorted(expected)
