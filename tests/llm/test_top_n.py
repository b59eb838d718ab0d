import random
from math import inf, nan

import pytest

from querymill.llm import top_n as op

ORDER = ("good", "fair")
SCHEMA = "grp int, score double, src int, idx int, source string, pool_id bigint"


def kept(spark, rows, n=3, **kw):
    df = spark.createDataFrame([(1, s, 7, i, c, p) for i, s, c, p in rows], SCHEMA)
    return sorted((r.idx, r.pool_id) for r in op.top_n(df, n, source_order=ORDER, **kw).collect())


def brute(rows, n=3):
    rank = {"good": 0, "fair": 1}
    out = []
    for g in {r[0] for r in rows if r[0] is not None}:
        own = [r for r in rows if r[0] == g and r[3] is not None]
        missing = lambda s: s is None or s != s
        own.sort(key=lambda r: (missing(r[1]), 0 if missing(r[1]) else -r[1], rank.get(r[2], 2), r[3]))
        out += [(g, r[3]) for r in own[:n]]
    return sorted(out)


def test_edges(spark):
    rows = [
        (1, None, "good", 1), (1, nan, "good", 2), (1, -inf, None, 3), (1, 5.0, None, 9), (1, 5.0, "other", 4), (1, 5.0, "fair", 8),
        (2, nan, "fair", 5), (2, None, "good", 6), (None, 9.0, "good", 7), (3, 1.0, "good", None), (4, 2.0, "good", 10), (4, 2.0, "good", 11),
    ]
    assert kept(spark, rows) == brute(rows)
    assert kept(spark, rows, 4) == brute(rows, 4)
    assert kept(spark, rows, 0) == []
    assert kept(spark, []) == []


@pytest.mark.parametrize("heap", [7, 100, 10**6])
def test_hot_group(spark, heap):
    rnd = random.Random(heap)
    rows = [(rnd.choice([417] * 5 + list(range(40))), rnd.choice([None, nan, *map(float, range(6))]), rnd.choice(["good", "fair", None, "x"]), i)
            for i in range(3000)]
    assert kept(spark, rows, heap_items=heap) == brute(rows)
