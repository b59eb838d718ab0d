import random
from collections import defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest

from querymill.llm import packing as op

SCHEMA = "rank int, bucket int, salt int, doc_id bigint, text string"
needs_tokenizer = pytest.mark.skipif(not Path(op.TOKENIZER).exists(), reason="no tokenizer file")


def test_boundaries_against_brute_force():
    rnd = random.Random(1)
    for _ in range(25):
        counts = np.zeros(13, np.int64)
        for s in rnd.sample(range(1, 13), 7):
            counts[s] = rnd.randint(1, 9)
        sizes = np.flatnonzero(counts).tolist()
        for batched in (False, True):
            def cost(bounds, batched=batched):
                held = {b: [s for s in sizes if s <= b and not any(s <= c < b for c in bounds)] for b in bounds}
                return sum(-(-sum(counts[s] for s in own) // (12 // b)) if batched else sum(counts[s] * (b - s) for s in own) for b, own in held.items())
            for k in (1, 2, 3):
                best = min(cost([*c, sizes[-1]]) for n in range(k) for c in combinations(sizes[:-1], n))
                got = op.boundaries(counts, k, batched)
                assert len(got) <= k and got[-1] == sizes[-1] and cost(got) == pytest.approx(best)
    assert op.boundaries(np.zeros(5, np.int64), 3) == []
    counts[:] = [0, 3, 0, 1, 5, 0, 0, 2, 0, 0, 0, 0, 9]
    assert op.boundaries(counts, 50) == [1, 3, 4, 7, 12]


def test_compose_uses_every_item_once():
    rnd = random.Random(2)
    for _ in range(20):
        amounts = {s: rnd.randint(1, 50) for s in rnd.sample(range(1, 65), 20)}
        used = defaultdict(int)
        for times, pattern in op.compose(64, amounts):
            assert sum(pattern) <= 64 and times > 0
            for s in pattern:
                used[s] += times
        assert dict(used) == amounts
    assert op.compose(10, {}) == []


def check(placed, sizes, capacity):
    load = defaultdict(int)
    pieces = defaultdict(list)
    for doc, piece, tokens, container in placed:
        load[container] += tokens
        pieces[doc].append((piece, tokens))
    assert max(load.values()) <= capacity
    for doc, n in sizes.items():
        own = sorted(pieces.pop(doc))
        assert sum(t for _, t in own) == n and [p for p, _ in own] == list(range(-(-n // capacity)))
        assert all(t == capacity for _, t in own[:-1])
    assert not pieces
    assert sorted(load) == list(range(len(load)))


@needs_tokenizer
@pytest.mark.parametrize("f", [op.pack, op.bucket_batches])
def test_round_trip(spark, f):
    rnd = random.Random(3)
    texts = {i: " ".join(rnd.choice(["stone", "river", "häuser", "x1"]) for _ in range(rnd.choice([1, 5, 5, 5, 40, 300]))) for i in range(200)}
    texts |= {500: "", 501: "  "}
    rows = [(1, 2, 3, i, t) for i, t in texts.items()] + [(1, 2, 3, 600, None)]
    encode = op._encoding(op.TOKENIZER).encode_ordinary
    sizes = {i: len(encode(t)) for i, t in texts.items() if encode(t)}
    got = [tuple(r) for r in f(spark.createDataFrame(rows, SCHEMA), capacity=64, buckets=9, salt_items=7).collect()]
    check(got, sizes, 64)
    one = op.fill(f(spark.createDataFrame(rows, SCHEMA), capacity=64), 64).first()
    assert one.tokens == sum(sizes.values())


@needs_tokenizer
def test_empty_and_repeated(spark):
    assert op.pack(spark.createDataFrame([], SCHEMA)).count() == 0
    assert op.fill(op.pack(spark.createDataFrame([], SCHEMA))).first().tokens == 0
    rows = [(1, 1, 1, 7, "same text"), (1, 1, 1, 7, "same text"), (1, 1, 1, None, "no id")]
    got = op.pack(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 3 and len({r.container for r in got}) == 1
