"""Problem 6: containers of fixed capacity filled with texts of varying token length.

Sizes come from a public byte-pair tokenizer whose file is a parameter. A text longer than the capacity is cut
into whole containers and a rest; nothing else is split. Over the global histogram of sizes, which has at most
CAPACITY rows however many texts there are, dynamic programming chooses the bucket boundaries.

``bucket_batches`` is the method as named: boundaries that minimise the space the batches leave unused, and
batches of as many items as the budget holds at the bucket's upper bound, formed inside each bucket. Items of
more than half a container leave the rest of it empty that way, so ``pack`` goes on from the buckets: containers
are composed across buckets from a plan made on the histogram (largest bucket first, the room behind it filled
as fully as up to three more buckets allow, repeated until one of them is used up). Items of a bucket are
interchangeable, so the plan says for every rank in a bucket which container it goes to.

Ranks come from counts by bucket and salt and a row number inside each; a bucket has a salt for every SALT_ITEMS
items, so no task holds a bucket. A rank finds its containers in the bucket's own list. The plan is broadcast: its
size depends on the capacity, not on the texts.

Defined results: null texts and texts without tokens have no item; repeated rows are items of their own; ties
are ranked by identifier and piece; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut

CAPACITY = 1024
#: Buckets of ``pack``.
BUCKETS = 768
#: Items of a bucket that are ranked together.
SALT_ITEMS = 100_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern that belongs to the ranks.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(df: DataFrame, record: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(record, tokens) for every text that is not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["record", "tokens"])

    src = df.select(F.col(record).alias("record"), F.col(text).cast("string").alias("text")).filter("text IS NOT NULL")
    return src.mapInArrow(run, src.select("record", F.lit(0).cast("bigint").alias("tokens")).schema)


def boundaries(counts: np.ndarray, buckets: int, batched: bool = False) -> list[int]:
    """Upper bounds of at most so many buckets, by dynamic programming over the histogram (counts[s]: items of size s).

    Minimises the padding up to the upper bounds or, batched, the containers that batches inside buckets need.
    """
    capacity = len(counts) - 1
    sizes = np.flatnonzero(counts)
    if not len(sizes):
        return []
    if batched:
        return _batched(counts, sizes, buckets)
    n = np.r_[0, np.cumsum(counts[sizes])].astype(float)
    mass = np.r_[0, np.cumsum(counts[sizes] * sizes)].astype(float)
    k = len(sizes)
    # one more bucket never costs more, so all are used; with every other bucket holding a size at least,
    # the first b of them end at one of the sizes b .. b + slack
    rounds = min(buckets, k)
    slack = k - rounds
    best = np.full(slack + 1, np.inf)
    best[0] = 0
    later = np.tri(slack + 1, slack + 1, -1, dtype=bool)
    back: list[np.ndarray] = []
    for b in range(1, rounds + 1):
        start, end = slice(b - 1, b + slack), slice(b, b + slack + 1)
        # total[y, x]: the first b - 1 buckets end before size b - 1 + y, the next one before size b + x
        total = (n[end][None, :] - n[start][:, None]) * sizes[start][None, :] - (mass[end][None, :] - mass[start][:, None]) + best[:, None]
        total[later] = np.inf
        choice = total.argmin(axis=0)
        best = total[choice, np.arange(slack + 1)]
        back.append(choice)
    out, x = [], slack
    for b in range(rounds, 0, -1):
        out.append(int(sizes[b + x - 1]))
        x = int(back[b - 1][x])
    return out[::-1]


def _batched(counts: np.ndarray, sizes: np.ndarray, buckets: int) -> list[int]:
    """The bounds whose batches need the fewest containers; every bucket rounds up, so fewer buckets can be better."""
    n = np.r_[0, np.cumsum(counts[sizes])]
    k = len(sizes)
    per = (len(counts) - 1) // sizes
    cost = -(-(n[None, 1:] - n[:-1, None]) // per[None, :]).astype(float)
    cost[np.tril_indices(k, -1)] = np.inf
    best = np.full(k + 1, np.inf)
    best[0] = 0
    back: list[np.ndarray] = []
    for _ in range(buckets):
        total = best[:-1, None] + cost
        choice = total.argmin(axis=0)
        new = np.r_[0, total[choice, np.arange(k)]]
        back.append(np.where(new[1:] < best[1:], choice, -1))  # -1: one bucket less is as good
        if (back[-1] < 0).all():
            break
        best = np.minimum(new, best)
    out, j, b = [], k, len(back) - 1
    while j > 0:
        if (i := int(back[b][j - 1])) >= 0:
            out.append(int(sizes[j - 1]))
            j = i
        b -= 1
    return out[::-1]


def compose(capacity: int, amounts: dict[int, int]) -> list[tuple[int, list[int]]]:
    """Patterns of bucket sizes, each with the number of containers of that pattern, until all items are used."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in amounts.items():
        left[size] = n
    plan: list[tuple[int, list[int]]] = []
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return plan
        pattern = [int(there[-1])]
        left[pattern[0]] -= 1
        room = capacity - pattern[0]
        while room > 0:
            fit = np.flatnonzero(left[: room + 1])
            if not len(fit):
                break
            # the largest that fits alone, or the larger one of the fullest pair
            alone = int(fit[-1])
            pick = alone
            if alone < room:
                mate = np.searchsorted(fit, room - fit, side="right") - 1
                ok = mate >= 0
                same = ok & (fit[mate] == fit) & (left[fit] < 2)
                mate = np.where(same, mate - 1, mate)
                ok = mate >= 0
                if ok.any():
                    sums = np.where(ok, fit + fit[np.maximum(mate, 0)], -1)
                    top = sums.max()
                    if top > alone:
                        pick = int(fit[np.flatnonzero(sums == top)[-1]])
            pattern.append(pick)
            left[pick] -= 1
            room -= pick
        for size in pattern:
            left[size] += 1
        uses = {s: pattern.count(s) for s in pattern}
        times = int(min(left[s] // u for s, u in uses.items()))
        for s, u in uses.items():
            left[s] -= times * u
        plan.append((times, pattern))


def _items(df: DataFrame, record: str, text: str, capacity: int, tokenizer: str) -> DataFrame:
    """(record, piece, size): the pieces of every text; only texts beyond the capacity have more than one."""
    sized = token_sizes(df, record, text, tokenizer).filter("tokens > 0")
    whole = F.expr(f"cast(ceil(tokens / {capacity}D) as bigint)")
    pieces = F.sequence(F.lit(0).cast("bigint"), whole - 1)
    return sized.select("record", "tokens", F.explode(pieces).alias("piece")).select(
        "record", F.col("piece").cast("int").alias("piece"),
        F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("int").alias("size"))


def _ranked(items: DataFrame, bounds: list[int], counts: np.ndarray, salt_items: int) -> DataFrame:
    """The items with their bucket's upper bound and their rank in the bucket."""
    # sizes are at most the capacity, so a lookup by size stands for the search
    salts = {b: max(1, -(-n // salt_items)) for b, n in _bucketed(counts, bounds).items()}
    by_size = _by_size(bounds)
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("size"))
    salted = items.withColumn("bucket", at(by_size)).withColumn(
        "salt", F.pmod(F.xxhash64("record", "piece"), at([salts.get(b, 1) for b in by_size])).cast("int"))
    parts = salted.groupBy("bucket", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("bucket", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("record", "piece"))
    return salted.withColumn("inside", inside).join(offsets, ["bucket", "salt"]).withColumn(
        "rank", F.col("offset") + F.col("inside") - 1)


def _by_size(bounds: list[int]) -> list[int]:
    return [b for lo, b in zip([0, *bounds], bounds) for _ in range(lo, b)]


def _histogram(items: DataFrame, capacity: int) -> np.ndarray:
    counts = np.zeros(capacity + 1, np.int64)
    for row in items.groupBy("size").agg(F.count("*").alias("n")).collect():  # at most ``capacity`` rows
        counts[row["size"]] = row["n"]
    return counts


def _bucketed(counts: np.ndarray, bounds: list[int]) -> dict[int, int]:
    return {b: int(counts[lo + 1: b + 1].sum()) for lo, b in zip([0, *bounds], bounds)}


def _placed(items: DataFrame, bounds: list[int], counts: np.ndarray, plan: list[tuple[int, list[int]]], record: str, salt_items: int) -> DataFrame:
    lists: dict[int, list[tuple[int, int, int]]] = {b: [] for b in bounds}
    base, used = 0, dict.fromkeys(bounds, 0)
    for times, pattern in plan:
        for bucket in dict.fromkeys(pattern):
            per = pattern.count(bucket)
            lists[bucket].append((used[bucket], base, per))
            used[bucket] += times * per
        base += times
    # bounded by the capacity: every pattern uses up a bucket
    table = items.sparkSession.createDataFrame(list(lists.items()), "bucket int, stretches array<struct<lo: bigint, base: bigint, per: int>>")
    ranked = _ranked(items, bounds, counts, salt_items).join(F.broadcast(table), "bucket")
    mine = F.element_at(F.filter("stretches", lambda x: x["lo"] <= F.col("rank")), -1)
    return ranked.withColumn("x", mine).select(
        F.col("record").alias(record), "piece", F.col("size").alias("tokens"),
        (F.col("x.base") + F.floor((F.col("rank") - F.col("x.lo")) / F.col("x.per"))).alias("container"))


def pack(df: DataFrame, record: str = "doc_id", text: str = "text", capacity: int = CAPACITY, buckets: int = BUCKETS,
         tokenizer: str = TOKENIZER, salt_items: int = SALT_ITEMS) -> DataFrame:
    """(record, piece, tokens, container): every piece with its container, composed across buckets."""
    items = cut(_items(df, record, text, capacity, tokenizer))
    counts = _histogram(items, capacity)
    bounds = boundaries(counts, buckets)
    return _placed(items, bounds or [capacity], counts, compose(capacity, _bucketed(counts, bounds)), record, salt_items)


def bucket_batches(df: DataFrame, record: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                   buckets: int = BUCKETS, tokenizer: str = TOKENIZER, salt_items: int = SALT_ITEMS) -> DataFrame:
    """(record, piece, tokens, container): batches inside each bucket only."""
    items = cut(_items(df, record, text, capacity, tokenizer))
    counts = _histogram(items, capacity)
    bounds = boundaries(counts, buckets, batched=True)
    plan: list[tuple[int, list[int]]] = []
    for bucket, n in _bucketed(counts, bounds).items():
        full, rest = divmod(n, capacity // bucket)
        plan += [(full, [bucket] * (capacity // bucket))] * (full > 0) + [(1, [bucket] * rest)] * (rest > 0)
    return _placed(items, bounds or [capacity], counts, plan, record, salt_items)


def fill(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, unused_share) of a packing."""
    one = placed.groupBy("container").agg(F.sum("tokens").alias("tokens"))
    return one.agg(F.count("*").alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
                   F.round(1 - F.try_divide(F.sum("tokens"), F.count("*") * capacity), 6).alias("unused_share"))
