"""Problem 4: the N best items of every group, by bounded heaps that are merged.

Every task keeps, for each group it meets, at most N items (a heap as columns: after each batch the kept items
and the batch are ordered by group and rank and cut at N). When the heaps outgrow a fixed number of items they
are handed on and started anew, which loses nothing because heaps can be merged. So a group of millions of
items reaches the shuffle as a few items per task. After the shuffle by group the heaps are merged the same
way, over rows sorted by group, so that a task only ever holds one unfinished group and a batch.

Defined results: score descending, null and NaN last and equal to each other; ties by the rank of the source,
unlisted and null sources last; then by the smaller identifier. Rows with a null group or identifier are left
out. Every row counts, copies too. N below 1 gives no rows. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items in a task's heaps before they are handed on.
HEAP_ITEMS = 500_000
_SCHEMA = "grp bigint, score double, src int, rid bigint"
_NAMES = ["grp", "score", "src", "rid"]

Columns = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _columns(batch: pa.RecordBatch) -> Columns:
    return tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))  # type: ignore[return-value]


def _best(cols: Columns, n: int) -> Columns:
    """The N best items of every group, ordered by group and rank."""
    grp, score, src, rid = cols
    order = np.lexsort((rid, src, -score, grp))
    g = grp[order]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    place = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    keep = order[place < n]
    return grp[keep], score[keep], src[keep], rid[keep]


def _joined(a: Columns | None, b: Columns) -> Columns:
    return b if a is None else tuple(np.concatenate(x) for x in zip(a, b))  # type: ignore[return-value]


def _batch(cols: Columns) -> pa.RecordBatch:
    types = (pa.int64(), pa.float64(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=_NAMES)


def _build(n: int, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: Columns | None = None
        fresh: list[Columns] = []
        waiting = 0
        for batch in batches:
            fresh.append(_columns(batch))
            waiting += batch.num_rows
            if waiting >= limit:  # compact only now and then: each compaction sorts
                cols = tuple(np.concatenate(x) for x in zip(*fresh))
                heaps, fresh, waiting = _best(_joined(heaps, cols), n), [], 0
                if len(heaps[0]) > limit:
                    yield _batch(heaps)
                    heaps = None
        if fresh:
            heaps = _best(_joined(heaps, tuple(np.concatenate(x) for x in zip(*fresh))), n)
        if heaps is not None:
            yield _batch(heaps)

    return run


def _merge(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: Columns | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = _best(_joined(rest, _columns(batch)), n)
            open_group = cols[0] == cols[0][-1]
            rest = tuple(c[open_group] for c in cols)  # type: ignore[assignment]
            if not open_group.all():
                yield _batch(tuple(c[~open_group] for c in cols))
        if rest is not None:
            yield _batch(rest)

    return run


def top_n(df: DataFrame, n: int, group: str = "idx", score: str = "score", source: str = "source",
          record: str = "pool_id", source_order: Sequence[str] = (), heap_items: int = HEAP_ITEMS) -> DataFrame:
    """(group, record, score): the kept items; a null or NaN score comes back as null."""
    rank = F.lit(len(source_order))
    for place, name in reversed(list(enumerate(source_order))):
        rank = F.when(F.col(source) == name, place).otherwise(rank)
    value = F.col(score).cast("double")
    items = df.select(
        F.col(group).cast("bigint").alias("grp"),
        F.when(value.isNull() | F.isnan(value), float("-inf")).otherwise(value).alias("score"),
        F.coalesce(rank, F.lit(len(source_order))).cast("int").alias("src"),
        F.col(record).cast("bigint").alias("rid"),
        (value.isNull() | F.isnan(value)).alias("unscored"),
    ).filter("grp IS NOT NULL AND rid IS NOT NULL")
    # a real score of minus infinity stays ahead of a missing one
    items = items.withColumn("src", F.when(F.col("unscored"), F.col("src") + len(source_order) + 1).otherwise(F.col("src")))
    heaps = items.select(*_NAMES).mapInArrow(_build(n, heap_items), _SCHEMA)
    merged = heaps.repartition("grp").sortWithinPartitions("grp").mapInArrow(_merge(n), _SCHEMA)
    return merged.select(
        F.col("grp").cast(df.schema[group].dataType).alias(group),
        F.col("rid").alias(record),
        F.when(F.col("src") <= len(source_order), F.col("score")).alias(score),
    )
