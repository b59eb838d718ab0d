"""Problem 7: texts of the corpus that carry passages of the held-out items, whole or in part.

The items' normalised word n-grams make a hash set that is broadcast; every text's token windows are looked up
in it, and each pair of text and item that is hit is verified by aligning the two: hits on one diagonal, with
single changed, dropped or added words between them, make runs; a run counts if it holds a word that few groups
of items use, or STRETCH words in a row that few groups hold; the best chain of at most MAX_RUNS runs in the order of both texts must hold SHARE of the item's words.

Equal and nearly equal items make a group, in which a word or stretch counts once: items that share half of their
n-grams are linked, found by bands of minimum hashes and checked exactly.

The items are broadcast in blocks of at most BLOCK_WORDS words, one scan of the corpus for each block; a block's
hits are written before the next block is made, so that what the driver and a worker hold is bounded however many
items there are. Runs of one part of an item are one class in the chain, so a text that repeats a phrase costs no more.

Defined results: null or blank texts and items without N words are no cases; items with equal texts leak
together; rows sent twice under one identifier give one row; no items or no texts give an empty result. Whole
texts are scanned, in one pass.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .group_splits import components
from .runtime import cut

N = 3
SHARE = 0.5
MAX_RUNS = 4
#: Words of a run that may differ in a row, and how far its diagonal may drift.
GAP, DRIFT = 2, 2
#: A word or stretch is an item's own if at most this share of the groups of items, but at least FEW of them, use it.
OWN_SHARE, FEW = 0.02, 2
#: Words in a row that can be an item's own where no single word is.
STRETCH = 8
#: Share of the n-grams, of all that two items have, that nearly equal ones share; bands of minimum hashes and hashes in one.
ALIKE, BANDS, BAND = 0.5, 64, 3
BLOCK_WORDS = 2_000_000
#: Texts with leaks up to which their spans are broadcast to the texts; beyond, both are shuffled.
BROADCAST_TEXTS = 200_000

WORD = re.compile(r"[^\W_]+")
_WRAP = re.compile(r"(?<=[^\W\d_])-[ \t]*\n[ \t>]*(?=[^\W\d_])")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def _hashed(words: list[str], n: int) -> list[int]:
    return [xxhash.xxh64_intdigest(" ".join(words[k: k + n])) - (1 << 63) for k in range(len(words) - n + 1)]


@dataclass
class Index:
    """The n-grams of a block of items, as numbers in base ``len(vocabulary) + 1``."""

    ids: list[int]
    lengths: list[int]
    vocabulary: dict[str, int]
    codes: np.ndarray  # sorted
    starts: np.ndarray  # of each code's places
    items: np.ndarray
    places: np.ndarray
    own: list[np.ndarray]  # per item, whether the word at a place is its own
    stretches: list[np.ndarray]  # per item, whether the stretch from a place is its own


def build_index(items: Sequence[tuple[int, list[str], set[str], set[int]]]) -> Index:
    vocabulary: dict[str, int] = {}
    for _, words, *_ in items:
        for w in words:
            vocabulary.setdefault(w, len(vocabulary) + 1)
    base = len(vocabulary) + 1
    if base**N >= 2**63:
        raise ValueError("too many distinct words in a block of items; lower BLOCK_WORDS")
    codes, owner, place, own, stretches = [], [], [], [], []
    for k, (_, words, rare, rows) in enumerate(items):
        ids = np.array([vocabulary[w] for w in words], np.int64)
        grams = _grams(ids, base)
        codes.append(grams)
        owner.append(np.full(len(grams), k))
        place.append(np.arange(len(grams)))
        own.append(np.array([w in rare for w in words], bool))
        stretches.append(np.array([h in rows for h in _hashed(words, STRETCH)], bool))
    flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    distinct, starts = np.unique(flat[order], return_index=True)
    empty = np.zeros(0, np.int64)
    return Index([i for i, *_ in items], [len(w) for _, w, *_ in items], vocabulary, distinct, np.r_[starts, len(flat)],
                 np.concatenate(owner)[order] if codes else empty, np.concatenate(place)[order] if codes else empty, own, stretches)


def _grams(ids: np.ndarray, base: int) -> np.ndarray:
    if len(ids) < N:
        return np.zeros(0, np.int64)
    code = np.zeros(len(ids) - N + 1, np.int64)
    known = np.ones(len(code), bool)
    for k in range(N):
        part = ids[k: k + len(code)]
        code = code * base + part
        known &= part > 0
    return np.where(known, code, -1)


@dataclass
class Run:
    doc: int
    doc_end: int
    item: int
    item_end: int
    held: int


def _has_stretch(run: list[tuple[int, int]], stretches: np.ndarray) -> bool:
    """Whether a run holds, word by word, one of the item's own stretches."""
    row = 0
    for k, (d, p) in enumerate(run):
        row = row + 1 if k and run[k - 1] == (d - 1, p - 1) else 1
        if row > STRETCH - N and stretches[p - (STRETCH - N)]:
            return True
    return False


def runs_of(pairs: list[tuple[int, int]], own: np.ndarray, stretches: np.ndarray) -> list[Run]:
    """Runs of n-gram hits (place in the text, place in the item) that stay near one diagonal."""
    open_runs: list[list[tuple[int, int]]] = []
    done: list[list[tuple[int, int]]] = []
    for d, p in pairs:
        still = []
        for run in open_runs:
            (done if d - run[-1][0] > N + GAP else still).append(run)
        open_runs = still
        best = None
        for run in open_runs:
            ld, lp = run[-1]
            if d > ld and p > lp and p - lp <= N + GAP and abs((d - p) - (ld - lp)) <= DRIFT:
                drift = abs((d - p) - (ld - lp))
                if best is None or drift < best[0]:
                    best = (drift, run)
        if best is None:
            open_runs.append([(d, p)])
        else:
            best[1].append((d, p))
    out = []
    for run in done + open_runs:
        held = np.zeros(run[-1][1] + N - run[0][1], bool)
        for _, p in run:
            held[p - run[0][1]: p - run[0][1] + N] = True
        first = run[0][1]
        if not (held & own[first: first + len(held)]).any() and not _has_stretch(run, stretches):
            continue
        # a single changed word between held ones counts as held
        single = np.zeros_like(held)
        single[1:-1] = ~held[1:-1] & held[:-2] & held[2:]
        out.append(Run(run[0][0], run[-1][0] + N, first, first + len(held), int((held | single).sum())))
    return out


def best_chain(runs: list[Run]) -> tuple[int, list[Run]]:
    """The most words held by at most MAX_RUNS runs that follow one another in the text and in the item.

    Runs that hold the same part of the item differ only in where they stand. Of those only the earliest one behind
    what comes before is asked for, and of the chains up to a part only those that no other beats in both words
    and end; so the work depends on the item, not on how often the text repeats itself.
    """
    classes: dict[tuple[int, int, int], list[Run]] = {}
    for r in sorted(runs, key=lambda r: r.doc):
        classes.setdefault((r.item, r.item_end, r.held), []).append(r)
    order = sorted(classes)
    starts = {c: [r.doc for r in classes[c]] for c in order}
    soonest: dict[tuple[int, int, int], list[Run]] = {}  # at every place the run from there on that ends first
    for c, own_runs in classes.items():
        ends = list(own_runs)
        for k in range(len(ends) - 2, -1, -1):
            if ends[k + 1].doc_end < ends[k].doc_end:
                ends[k] = ends[k + 1]
        soonest[c] = ends
    fronts = {c: [(soonest[c][0].doc_end, c[2], [soonest[c][0]])] for c in order}
    top: tuple[int, list[Run]] = max(((f[0][1], f[0][2]) for f in fronts.values()), key=lambda x: x[0], default=(0, []))
    for _ in range(1, MAX_RUNS):
        longer: dict[tuple[int, int, int], list[tuple[int, int, list[Run]]]] = {}
        for c in order:
            item, _, own = c
            met: list[tuple[int, int, list[Run]]] = []
            for b, front in fronts.items():
                over = max(0, b[1] - item)
                if b[0] >= item or over >= own or over >= b[2]:
                    continue
                for end, held, chain in front:
                    at = bisect_left(starts[c], end)
                    if at < len(starts[c]):
                        run = soonest[c][at]
                        met.append((run.doc_end, held + own - over, [*chain, run]))
            best, kept = 0, []
            for end, held, chain in sorted(met, key=lambda x: (x[0], -x[1])):
                if held > best:
                    best = held
                    kept.append((end, held, chain))
            if kept:
                longer[c] = kept
                if kept[-1][1] > top[0]:
                    top = (kept[-1][1], kept[-1][2])
        fronts = longer
    return top


def leaks_in(text: str, index: Index) -> list[tuple[int, float, list[tuple[int, int]]]]:
    """(item, share of its words held, character spans) for every item that leaked into the text."""
    text = _WRAP.sub("", text) if "-" in text else text
    get = index.vocabulary.get
    ids = np.array([get(w, 0) for w in words_of(text)], np.int64)
    grams = _grams(ids, len(index.vocabulary) + 1)
    if not len(grams) or not len(index.codes):
        return []
    at = np.minimum(np.searchsorted(index.codes, grams), len(index.codes) - 1)
    hits = np.flatnonzero(index.codes[at] == grams)
    by_item: dict[int, list[tuple[int, int]]] = {}
    for d in hits.tolist():
        for k in range(index.starts[at[d]], index.starts[at[d] + 1]):
            by_item.setdefault(int(index.items[k]), []).append((d, int(index.places[k])))
    found: list[tuple[int, float, list[tuple[int, int]]]] = []
    if not by_item:
        return found
    spots = [m.span() for m in WORD.finditer(text)]
    for item, pairs in by_item.items():
        if len(pairs) * (N + 1) - 1 < SHARE * index.lengths[item]:
            continue  # even disjoint hits, with single changed words between them, wouldn't hold enough words
        held, chain = best_chain(runs_of(pairs, index.own[item], index.stretches[item]))
        if held >= SHARE * index.lengths[item]:
            spans = [(spots[r.doc][0], spots[r.doc_end - 1][1]) for r in chain]
            found.append((index.ids[item], held / index.lengths[item], spans))
    return found


_FACTORS = np.random.default_rng(20240502).integers(0, 2**63, (BANDS * BAND, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH = "item bigint, txt bigint, words array<string>, grams array<bigint>, stretches array<bigint>, bands array<bigint>"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words, n-grams and stretches of every item that has N words, and its bands of minimum hashes."""
    for batch in batches:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            if len(words) < N:
                continue
            grams = sorted(set(_hashed(words, N)))
            h = np.array(grams, np.int64).view(np.uint64)
            least = np.array([(h * a + b).min() for a, b in _FACTORS], np.uint64).reshape(BANDS, BAND)
            bands = [xxhash.xxh64_intdigest(row.tobytes(), seed=k) - (1 << 63) for k, row in enumerate(least)]
            rows.append((item, xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63), sorted(set(words)), grams, sorted(set(_hashed(words, STRETCH))), bands))
        cols = list(zip(*rows)) if rows else [[]] * 6
        types = (pa.int64(), pa.int64(), pa.list_(pa.string()), *[pa.list_(pa.int64())] * 3)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[f.split()[0] for f in _SKETCH.split(", ")])


def _groups(sketches: DataFrame) -> DataFrame:
    """(txt, grp): the distinct texts of the items in groups of nearly equal ones."""
    texts = sketches.groupBy("txt").agg(F.first("grams").alias("grams"), F.first("bands").alias("bands"))
    met = texts.select("txt", F.explode("bands").alias("band"))
    # every text of a band is compared with the band's first, so that a crowded band costs a row for each text
    heads = met.groupBy("band").agg(F.min("txt").alias("head"))
    asked = met.join(heads, "band").filter("txt <> head").select("txt", "head").distinct()
    grams = lambda name, kept: texts.select(F.col("txt").alias(name), F.col("grams").alias(kept))
    shared = F.size(F.array_intersect("mine", "theirs"))
    alike = asked.join(grams("txt", "mine"), "txt").join(grams("head", "theirs"), "head").filter(
        shared >= ALIKE * (F.size("mine") + F.size("theirs") - shared))
    roots = components(alike.select(F.col("txt").alias("a"), F.col("head").alias("b")))
    return texts.select("txt").join(roots.withColumnRenamed("node", "txt"), "txt", "left").select("txt", F.coalesce("root", "txt").alias("grp"))


def _blocks(items: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, list[str], set[str], set[int]]]]:
    """The items, with their own words and stretches, in blocks of a bounded size."""
    words = items.select(F.col(item).cast("bigint").alias("item"), F.col(text).alias("text")).filter(
        "item IS NOT NULL AND text IS NOT NULL").dropDuplicates(["item"])
    words = cut(words)
    sketches = cut(words.mapInArrow(_sketches, _SKETCH))
    grouped = cut(sketches.join(_groups(sketches), "txt").select("item", "grp", "words", "stretches"))
    most = max(FEW, int(OWN_SHARE * grouped.select("grp").distinct().count()))

    def own(column: str) -> DataFrame:
        used = grouped.select("item", "grp", F.explode(column).alias("x"))
        rare = used.select("grp", "x").distinct().groupBy("x").agg(F.count("*").alias("n")).filter(F.col("n") <= most)
        return used.join(rare, "x").groupBy("item").agg(F.collect_list("x").alias(f"own_{column}"))

    block: list[tuple[int, list[str], set[str], set[int]]] = []
    size = 0
    for row in words.join(own("words"), "item", "left").join(own("stretches"), "item", "left").orderBy("item").toLocalIterator():
        found = words_of(row.text)
        if len(found) < N:
            continue
        if block and size + len(found) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row["item"], found, set(row.own_words or ()), set(row.own_stretches or ())))
        size += len(found)
    if block:
        yield block


def _scan(df: DataFrame, items: DataFrame, columns: list, schema: str, item: str, item_text: str,
          make: Callable[[Index], Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]) -> DataFrame:
    out = df.sparkSession.createDataFrame([], schema)
    for block in _blocks(items, item, item_text):
        shared = df.sparkSession.sparkContext.broadcast(build_index(block))
        part = df.select(*columns).filter("text rlike '\\\\S'").mapInArrow(
            lambda batches, shared=shared: make(shared.value)(batches), schema)
        out = out.union(cut(part))  # what was found, not the corpus
        shared.destroy()
    return out


def leaks(df: DataFrame, items: DataFrame, record: str = "doc_id", text: str = "text", item: str = "item_id",
          item_text: str = "text") -> DataFrame:
    """(record, item, share): every text with every item that leaked into it and the share of its words held."""

    def make(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d, i, s) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, s, _ in leaks_in(t, index)]
                cols = list(zip(*rows)) if rows else [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["doc", "item", "share"])

        return run

    columns = [F.col(record).cast("bigint").alias("doc"), F.col(text).alias("text")]
    found = _scan(df.filter(F.col(record).isNotNull()), items, columns, "doc bigint, item bigint, share double", item, item_text, make)
    return found.groupBy(F.col("doc").alias(record), F.col("item").cast(items.schema[item].dataType).alias(item)).agg(F.max("share").alias("share"))


def without_leaks(df: DataFrame, items: DataFrame, record: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """(record, <text>, removed): every text that is not null, leaked spans cut out, and the characters removed.

    Spans are found block by block and joined to the texts once, by the text's hash: broadcast where few texts have
    any, else by a shuffle.
    """

    def make(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(h, a, b) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for _, _, spans in leaks_in(t, index) for a, b in spans]
                cols = list(zip(*rows)) if rows else [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["txt", "a", "b"])

        return run

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = [], []
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if not spans:
                    texts.append(t)
                    gone.append(0)
                    continue
                whole = _WRAP.sub("", t)
                kept, at = [], 0
                for a, b in sorted((s["a"], s["b"]) for s in spans):
                    if b > at:
                        kept.append(whole[at:max(a, at)])
                        at = b
                clean = "".join([*kept, whole[at:]])
                texts.append(clean)
                gone.append(len(whole) - len(clean))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(gone, pa.int64())],
                                             names=["record", "text", "removed"])

    texts = df.select(F.col(record).alias("record"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("txt")).filter("text IS NOT NULL")
    found = _scan(texts, items, [F.col("txt"), F.col("text")], "txt bigint, a bigint, b bigint", item, item_text, make)
    spans = cut(found.groupBy("txt").agg(F.collect_set(F.struct("a", "b")).alias("spans")))  # those of one text
    if spans.count() <= BROADCAST_TEXTS:
        spans = F.broadcast(spans)
    joined = texts.join(spans, "txt", "left").select("record", "text", "spans")
    schema = joined.select("record", "text", F.lit(0).cast("bigint").alias("removed")).schema
    cleaned = joined.mapInArrow(remove, schema)
    return cleaned.select(F.col("record").alias(record), F.col("text").alias(text), "removed")
