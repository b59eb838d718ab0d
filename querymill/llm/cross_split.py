"""Problem 2: records of the evaluation splits that also stand, exactly or almost, in the training split.

Every record gets a 256-bit similarity hash of its question (character trigrams of the normalised words) and a
64-bit identifier of its block: its statement without formatting and the multiset of its numbers, which the
verifier demands to be equal. Exact copies are first collapsed into classes; blocks without a class on either
side are dropped.

The classes of a block are joined by code segments: the code and a permuted copy of it are cut into TABLES
segments of eight bits, and two classes of different sides meet where a segment is equal. Pairs whose codes lie
within the Hamming radius are kept, each once, and verified on their words. The key of the join is block, table
and segment, so that a crowded statement is spread over TABLES x 256 keys; there is one scheme for blocks of every
size. A pair whose codes differ in a share p of their bits shares a
segment with probability 1 - (1 - (1 - p)^8)^TABLES: 0.999 at 1/4, 0.97 at 0.31, what 40 % of changed words bring.

Copies are expanded into pairs only at the very end, where the result asks for pairs of records; ``class_pairs``
and ``members`` give the same links class by class.

Defined results: records with a null split, a null or blank question or a null or blank statement are no cases;
questions without any word are equal to each other; a record never meets one of its own side; records sent
twice under one identifier give their pair once; an empty side gives an empty result. Whole questions are
compared, however long.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut
from .statements import plain_statement

WORD = re.compile(r"\d+(?:\.\d+)*|[^\W\d_]+")
BITS = 256
RADIUS = 94
#: Segments of eight bits: those of the code and of its permuted copy.
TABLES = BITS // 4
#: Share of the longer question's words that may be changed, dropped or misspelt, and the number always allowed.
CHANGED_SHARE, CHANGED_WORDS = 0.45, 3
_BUCKETS = 4096
#: Trigrams that are looked up at once.
GRAMS = 65_536
_RANDOM = np.random.default_rng(20240501)
_SIGNS = np.where(_RANDOM.integers(0, 2, (_BUCKETS, BITS)) > 0, 1, -1).astype(np.int8)
_PERMUTED = _RANDOM.permutation(BITS)
WORDS64 = BITS // 64
CODES = [f"code{k}" for k in range(2 * WORDS64)]
_ENCODED = "rid bigint, train boolean, stmt bigint, block bigint, txt bigint, n int, words string, " + ", ".join(f"{c} bigint" for c in CODES)


def normal_words(text: str) -> str:
    return " ".join(WORD.findall(text.lower()))


def numbers_of(words: str) -> str:
    """The multiset of numbers, which two equal questions share."""
    return " ".join(sorted(w for w in words.split() if w[0].isdigit()))


def _sums(grams: np.ndarray) -> np.ndarray:
    """The summed vector of a text's trigrams, a bounded number of them at a time."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(grams), GRAMS):
        total += _SIGNS[grams[at: at + GRAMS]].sum(axis=0, dtype=np.int64)
    return total


def similarity_codes(texts: list[str]) -> np.ndarray:
    """A row of 64-bit words per text: the signs of the summed trigram vectors, and the same permuted."""
    sums = np.zeros((len(texts), BITS), np.int64)
    for k, text in enumerate(texts):
        raw = np.frombuffer(f"  {text}  ".encode(), np.uint8).astype(np.uint32)
        grams = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
        sums[k] = _sums(grams * np.uint32(2654435761) >> np.uint32(20))
    bits = sums > 0
    return np.packbits(np.concatenate([bits, bits[:, _PERMUTED]], axis=1), axis=1).view(np.int64)


def word_distance(a: list[str], b: list[str]) -> int:
    """Levenshtein distance over words, bit-parallel."""
    if not a or not b:
        return len(a) + len(b)
    peq: dict[str, int] = {}
    for i, w in enumerate(a):
        peq[w] = peq.get(w, 0) | (1 << i)
    mask, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pv, mv, dist = mask, 0, len(a)
    for w in b:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        dist += bool(ph & top) - bool(mh & top)
        ph, mh = ((ph << 1) | 1) & mask, (mh << 1) & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
    return dist


def same_question(a: str, b: str) -> bool:
    """Equal numbers, and few words changed."""
    if a == b:
        return True
    x, y = a.split(), b.split()
    limit = max(CHANGED_WORDS, int(CHANGED_SHARE * max(len(x), len(y))))
    if abs(len(x) - len(y)) > limit:
        return False
    cx, cy = Counter(x), Counter(y)
    less, more = cx - cy, cy - cx
    if any(w[0].isdigit() for w in less) or any(w[0].isdigit() for w in more):
        return False
    return max(less.total(), more.total()) <= limit and word_distance(x, y) <= limit


def _identifier(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids = lambda texts: pa.array([_identifier(t) for t in texts], pa.int64())
    for batch in batches:
        words = [normal_words(t) for t in batch.column(2).to_pylist()]
        statements = [plain_statement(t) for t in batch.column(3).to_pylist()]
        codes = similarity_codes(words)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), ids(statements), ids(f"{s}\x1f{numbers_of(w)}" for s, w in zip(statements, words)), ids(words),
             pa.array([w.count(" ") + 1 if w else 0 for w in words], pa.int32()), pa.array(words, pa.string()),
             *(pa.array(np.ascontiguousarray(codes[:, k])) for k in range(codes.shape[1]))],
            names=["rid", "train", "stmt", "block", "txt", "n", "words", *CODES],
        )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        keep = pa.array([same_question(x, y) for x, y in zip(a, b)], pa.bool_())
        yield batch.select([0, 1, 2]).filter(keep)


def encode(df: DataFrame, record: str = "idx", text: str = "question", statement: str = "gold",
           split: str = "split", train: str = "train") -> DataFrame:
    """Every case with the identifiers of its statement, block and question, and its code; written once."""
    src = df.select(
        F.col(record).cast("bigint").alias("rid"), (F.col(split) == train).alias("train"),
        F.col(text).alias("text"), F.col(statement).alias("statement"),
    ).filter("rid IS NOT NULL AND train IS NOT NULL AND text rlike '\\\\S' AND statement rlike '\\\\S'")
    return cut(src.mapInArrow(_encode, _ENCODED))


def meetings(encoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes of the blocks that have both sides, and the pairs of them that share a segment, once for each segment."""
    all_classes = encoded.groupBy("stmt", "block", "txt", "train").agg(*[F.first(c).alias(c) for c in ("n", "words", *CODES)])
    both = encoded.groupBy("block").agg(F.max("train").alias("t"), F.min("train").alias("e")).filter("t AND NOT e").select("block")
    classes = cut(all_classes.join(both, "block", "left_semi"))
    segment = lambda t: F.shiftrightunsigned(F.col(CODES[t // 8]), 8 * (t % 8)).bitwiseAND(F.lit(255)).cast("int") + 256 * t
    keyed = classes.select("stmt", "block", "txt", "train", "n", *CODES[:WORDS64], F.explode(F.array(*[segment(t) for t in range(TABLES)])).alias("segment"))
    side = lambda flag, tag: keyed.filter(F.col("train") == flag).select(
        "block", "segment", "stmt", *[F.col(c).alias(c + tag) for c in ("txt", "n", *CODES[:WORDS64])])
    return classes, side(True, "_t").join(side(False, "_e").drop("stmt"), ["block", "segment"])


def near(met: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Meetings within the radius and a length that the verifier can accept, each pair once."""
    apart = sum((F.bit_count(F.col(f"{c}_t").bitwiseXOR(F.col(f"{c}_e"))) for c in CODES[:WORDS64]), F.lit(0))
    longer = F.greatest("n_t", "n_e")
    return met.filter(apart <= radius).filter(
        F.abs(F.col("n_t") - F.col("n_e")) <= F.greatest(F.lit(CHANGED_WORDS), F.floor(longer * F.lit(CHANGED_SHARE)))).select("stmt", "txt_t", "txt_e").distinct()


def class_pairs(encoded: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(stmt, txt_t, txt_e): every verified pair of a training and an evaluation class."""
    classes, met = meetings(encoded)
    words = lambda flag, tag: classes.filter(F.col("train") == flag).select(
        "stmt", F.col("txt").alias("txt" + tag), F.col("words").alias("words" + tag))
    return (
        near(met, radius).join(words(True, "_t"), ["stmt", "txt_t"]).join(words(False, "_e"), ["stmt", "txt_e"])
        .select("stmt", "txt_t", "txt_e", "words_t", "words_e")
        .mapInArrow(_verify, "stmt bigint, txt_t bigint, txt_e bigint")
    )


def members(encoded: DataFrame, train: bool, tag: str) -> DataFrame:
    """(stmt, txt<tag>, rid<tag>): the records of every class of a side."""
    return encoded.filter(F.col("train") == train).select(
        "stmt", F.col("txt").alias("txt" + tag), F.col("rid").alias("rid" + tag)).distinct()


def overlapping_pairs(df: DataFrame, record: str = "idx", text: str = "question", statement: str = "gold",
                      split: str = "split", train: str = "train", radius: int = RADIUS) -> DataFrame:
    """(train_rid, eval_rid): every verified pair of a training and an evaluation record."""
    encoded = encode(df, record, text, statement, split, train)
    return (
        class_pairs(encoded, radius).join(members(encoded, True, "_t"), ["stmt", "txt_t"]).join(members(encoded, False, "_e"), ["stmt", "txt_e"])
        .select(F.col("rid_t").alias("train_rid"), F.col("rid_e").alias("eval_rid"))
    )


def linked_classes(df: DataFrame, record: str = "idx", **columns: str) -> DataFrame:
    """(train_rid, eval_rid, train_n, eval_n): the links between classes of copies, each class by its smallest record and its size."""
    encoded = encode(df, record=record, **columns)
    size = lambda flag, tag: encoded.filter(F.col("train") == flag).groupBy("stmt", F.col("txt").alias("txt" + tag)).agg(
        F.min("rid").alias("rid" + tag), F.count("*").alias("n" + tag))
    return class_pairs(encoded).join(size(True, "_t"), ["stmt", "txt_t"]).join(size(False, "_e"), ["stmt", "txt_e"]).select(
        F.col("rid_t").alias("train_rid"), F.col("rid_e").alias("eval_rid"), F.col("n_t").alias("train_n"), F.col("n_e").alias("eval_n"))


def overlap_report(df: DataFrame, record: str = "idx", split: str = "split", source: str = "source",
                   train: str = "train", **columns: str) -> DataFrame:
    """(split, source, records, overlapping): per evaluation split and source, how many records also stand in training."""
    encoded = encode(df, record=record, split=split, train=train, **columns)
    met = class_pairs(encoded).select("stmt", "txt_e").distinct()
    hit = members(encoded, False, "_e").join(met, ["stmt", "txt_e"], "left_semi").select(
        F.col("rid_e").alias("rid")).distinct().withColumn("hit", F.lit(1))
    rows = df.filter((F.col(split) != train) & F.col(record).isNotNull()).select(
        F.col(record).cast("bigint").alias("rid"), F.col(split).alias("split"), F.col(source).alias("source"))
    return rows.join(hit, "rid", "left").groupBy("split", "source").agg(
        F.countDistinct("rid").alias("records"), F.countDistinct(F.when(F.col("hit") == 1, F.col("rid"))).alias("overlapping"))
