"""Problem 1: records that are the same but for formatting, collapsed into one record each.

Dictionary encoding: inside every Arrow batch each distinct value is canonicalised once and replaced by an
integer identifier, the 64-bit hash of its canonical form, so that all tasks agree on the identifiers without
a shuffle of texts. A record becomes the tuple (identifier of the statement, identifier of the result), in the
fixed order of its fields, and only those tuples and the record identifiers are shuffled and grouped.

The hot group: tuples carry a salt made from the record identifier, groups are pre-aggregated by salt and only
then by tuple, and the further copies are found by a join on tuple and salt, so that no task holds a group.

Defined results: a null statement equals only a null one; a null result counts as missing and equals only a
missing one; an empty statement equals an empty one; rows with a null group or identifier belong to no group
and are left out; rows sent twice under one identifier are one record; an empty table gives an empty result.
Columns other than those named are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, salt_of
from .statements import canonical_result, canonical_statement

#: Characters that a task's dictionary holds from one batch to the next; beyond them it starts anew.
DICTIONARY_CHARS = 16_000_000
#: Salts of a tuple, or the session's shuffle partitions if they are more.
SALTS = 32

_NULL = -1


def _identifier(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    statements: dict[str | None, tuple[int, tuple[int, ...]]] = {}
    results: dict[tuple[str | None, tuple[int, ...]], int] = {}
    held = 0
    for batch in batches:
        sql = batch.column(2).dictionary_encode()
        res = batch.column(3).dictionary_encode()
        if held > DICTIONARY_CHARS:
            statements.clear()
            results.clear()
            held = 0
        own = []
        for text in sql.dictionary.to_pylist():
            known = statements.get(text)
            if known is None:
                form, order = canonical_statement(text)
                held += len(text)
                known = statements[text] = (_identifier(form), order)
            own.append(known)
        texts = res.dictionary.to_pylist()
        sql_ids, res_ids = [], []
        for s, r in zip(sql.indices.to_pylist(), res.indices.to_pylist()):
            sql_id, order = own[s] if s is not None else (_NULL, ())
            sql_ids.append(sql_id)
            if r is None:
                res_ids.append(_identifier("\x00"))
                continue
            key = (texts[r], order)
            known = results.get(key)
            if known is None:
                held += len(key[0])
                known = results[key] = _identifier(canonical_result(texts[r], order))
            res_ids.append(known)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sql_ids, pa.int64()), pa.array(res_ids, pa.int64())],
            names=["grp", "rid", "sql_id", "res_id"],
        )


def encode_records(df: DataFrame, group: str, record: str, statement: str, result: str) -> DataFrame:
    """(grp, rid, sql_id, res_id): every record as its tuple of dictionary identifiers."""
    src = df.select(
        F.col(group).cast("bigint").alias("grp"),
        F.col(record).cast("bigint").alias("rid"),
        F.col(statement).cast("string").alias("sql"),
        F.col(result).cast("string").alias("res"),
    ).filter("grp IS NOT NULL AND rid IS NOT NULL")
    return src.mapInArrow(_encode, "grp bigint, rid bigint, sql_id bigint, res_id bigint")


def _groups(encoded: DataFrame, salts: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    key = ["grp", "sql_id", "res_id"]
    salts = max(salts, int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions", "1")))
    tuples = encoded.withColumn("salt", salt_of(F.col("rid"), salts))
    part = tuples.groupBy(*key, "salt").agg(F.min("rid").alias("part_first"), F.count("*").alias("part_n"))
    whole = part.groupBy(*key).agg(F.min("part_first").alias("first"), F.sum("part_n").alias("copies"))
    return tuples, part, whole


def collapse(df: DataFrame, group: str = "idx", record: str = "pool_id", statement: str = "sql",
             result: str = "result_key", salts: int = SALTS) -> DataFrame:
    """(group, record, copies): one row per distinct record, its smallest identifier and its number of rows."""
    whole = _groups(encode_records(df, group, record, statement, result), salts)[2]
    return whole.select(F.col("grp").alias(group), F.col("first").alias(record), "copies")


def further_copies(df: DataFrame, group: str = "idx", record: str = "pool_id", statement: str = "sql",
                   result: str = "result_key", salts: int = SALTS) -> DataFrame:
    """(<record>_a, <record>_b): for every further copy the smallest identifier of its set, and its own."""
    encoded = cut(encode_records(df, group, record, statement, result))  # read thrice below
    tuples, part, whole = _groups(encoded, salts)
    key = ["grp", "sql_id", "res_id"]
    firsts = part.join(whole.filter("copies > 1"), key).select(*key, "salt", "first")
    return (
        tuples.join(firsts, [*key, "salt"])
        .filter("rid <> first")
        .select(F.col("first").alias(f"{record}_a"), F.col("rid").alias(f"{record}_b"))
    )
