"""Equality of result sets, which come as JSON text of rows.

Four rules, all needed: rows in any order with untyped cells; that as a key; rows in any order with typed
cells; and the rows as they came. Columns are compared by position, never by name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "NULL_RESULT"
_ROWS = "array<array<string>>"


def rows_of(result: Column) -> Column:
    return F.from_json(result, _ROWS)


def normal_rows(result: Column) -> Column:
    """Rows of text cells, null as 'None', sorted: equal bags give equal arrays; 1 and 1.0 differ."""
    return F.array_sort(F.transform(rows_of(result), lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit("None")))))


def result_key(result: Column) -> Column:
    return F.coalesce(F.to_json(normal_rows(result)), F.lit(MISSING))


def typed_key(result: Column) -> Column:
    """As above with each cell's type in front, so that null and 'None', or 1 and '1', differ."""
    variant = F.try_parse_json(result)
    cells = F.try_variant_get(variant, "$", "array<array<variant>>")
    name = lambda c: F.concat(F.schema_of_variant(c), F.lit(":"), F.coalesce(F.try_variant_get(c, "$", "string"), F.lit("")))
    typed = F.transform(cells, lambda r: F.array_join(F.transform(r, name), "|"))
    return F.coalesce(F.to_json(F.array_sort(typed)), F.lit(MISSING))


def ordered_key(result: Column) -> Column:
    """The rows in the order they came; null stays null."""
    return F.to_json(rows_of(result))


def is_empty(key: Column) -> Column:
    return key.isin("[]", MISSING)


def shape(result: Column) -> Column:
    """(rows, cols, empty, scalar); all null for a missing result."""
    rows = rows_of(result)
    cols = F.when(F.size(rows) > 0, F.size(F.get(rows, 0))).otherwise(0)
    return F.when(rows.isNotNull(), F.struct(
        F.size(rows).alias("rows"), cols.alias("cols"), (F.size(rows) == 0).alias("empty"),
        ((F.size(rows) == 1) & (cols == 1)).alias("scalar")))
