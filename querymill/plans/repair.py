"""Deterministic repair of failing statements, by Spark's error conditions."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable

from pyspark.sql import SparkSession

from .validate import Outcome, execute

_NAME = r"[A-Za-z_]\w*"


def plain_names(sql: str, names: Iterable[str] = ()) -> str:
    """[name] and, for known names only, "name" without quoting; other double quotes hold strings and stay."""
    sql = re.sub(rf"\[({_NAME})\]", r"`\1`", sql)
    for name in names:
        sql = re.sub(rf'"({re.escape(name)})"', r"`\1`", sql, flags=re.I)
    return sql


def swapped_limit(sql: str) -> str:
    """LIMIT a, b as LIMIT b OFFSET a."""
    return re.sub(r"(?i)\blimit\s+(\d+)\s*,\s*(\d+)", r"LIMIT \2 OFFSET \1", sql)


def _top_level(text: str) -> list[str]:
    parts, depth, quote, cur = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "," and depth == 0:
            parts.append(cur.strip())
            cur = ""
            continue
        cur += c
    return [*parts, cur.strip()] if cur.strip() else parts


def grouped(sql: str) -> str:
    """Bare selected columns added to GROUP BY, or a GROUP BY of them."""
    m = re.match(r"(?is)\s*select\s+(?:distinct\s+)?(.*?)\s+from\s+(.*)$", sql.rstrip("; \n"))
    if not m:
        return sql
    bare = [re.sub(rf"(?i)\s+as\s+{_NAME}$", "", f) for f in _top_level(m.group(1)) if "(" not in f and f.strip() != "*"]
    if not bare:
        return sql
    if g := re.search(r"(?is)\bgroup\s+by\s+(.*?)(?=\s+having\b|\s+order\s+by\b|\s+limit\b|$)", sql):
        have = {x.lower() for x in _top_level(g.group(1))}
        more = [b for b in bare if b.lower() not in have]
        return sql[: g.end(1)] + ("" if not more else ", " + ", ".join(more)) + sql[g.end(1):]
    at = re.search(r"(?is)\s+(having|order\s+by|limit)\b", sql)
    where = at.start() if at else len(sql.rstrip("; \n"))
    return f"{sql[:where]} GROUP BY {', '.join(bare)}{sql[where:]}"


def cast_numbers(sql: str) -> str:
    """Arithmetic aggregates over text, and comparisons of a column with a quoted number, by try_cast."""
    sql = re.sub(rf"(?i)\b(avg|sum)\s*\(\s*({_NAME}(?:\.{_NAME})?)\s*\)", r"\1(TRY_CAST(\2 AS DOUBLE))", sql)
    return re.sub(rf"(?i)\b({_NAME}(?:\.{_NAME})?)\s*(=|<>|<=|>=|<|>)\s*'(-?\d+(?:\.\d+)?)'", r"TRY_CAST(\1 AS DOUBLE) \2 \3", sql)


def nearest(name: str, known: Iterable[str]) -> str | None:
    known = list(known)
    low = {k.lower(): k for k in known}
    for form in (name.lower(), name.lower().rstrip("s"), name.lower() + "s"):
        if form in low:
            return low[form]
    close = difflib.get_close_matches(name.lower(), low, 1, 0.6)
    return low[close[0]] if close else None


def rename(sql: str, error: str, tables: Iterable[str], columns: Iterable[str], table: bool) -> str:
    """The unknown name of the error replaced by the nearest known one."""
    found = re.findall(r"`([^`]+)`", error)
    if not found:
        return sql
    wrong = found[-1] if table else error.split("`")[-2] if "." not in error else found[0]
    best = nearest(wrong, tables if table else columns)
    return re.sub(rf"(?<![\w']){re.escape(wrong)}(?![\w'])", best, sql) if best else sql


def candidates(sql: str, outcome: Outcome, tables: dict[str, list[str]]) -> list[str]:
    """Repaired forms to try for an error, the likeliest first; none of them the statement itself."""
    columns = [c for cs in tables.values() for c in cs]
    condition, error = outcome.condition or "", outcome.error or ""
    base = swapped_limit(plain_names(sql, [*tables, *columns]))
    out = [base]
    if condition.startswith("TABLE_OR_VIEW_NOT_FOUND"):
        out.append(rename(base, error, tables, columns, True))
    elif condition.startswith("UNRESOLVED_COLUMN"):
        wrong = re.search(r"with name `([^`]+)`(?:\.`([^`]+)`)?", error)
        name = (wrong.group(2) or wrong.group(1)) if wrong else ""
        if name and (best := nearest(name, columns)):
            out.append(re.sub(rf"(?<![\w']){re.escape(name)}(?![\w'])", best, base))
    elif condition.startswith(("MISSING_AGGREGATION", "MISSING_GROUP_BY", "UNSUPPORTED_EXPR_FOR_OPERATOR")):
        out.append(grouped(base))
    elif condition.startswith("CAST_INVALID_INPUT"):
        out.append(cast_numbers(base))
    elif condition.startswith("DIVIDE_BY_ZERO"):
        out.append(re.sub(rf"({_NAME}|\d+|\))\s*/\s*({_NAME}|\d+)", r"\1 / NULLIF(\2, 0)", base))
    return [s for s in dict.fromkeys(out) if s != sql]


def repair(spark: SparkSession, sql: str, tables: dict[str, list[str]], rounds: int = 2) -> tuple[str, Outcome, list[tuple[str, Outcome]]]:
    """The first form that runs, else the last one tried; and every attempt. Labels are never read."""
    outcome = execute(spark, sql)
    attempts = [(sql, outcome)]
    for _ in range(rounds):
        if outcome.ok:
            break
        for form in candidates(sql, outcome, tables):
            result = execute(spark, form)
            attempts.append((form, result))
            if result.ok or result.condition != outcome.condition:
                sql, outcome = form, result
                break
        else:
            break
    return sql, outcome, attempts
