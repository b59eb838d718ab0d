"""The engine: questions in, statements validated, repaired, compared and chosen."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators import select as S
from .repair import repair
from .validate import Outcome, as_pool, execute, profile, readable, validate

# Words that ask for an aggregate.
_ASKS = {"COUNT": ("how many", "number of", "count"), "AVG": ("average", "mean"), "MAX": ("highest", "maximum", "largest", "most"),
         "MIN": ("lowest", "minimum", "smallest", "least"), "SUM": ("total", "sum of")}


@dataclass
class Trace:
    source: str
    sql: str
    outcome: Outcome
    repaired: bool = False
    attempts: list[tuple[str, Outcome]] = field(default_factory=list)


class Engine:
    """Statements over the views of one database."""

    def __init__(self, spark: SparkSession, views: dict[str, DataFrame]):
        self.spark, self.views = spark, views
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        self.tables = {name: df.columns for name, df in views.items()}

    def databases(self) -> list[str]:
        return sorted(self.tables)

    def schema(self) -> DataFrame:
        rows = [(t, c, dict(self.views[t].dtypes)[c]) for t, cs in self.tables.items() for c in cs]
        return self.spark.createDataFrame(rows, "table string, column string, type string")

    def generate(self, question: str, limit: int = 3) -> list[tuple[str, str]]:
        """Statements by templates: an aggregate over the table the question names best, grouped after 'each' or 'per'."""
        words = set(re.findall(r"[a-z0-9]+", question.lower()))
        forms = words | {w[:-1] for w in words if w.endswith("s")}
        split = lambda name: set(re.findall(r"[a-z0-9]+", name.lower().replace("_", " ")))
        score = lambda t: (3 * len(split(t) & forms) + sum(2 * len((split(c) - {t}) & forms) for c in self.tables[t]))
        best = sorted(self.tables, key=lambda t: (-score(t), t))
        out: list[tuple[str, str]] = []
        for table in best[:limit]:
            if score(table) == 0 and out:
                break
            ranked = sorted(self.tables[table], key=lambda c: -len(split(c) & forms))
            ask = next((f for f, keys in _ASKS.items() if any(k in question.lower() for k in keys)), None)
            target = "COUNT(*)" if ask == "COUNT" else f"{ask}({ranked[0]})" if ask else "*"
            group = re.search(r"(?:each|per|every|by)\s+([a-z]+)", question.lower())
            by = next((c for c in self.tables[table] if group and group.group(1).rstrip("s") in c.lower()), None)
            out.append(("template", f"SELECT {by + ', ' if by and ask else ''}{target} FROM {table}{f' GROUP BY {by}' if by and ask else ''}"))
        return out[:limit]

    def execute(self, sql: str) -> DataFrame:
        """The rows of a statement that only reads."""
        if not readable(sql):
            raise ValueError("only SELECT and WITH statements are run")
        return self.spark.sql(sql.strip().rstrip(";"))

    def evaluate(self, source: str, sql: str) -> Trace:
        form, outcome, attempts = repair(self.spark, sql, self.tables)
        return Trace(source, form, outcome, form != sql, attempts)

    def run(self, question: str, candidates: list[tuple[str, str]] | None = None) -> tuple[Trace | None, list[Trace]]:
        """The chosen statement and all traces: candidates (source, sql), repaired where they fail, chosen by agreement."""
        traces = [self.evaluate(source, sql) for source, sql in dict.fromkeys(candidates or self.generate(question))]
        if not traces:
            return None, []
        done = {t.sql: t.outcome for t in traces}
        outcomes = validate(self.spark, [(0, i, t.source, t.sql) for i, t in enumerate(traces)], run=lambda _, sql: done[sql])
        chosen = S.practical(as_pool(outcomes)).first()
        return traces[chosen.pool_id], traces

    def portability(self, sql: str, profiles: tuple[str, ...] = ("ansi", "lenient", "quoted_names")) -> DataFrame:
        """(profile, ok, same, condition): how a statement fares under other settings."""
        base = execute(self.spark, sql)
        rows = []
        for name in profiles:
            o = execute(profile(self.spark, name, self.views), sql)
            rows.append((name, o.ok, o.ok and base.ok and o.key == base.key, o.condition))
        return self.spark.createDataFrame(rows, "profile string, ok boolean, same boolean, condition string")
