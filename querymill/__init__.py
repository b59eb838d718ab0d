"""A PySpark engine for pools of candidate SQL statements: validation, voting, scoring, retrieval and metrics."""
