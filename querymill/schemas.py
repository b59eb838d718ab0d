"""Explicit schemas: result cells are heterogeneous, so nothing is inferred from JSON and results stay text."""

from __future__ import annotations

PREDICTION = "db_id STRING, question STRING, gold STRING, pred STRING, error STRING, model STRING"
CANDIDATE = "STRUCT<source: STRING, sql: STRING, error: STRING, model: STRING>"
ITEM = f"idx INT, db_id STRING, question STRING, gold STRING, candidates ARRAY<{CANDIDATE}>"
POOL = (
    "idx INT, pool_id BIGINT, db_id STRING, candidate_index INT, ord INT, source STRING, variant STRING, sql STRING, exec_ok BOOLEAN, exec_correct BOOLEAN, "
    "label_available BOOLEAN, result STRING, result_key STRING, latency_ms DOUBLE, repair_available BOOLEAN, repair_exec_ok BOOLEAN, original_exec_ok BOOLEAN, score DOUBLE"
)
EVIDENCE = "idx INT, backend STRING, stage STRING, sql STRING, exec_ok BOOLEAN, same_result BOOLEAN, result STRING, result_key STRING, error STRING"
CATALOG = (
    "db_id STRING, table_names_original ARRAY<STRING>, column_names_original ARRAY<STRUCT<tbl: INT, name: STRING>>, column_types ARRAY<STRING>, "
    "primary_keys ARRAY<INT>, foreign_keys ARRAY<ARRAY<INT>>"
)
JUDGMENT = "cache_key STRING, idx INT, winner STRING, confidence DOUBLE, scores MAP<STRING, STRUCT<A: DOUBLE, B: DOUBLE>>"
OUTCOME = "idx INT, candidate_index INT, source STRING, sql STRING, ok BOOLEAN, condition STRING, error STRING, n_rows BIGINT, key STRING, latency_ms DOUBLE"
