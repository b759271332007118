"""Explicit schemas of the tables the jobs read and write."""

from __future__ import annotations

PAIR = (
    "schema_name string, schema_ddl string, question string, chain_of_thought string, "
    "sql string, dialect string, complexity string, generated_at string"
)
EVALUATION = (
    "question string, reference_sql string, generated_sql string, bleu double, valid boolean, "
    "exec_success boolean, exec_match boolean, error string, schema_name string, "
    "complexity string"
)
REGISTRY = (
    "schema_name string, table_name string, ddl string, description string, "
    "sample_values map<string,array<string>>, embedding array<float>, created_at timestamp"
)
QUERY_LOG = (
    "query_id string, schema_name string, question string, generated_sql string, "
    "dialect string, execution_success boolean, execution_error string, "
    "correction_attempts int, final_sql string, row_count int, latency_ms double, "
    "inference_mode string, created_at timestamp"
)
FEEDBACK = "feedback_id bigint, query_id string, feedback int, submitted_at timestamp"
