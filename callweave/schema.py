"""Schemas of the stored tables, and the constants of the code-graph model."""

from __future__ import annotations

SCHEMA_VERSION = 1


def names(ddl: str) -> list[str]:
    """Column names of one of the schemas below."""
    return [c.split()[0] for c in ddl.split(", ")]



UNITS = "id string, name string, file string, type string, line_start int, line_end int, signature string, docstring string, hash string"
EDGES = "src_id string, dst_id string, rel_type string, file string"
CAPTURES = "capture_name string, text string, file string, line int"
VECTORS = "id string, embedding array<float>"
MODEL = "feature int, idf double, basis array<float>"
META = "key string, value string"
FILE_HASHES = "file string, hash string"
SNAPSHOTS = "build_ts long, commit_hash string, coupling double, avg_blast double, dead_code_pct double, cohesion double, test_surface double, drift_velocity double, hub_concentration double, unit_count long, edge_count long"
NOTES = "id string, unit_id string, area string, type string, title string, body string, author string, created_ts long, tags array<string>, decay_score double, status string"
NOTE_EDGES = "from_id string, to_id string, rel_type string, created_ts long, author string"
NOTE_VECTORS = "id string, embedding array<float>"
AREAS = "name string, path string, ord int"

# The kinds of edges; other kinds are treated like calls.
LOCAL, EXTERNAL, IMPORT, BOUNDARY = "LOCAL_CALL", "EXTERNAL_CALL", "IMPORT", "RUNTIME_BOUNDARY"
EXTERNAL_PREFIX = "external::"
UNKNOWN = "__unknown__"

# Note vocabularies.
NOTE_TYPES = ("decision", "warning", "context", "pattern", "agent_action", "insight")
NOTE_RELATIONS = ("caused", "motivated", "resolved", "contradicts", "updated_by")

# Defaults of the tools.
TOP_K, DEPTH, TRACE_DEPTH, BUDGET, DAYS, TOP, RECALL, HALF_LIFE = 10, 2, 5, 8000, 30, 20, 10, 70.0
