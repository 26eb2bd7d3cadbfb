"""Schemas of the tables jobs read and write. None has a column for plaintext candidates."""

from __future__ import annotations

CORPUS = "path string, modified timestamp, size long, content binary"
CORPUS_PARTS = CORPUS + ", part_no int, error string"
PAIRS = "hash string, project_id string, seen_at timestamp"
PROJECT_META = "project_id string, display_name string"
FINDINGS = (
    "location string, basename string, last_mod timestamp, format string, confidence string, "
    "known_matches int, entropy_hits int, size long"
)
LINES = "file_id string, line_no int, line string"
SCRUBBED = "file_id string, line_no int, final string, action string, secrets int"
RECEIPTS = "file_id string, line_no int, version long, line_count long, tail_hash string, regfp string"
CAPTURES = "capture_id string, ok boolean, output string"
SNAPSHOTS = "surface_id string, ts timestamp, content string"
SCORED = (
    "surface_id string, ts timestamp, content_hash string, secrets int, redacted string, redacted_hash string"
)
ACTIONS = "surface_id string, ts timestamp, action string, secrets int, content_hash string, changed_at timestamp"
METRICS = (
    "run_id string, stage string, source string, before long, after long, hashes long, "
    "errors array<string>, duration_ms long, ts timestamp"
)
