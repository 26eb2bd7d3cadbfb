"""Registered queries against their SQL counterparts on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from verify import TABLES, canonical

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

CHECKED = (
    "candidates_default", "json_candidates", "duplicates", "registry_entries", "rescan_delta", "env_pairs",
    "vault_detect", "ignore_rules", "path_policy", "known_in_pages", "residue_findings", "scrub_redact", "scrub_files",
    "file_gate", "check_hash", "discovery_registry", "discovery_projects", "monitor_status", "monitor_stream",
    "monitor_clear_status", "monitor_state", "findings_sink", "scrubbed_sink", "scrub_preview", "known_measured", "residue_with_rules",
    "residue_incremental", "history_incremental", "registry_set_fingerprint", "rescan_errors", "rescan_from_corpus",
    "residue_summary_stored",
)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cur.fetchall(), columns)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_what_lacks_sql():
    own = {n for n in entry.queries() if n != "pipeline" and not n.startswith("op")}
    assert own - set(entry.oracle_sql()) == {"corpus_scan"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
