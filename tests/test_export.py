"""The export of the audit log: every stage of it shows in what comes out."""

import json

from pyspark.sql import functions as F

from engramite.operators import audit
from engramite.plans import catalog

_RECORDS = "id bigint, attestation_id string, query string, timestamp string, memories_retrieved array<struct<id: bigint, content_hash: string, score: bigint>>, agent_id string, previous_hash string, signature string, hash string, error string"


def _report(spark, start=None, end=None):
    rows = [(i, f"r{i}", f"q{i}", f"2024-01-{i:02}T00", [(7, "abc", 9)] if i == 3 else [], None, f"h{i - 1}" if i > 1 else None, f"{i}" * 64, f"h{i}", audit.MISMATCH if i == 4 else None) for i in (4, 2, 1, 3)]
    stats = spark.createDataFrame([("b", 0, 0, 0, 0.5), ("a", 1, 2, 3, 0.75)], "agent_id string, memories_created int, memories_confirmed int, memories_contradicted int, reputation_score double")
    return audit.export_report(spark.createDataFrame(rows, _RECORDS).repartition(3), stats, start, end, "2024-02-02").collect()


def test_range_order_signature_and_faults_show_in_the_lines(spark):
    got = _report(spark, "2024-01-02", "2024-01-04T00")
    assert [(r.section, r.position) for r in got] == [("summary", 0), ("agents", 1), ("agents", 2), ("attestations", 2), ("attestations", 3), ("attestations", 4)]
    assert got[0].line == "Exported at: `2024-02-02`, period: `2024-01-02` to `2024-01-04T00`, total audit records: **3**, status: **COMPROMISED**"
    assert [f"Signature: `{i * 32}...`" in r.line for i, r in zip("234", got[3:], strict=True)] == [True] * 3
    assert [audit.MISMATCH in r.line for r in got[3:]] == [False, False, True] and "ID: `7`, Hash: `abc`, Score: `9`" in got[4].line
    assert "SECURE" in _report(spark, None, "2024-01-03T00")[0].line


def test_the_query_returns_both_forms(spark):
    rows = catalog.QUERIES["audit_export"](spark, "/root/testdata/sf0.001")
    assert rows.columns == ["section", "position", "json", "line"]
    got = rows.where(F.col("section") == "attestations").collect()
    assert got and all(json.loads(r.json)["signature"][:32] in r.line for r in got)
    assert json.loads(rows.where(F.col("section") == "summary").first().json)["total_attestations"] == len(got)
