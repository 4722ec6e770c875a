"""Report tables and files over hand-made findings."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from conftest import evaluate
from veilsift.functions import texts
from veilsift.plans import report
from veilsift.plans.scan_job import FINDINGS_SCHEMA, TARGETS_SCHEMA

#: Two logs and a table; of each kind as many findings as its place in this list.
KINDS = [("ip_address", "ipv6", "Network", "LOW"), ("national_id", "pl_pesel", "PII", "HIGH"), ("phone", None, "PII", "MEDIUM")]


def _rows():
    for n, (kind, subtype, category, risk) in enumerate(KINDS, 1):
        for i in range(n):
            yield "file", f"var/{'ab'[i % 2]}.log", kind, subtype, category, risk, 10 * n + i, 3 * n, None, None, None, f"{kind}-{i}"
    yield "postgres", "depot.routes.driver", "phone", None, "PII", "MEDIUM", None, 2, "driver", 40, "R7", "phone-x"


ROWS = list(_rows())
TOTAL = len(ROWS)
STATS = [(2, 120, 0, 1, 50, 2048, 0, None), (0, 0, 0, 0, 0, 0, 1, None), (0, 0, 0, 0, 0, 0, 0, "x: gone")]


@pytest.fixture
def findings(spark):
    return spark.createDataFrame(ROWS, FINDINGS_SCHEMA).repartition(3)


@pytest.fixture
def stats(spark):
    return spark.createDataFrame(STATS, report.STATS_SCHEMA)


def values(frame):
    return [tuple(r) for r in frame.collect()]


def test_counts(findings, spark):
    assert values(report.count_by_type(findings)) == [("phone", 4), ("national_id", 2), ("ip_address", 1)]
    assert values(report.count_by_risk(findings)) == [("HIGH", 2), ("MEDIUM", 4), ("LOW", 1)]
    assert values(report.count_by_source_type(findings)) == [("file", 6), ("postgres", 1)]
    assert values(report.headline(findings)) == [(TOTAL, 3, "HIGH")]
    empty = findings.limit(0)
    assert values(report.headline(empty)) == [(0, 0, None)]
    assert values(report.count_by_risk(empty)) == [("HIGH", 0), ("MEDIUM", 0), ("LOW", 0)]


def test_summary(findings, stats):
    row = report.summary(findings, stats).first().asDict(recursive=True)
    assert row["total_findings"] == TOTAL and row["sources_with_findings"] == 3
    assert row["by_risk"] == {"HIGH": 2, "MEDIUM": 4, "LOW": 1}
    assert row["by_type"] == {"phone": 4, "national_id": 2, "ip_address": 1}
    assert row["by_source_type"] == {"file": 6, "postgres": 1}
    # the order of a map's keys gets lost on the way to Python
    keys = report.summary(findings, stats).select(F.map_keys("by_type"), F.map_keys("by_source_type"))
    assert values(keys) == [(["phone", "national_id", "ip_address"], ["file", "postgres"])]
    assert row["scanned"]["rows_scanned"] == 50 and row["scanned"]["errors"] == 1 and row["scanned"]["skipped"] == 1
    plan = report.summary(findings, stats)._jdf.queryExecution().executedPlan().toString()
    # the findings shuffle as counts, then their sums and the counters meet
    assert plan.count("Exchange") - plan.count("ReusedExchange") == 2 + plan.count("REPARTITION_BY_NUM")
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    nothing = report.summary(findings.limit(0)).first()
    assert nothing["total_findings"] == 0 and nothing["by_type"] == {}


def test_order_and_top(findings):
    def place(r):
        return r["source_type"], r["source"], r["row"] or 0, r["line"] or 0, r["offset"]

    inorder = sorted(findings.collect(), key=place)
    assert report.ordered(findings).collect() == inorder
    ranks = report.ranked(findings).collect()
    assert [r["masked_value"] for r in sorted(ranks, key=lambda r: r["rank"])] == [r["masked_value"] for r in inorder]
    assert sorted(r["rank"] for r in ranks) == list(range(1, TOTAL + 1))
    levels = ["HIGH", "MEDIUM", "LOW"]
    worst = sorted(inorder, key=lambda r: levels.index(r["risk"]))  # stable
    assert report.severity_top(findings, 0).collect() == worst
    assert values(report.findings_table(findings, 3)) == [
        ("HIGH", "national_id (pl_pesel)", "var/a.log", "20:6", "national_id-0"),
        ("HIGH", "national_id (pl_pesel)", "var/b.log", "21:6", "national_id-1"),
        ("MEDIUM", "phone", "var/a.log", "30:9", "phone-0"),
    ]
    assert values(report.hidden_count(findings, 3)) == [(TOTAL, TOTAL - 3)] and values(report.hidden_count(findings, 0)) == [(TOTAL, 0)]
    assert "TakeOrderedAndProject" in report.severity_top(findings, 2)._jdf.queryExecution().executedPlan().toString()


def test_gate(findings):
    low = findings.where("risk = 'LOW'")
    status = [
        report.risk_gate(f, level, failures, dry).first()["status"]
        for f, level, failures, dry in (
            (findings, "high", 0, False), (low, "medium", 0, False), (low, "Low", 0, False), (low, "high", 2, False),
            (findings, None, 0, False), (findings, "low", 0, True),
        )
    ]
    assert status == [3, 0, 3, 1, 0, 0]


def test_csv_report(findings, tmp_path, spark):
    hostile = ("file", '@SUM("a", 1)', "phone", "", "PII", "MEDIUM", 1, 1, "tel,fax", None, None, "-* *** 144")
    report.write_csv(findings.union(spark.createDataFrame([hostile], FINDINGS_SCHEMA)).coalesce(1), str(tmp_path / "c"))
    rows = [r for p in sorted((tmp_path / "c").glob("part-*")) for r in csv.reader(p.open(newline=""))]
    body = [r for r in rows if r[0] != "source_type"]
    assert tuple(rows[0]) == report.FINDING_COLUMNS and len(body) == TOTAL + 1
    told = [["" if v is None else str(v) for v in r] for r in ROWS]
    assert all(r in body for r in told)
    (guarded,) = [r for r in body if r not in told]
    assert guarded[1] == "'@SUM(\"a\", 1)" and guarded[-1] == "'-* *** 144" and guarded[8] == "tel,fax"


def test_json_report(findings, stats, tmp_path, spark):
    targets = spark.createDataFrame([("file", "a.txt", 10, None)], TARGETS_SCHEMA)
    document = report.scan_document(findings, stats, {"dry_run": True, "sources": ["file"], "duration_seconds": 1.5}, ["s3: gone"])
    report.write_report(str(tmp_path / "r"), document, findings, stats, targets)

    def lines(part):
        return [json.loads(x) for p in sorted((tmp_path / "r" / part).glob("part-*")) for x in p.read_text().splitlines()]

    (head,) = lines("scan")
    assert head["scan"] == {"dry_run": True, "sources": ["file"], "duration_seconds": 1.5}
    assert head["failed_sources"] == ["s3: gone"] and head["summary"]["by_type"]["phone"] == 4
    assert lines("errors") == [{"error": "x: gone"}]
    assert lines("targets") == [{"source_type": "file", "name": "a.txt", "size_bytes": 10, "detail": None}]
    last = lines("findings")[-1]
    assert last["location"] == {"line": None, "offset": 2, "column_name": "driver", "row": 40, "row_id": "R7"}
    assert {k: v for k, v in last.items() if k != "location"} == dict(
        source_type="postgres", source="depot.routes.driver", data_type="phone", subtype=None, category="PII", risk="MEDIUM", masked_value="phone-x"
    )


def test_texts(spark):
    places = [(None, None, None, 40, "R7"), (31, 9, "driver", None, None), (None, 6, None, None, None), (None,) * 5, (8, None, None, 2, None)]
    schema = "l int, o int, c string, r bigint, d string"
    args = [F.col(c) for c in "locrd"]
    assert evaluate(spark, places, texts.location_text(*args), schema) == ["row 40 id=R7", "31:9 [driver]", ":6", "-", "row 2 8"]
    long = evaluate(spark, places, texts.location_long(*args), schema)
    assert long[:2] == ["row 40 (id=R7)", "line 31, column 'driver', offset 9"] and long[3] == "-"
    sizes = [0, 1023, 1024, 1536, 163072, 1048576, 5 * 1024**3, 3000 * 1024**3]
    got = evaluate(spark, [(s,) for s in sizes], texts.human_size(F.col("v")), "v bigint")
    assert got == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "159.2 KB", "1.0 MB", "5.0 GB", "3000.0 GB"]
    cells = ["=cmd", "+1", "-2+3", "@SUM(A1)", "\t=1", "\rx", "plain", ""]
    guarded = evaluate(spark, [(c,) for c in cells], texts.guard_formula(F.col("v")))
    assert guarded == ["'" + c for c in cells[:6]] + cells[6:]
