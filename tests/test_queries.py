"""Every registered query against its SQL on DuckDB, and documents against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare, oracle
from veilsift.operators import emails
from veilsift.operators.registry import build_detectors
from veilsift.operators.scan import scan_units
from veilsift.plans.inputs import derived_units, document_lines
from veilsift.plans import file_queries, queries

SMALL = "/root/testdata/sf0.001"
QUERIES = {**queries.QUERIES, **file_queries.QUERIES}


@pytest.fixture(scope="module")
def duck():
    return oracle(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql())
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    outcome = compare(spark, duck, SMALL, name, entry.oracle_sql()[name])
    assert "equal" in outcome, outcome


def test_entry(spark):
    assert entry.entry(spark).columns == ["source", "line", "offset", "data_type", "risk", "category", "masked_value"]


def test_document_emails_and_addresses_equal_plain_python(spark):
    """Offsets and masks of a scan against a direct statement of the two rules."""
    sf_dir = "/root/testdata/sf0.01"
    found = scan_units(document_lines(spark, sf_dir), build_detectors(only=["email", "ip_address"]))
    ours = {(r["source"], r["line"], r["offset"], r["masked_value"]) for r in found.collect()}
    known = emails.default_tlds()
    mail = re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}@((?:[A-Za-z0-9-]+\.)+([A-Za-z]{2,}))")
    ip = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)")
    theirs = set()
    for doc in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        for number, line in enumerate(doc["text"].split("\n"), 1):
            for m in mail.finditer(line):
                if m.group(2).lower() in known:
                    local = m.group(0).split("@")[0]
                    mask = local[0] + "*" * min(max(len(local) - 1, 2), 6) + "@" + m.group(1)
                    theirs.add((f"doc/{doc['doc_id']}", number, m.start() + 1, mask))
            for m in ip.finditer(line):
                octets = m.group(0).split(".")
                if all(int(o) < 256 and str(int(o)) == o for o in octets):
                    theirs.add((f"doc/{doc['doc_id']}", number, m.start() + 1, ".".join(octets[:2]) + ".*.*"))
    assert ours == theirs and len(ours) > 40


def test_texts_made_from_keys_come_in_tasks_of_bounded_size(spark, tmp_path):
    n = 500_000
    spark.range(n).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    units = derived_units(spark, str(tmp_path), "overlap_texts")
    tasks = units.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert sum(t["n"] for t in tasks) == n
    assert max(t["n"] for t in tasks) < 51_000, tasks
