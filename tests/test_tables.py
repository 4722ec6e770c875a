"""Tables: cells, keys, row numbers, allowlists, isolation of broken tables."""

import random
import threading
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import luhn_number
from veilsift.functions.texts import shown_row_id
from veilsift.operators.registry import all_detectors, build_detectors
from veilsift.plans import ordinals
from veilsift.plans.scan_job import TableSource, run_scan
from veilsift.sources import synth, tables

def driver(i):
    """Row i of the drivers: every second has an address, every third a card, the rest says so or is blank."""
    reach = f"d{i}@depot.net" if i % 2 == 0 else [None, "", "by radio"][i % 3]
    pay = luhn_number("51", 16, i) if i % 3 == 0 else "cash"
    return 100 + i, f"van {i}", reach, pay, i * 0.5


DRIVERS = [driver(i) for i in range(1, 13)]


@pytest.fixture
def db(spark, tmp_path):
    frames = {
        "drivers": spark.createDataFrame(DRIVERS, "nr long, van string, reach string, pay string, hours double"),
        "remarks": spark.createDataFrame([("tax 471-63-0497", ["at d4@depot.net", "-"], {"by": "d6@depot.net"})], "said string, list array<string>, extra map<string,string>"),
        "trips": spark.createDataFrame([(7, 2.5)], "nr int, km double"),
    }
    for name, frame in frames.items():
        frame.coalesce(1).write.parquet(str(tmp_path / name))
    return lambda session, spec: session.read.parquet(str(tmp_path / spec.name))


def scan(spark, db, *specs, **allow):
    return run_scan(spark, [TableSource(specs, db, **allow)], all_detectors())


def places(result, *columns):
    return sorted(tuple(r[c] for c in columns) for r in result.findings.collect())


def expected_cells(label):
    for row, (nr, _, reach, pay, _) in enumerate(DRIVERS, 1):
        if reach and "@" in reach:
            yield f"{label}.reach", "email", row, str(nr)
        if pay != "cash":
            yield f"{label}.pay", "credit_card", row, str(nr)


def test_cells(spark, db):
    spec = tables.TableSpec("drivers", columns=["reach", "pay"], id_column="nr")
    result = scan(spark, db, spec)
    assert places(result, "source", "data_type", "row", "row_id") == sorted(expected_cells("public.drivers"))
    assert all(r["source"].endswith(f".{r['column_name']}") for r in result.findings.collect())
    stats = result.stats().first()
    assert (stats["tables_scanned"], stats["rows_scanned"], stats["errors"]) == (1, len(DRIVERS), 0)


def test_columns_are_found_and_left_out(spark, db):
    # without a list all columns of text are read; nested ones when they are listed
    assert places(scan(spark, db, tables.TableSpec("remarks")), "column_name", "data_type", "row_id") == [("said", "national_id", None)]
    nested = tables.TableSpec("remarks", columns=["list", "extra"])
    assert places(scan(spark, db, nested), "column_name", "data_type") == [("extra", "email"), ("list", "email")]
    # a key of free text is not shown
    assert {r[0] for r in places(scan(spark, db, tables.TableSpec("drivers", columns=["reach"], id_column="van")), "row_id")} == {None}
    allowed = dict(allow_tables=["public.tri*", "REMARKS"], allow_columns=["drivers.PAY"])
    result = scan(spark, db, *(tables.TableSpec(n) for n in ("drivers", "remarks", "trips")), **allowed)
    assert {r[0] for r in places(result, "source")} == {"public.drivers.reach"}
    stats = result.stats().first()
    assert (stats["tables_scanned"], stats["skipped"]) == (1, 2)


def test_broken_tables_do_not_stop_others(spark, db):
    broken = [
        tables.TableSpec("nowhere"),
        tables.TableSpec("trips"),  # holds no text
        tables.TableSpec("drivers", columns=["reach", "pay`, nr"]),
        tables.TableSpec("drivers`; select 1", columns=["reach"]),
    ]
    result = scan(spark, db, *broken, tables.TableSpec("drivers", schema="depot", columns=["reach", "pay"], id_column="nr"))
    assert places(result, "source", "data_type", "row", "row_id") == sorted(expected_cells("depot.drivers"))
    assert result.stats().first()["errors"] == len(broken)
    planned = run_scan(spark, [TableSource([tables.TableSpec("drivers", columns=["van", "pay"]), tables.TableSpec("trips")], db)], dry_run=True)
    assert {r["name"]: r["detail"] for r in planned.targets.collect()} == {
        "public.drivers": "columns: van, pay", "public.trips": "columns: all text-like columns (auto-discovered)",
    }


def plan_of(frame):
    mode = frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return frame._jdf.queryExecution().explainString(mode)


def test_row_numbers_follow_the_key(spark):
    rng = random.Random(4)
    keys = rng.sample(range(10**6), 5000)
    frame = spark.createDataFrame([(k, f"s{k:07d}") for k in keys], "k int, s string").repartition(5)
    rank = {k: i for i, k in enumerate(sorted(keys), 1)}
    for key in ("k", "s"):
        assert {r["k"]: r["row"] for r in tables.with_row_number(frame, key).collect()} == rank
    holes = frame.withColumn("k", F.when(F.col("k") % 3 > 0, F.col("k")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = tables.with_row_number(holes, "k")
        rows = sorted(((r["row"], r["k"]) for r in numbered.collect()), key=lambda r: r[0])
        nulls = sum(k % 3 == 0 for k in keys)
        assert [n for n, _ in rows] == list(range(1, 5001))
        assert [k for _, k in rows] == [None] * nulls + sorted(k for k in keys if k % 3)
        # a third of all rows has no key: ranges cut them, and no task sees all rows
        parts = ordinals.ranged(holes.withColumn("h", F.xxhash64("k", "s")), F.col("k").asc_nulls_first(), F.col("h").asc())
        assert parts.where("k is null").select("part").distinct().count() > 1
        assert "SinglePartition" not in plan_of(numbered)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scan_numbers(spark, tmp_path):
    ordered = spark.range(0, 20000, 1, 7).write.option("maxRecordsPerFile", 900)
    ordered.parquet(str(tmp_path / "many"))
    scan_order = tables.with_scan_number(spark.read.parquet(str(tmp_path / "many")))
    rows = sorted(r["row"] for r in scan_order.collect())
    assert rows == list(range(1, 20001))
    again = tables.with_scan_number(spark.read.parquet(str(tmp_path / "many")))
    assert scan_order.exceptAll(again).count() == 0


def test_offsets_are_sums_over_dyadic_blocks(spark):
    rng = random.Random(2)
    counts = {p: rng.randrange(100) for p in rng.sample(range(3000), 400)}
    got = ordinals.offsets(spark.createDataFrame(list(counts.items()), "part int, n long"))
    assert {r["part"]: r["before"] for r in got.collect()} == {p: sum(n for q, n in counts.items() if q < p) for p in counts}


def test_numbers_of_findings_in_key_order(spark, tmp_path):
    rows = [(i * 7 % 101, f"m{i}@example.com", "x") for i in range(101)] + [(None, "n@example.com", "x")] * 3
    spark.createDataFrame(rows, "k int, mail string, note string").repartition(4).write.parquet(str(tmp_path / "t"))
    spec = tables.TableSpec("t", order_by="k", id_column="k")
    result = run_scan(spark, [TableSource([spec], lambda s, t: s.read.parquet(str(tmp_path / t.name)))], all_detectors())
    got = sorted((r["row"], r["row_id"]) for r in result.findings.collect())
    # alike rows without a key come first and have a number each
    assert got == [(1, None), (2, None), (3, None), *((k + 4, str(k)) for k in range(101))]
    assert result.stats().first()["rows_scanned"] == 104


def test_tables_run_side_by_side_with_their_own_keys(spark, db):
    together = threading.Barrier(3, timeout=60)

    def load(session, spec):
        together.wait()  # passes only if three tables are loaded at the same time
        return db(session, spec)

    specs = [
        tables.TableSpec("drivers", columns=["reach", "pay"]),
        tables.TableSpec("drivers", schema="b", columns=["reach", "pay"], id_column="nr"),
        tables.TableSpec("remarks"),
    ]
    source = TableSource(specs, load, key_of=lambda s, t: {"drivers": "nr"}.get(t.name), at_once=3)
    result = run_scan(spark, [source], build_detectors(only=["email", "credit_card"]))
    wanted = [*expected_cells("public.drivers"), *expected_cells("b.drivers")]
    assert places(result, "source", "data_type", "row", "row_id") == sorted(wanted)


# --------------------------------------------------------------------- databases


def test_reads_of_a_database_cut_its_key():
    """Conditions run on a real engine: every row meets exactly one of them."""
    con = duckdb.connect()
    con.execute(
        'create table "o""x" as select case when i % 9 = 0 then null else i * i % 977 end as k, '
        "'k''' || i as s from range(1000) t(i)"
    )
    spec = tables.TableSpec('o"x', schema="main")
    for key in ("k", "s"):
        bounds = [r[0] for r in con.execute(tables.quantile_query(spec, key, 7)).fetchall()]
        assert len(bounds) == 7 and bounds == sorted(bounds)
        conditions = tables.range_predicates(key, bounds)
        sizes = [con.execute(f'select count(*) from "o""x" where {c}').fetchone()[0] for c in conditions]
        assert sum(sizes) == 1000 and min(sizes) > 50
        once = " + ".join(f"case when {c} then 1 else 0 end" for c in conditions)
        assert con.execute(f'select count(*) from "o""x" where {once} <> 1').fetchone()[0] == 0
    assert tables.range_predicates("k", []) == tables.range_predicates("k", [5]) == []
    with pytest.raises(ValueError):
        tables.range_predicates("k", [True, False])


def test_a_database_asks_for_its_key_first(monkeypatch):
    asked = []

    def answer(self, spark, sql):
        asked.append(sql)
        return [("id",)] if "PRIMARY KEY" in sql else [(1,), (10,), (20,)]

    monkeypatch.setattr(tables.Database, "_query", answer)
    base = tables.Database("jdbc:none")
    assert base.predicates(None, tables.TableSpec("t")) == ['"id" is null or "id" < 10', '"id" >= 10 and "id" < 20', '"id" >= 20']
    assert len(asked) == 2
    monkeypatch.setattr(tables.Database, "_query", lambda *a: [("a",), ("b",)])
    assert base.predicates(None, tables.TableSpec("t")) == []  # a key of two columns cuts nothing


def test_row_ids(spark):
    """Numbers and identifiers without a meaning are shown, whatever else a key may say is not."""
    known = [str(uuid.UUID(int=k * 0x1234567890ABCDEF1234567)) for k in range(1, 4)]
    keys = [*known, known[0].upper(), known[1] + " ", "{" + known[2] + "}", "q@depot.net", "", "12"]
    frame = spark.createDataFrame([(i, k, i % 2 == 0, i / 4) for i, k in enumerate(keys)], "i int, s string, b boolean, d double")
    rows = sorted((r[0], r[1], r[2], r[3], r[4]) for r in frame.select("i", *[shown_row_id(F.col(n), t).alias(f"x{n}") for n, t in frame.dtypes]).collect())
    assert [r[1] for r in rows] == [str(i) for i in range(len(keys))]
    assert [r[2] for r in rows[:3]] == known and [r[2] for r in rows[4:7]] == [None] * 3
    assert {r[3] for r in rows} == {r[4] for r in rows} == {None}


def test_identifiers_and_catalogue_query():
    assert tables.quoted("a`b") == "`a``b`"
    for bad in ("", "a\x00b"):
        with pytest.raises(ValueError):
            tables.quoted(bad)
    assert "c.table_name = 'o''x'" in tables.primary_key_query(tables.TableSpec("o'x"))


def test_synthetic_corpus(spark, tmp_path):
    root = str(tmp_path / "lake")
    synth.write_corpus(spark, root, rows=200, parts=2)
    users = spark.read.parquet(f"{root}/tables/users")
    spec = tables.TableSpec("users", id_column="id")
    result = run_scan(spark, [TableSource([spec], lambda s, _: users)], all_detectors())
    kinds = {r["data_type"]: r["count"] for r in result.findings.groupBy("data_type").count().collect()}
    assert kinds == {"credit_card": 200, "email": 200, "national_id": 200, "phone": 200}
    from veilsift.plans.scan_job import FileSource

    clean = run_scan(spark, [FileSource([f"{root}/clean"])], all_detectors())
    assert clean.findings.count() == 0 and clean.stats().first()["lines_scanned"] == 5
