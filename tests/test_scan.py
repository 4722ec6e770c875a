"""Whole scans: overlap, redaction, long units, custom detectors, leaks, streams."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import luhn_number, token
from veilsift.functions import spans
from veilsift.functions.masks import mask_keep_last
from veilsift.operators import classify
from veilsift.operators.detector import python_detector, regex_detector
from veilsift.operators.registry import DETECTOR_NAMES, all_detectors, build_detectors, in_order
from veilsift.operators.scan import as_units, redact, redact_logs, redact_table, scan_units
from veilsift.sources.lines import lines_of
from veilsift.streaming import stream



def parcel(seed):
    """A delivery note with a card, an address and a tax number, and what may be shown of it."""
    rng = random.Random(seed)
    digits = luhn_number(rng.choice(["51", "54", "42"]), 16, seed)
    card = "-".join(digits[i : i + 4] for i in range(0, 16, 4))
    name = "".join(rng.choices("bdfklmnrt", k=rng.randint(2, 12)))
    serial = f"{rng.randint(1, 9999):04d}"
    area, group = rng.choice([n for n in range(1, 900) if n != 666]), rng.randint(1, 99)
    said = f"{serial}kg to <{name}@depot.net>; {card}; tax {area:03d}-{group:02d}-{serial}; left at {seed}h"
    hidden = name[0] + "*" * min(max(len(name) - 1, 2), 6)
    return said, f"{serial}kg to <{hidden}@depot.net>; **** **** **** {digits[-4:]}; tax ***-**-{serial}; left at {seed}h"


NOTE, SHOWN = parcel(8)


def units(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return as_units(frame, source_type="t", source=F.lit("s"), line=F.col("i"), text=F.col("t"))


def found(spark, texts, detectors=None):
    rows = scan_units(units(spark, texts), all_detectors() if detectors is None else detectors).collect()
    return sorted((r["line"], r["offset"], r["data_type"], r["masked_value"]) for r in rows)


def redacted_texts(spark, texts, detectors=None):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = frame.select("i", redact(F.col("t"), detectors).alias("r")).collect()
    return [r["r"] for r in sorted(rows)]


def test_overlap_is_resolved_by_priority(spark):
    card = luhn_number("4", 16)
    kinds = {"credit_card": card, "email": "q7@depot.net", "ip_address": "172.31.0.6", "phone": "+1 365 555 0144"}
    assert [g[2] for g in found(spark, [f"+{card}"])] == ["credit_card"]  # digits after a plus sign are a phone number too
    # side by side nothing is lost, in any order
    orders = list(itertools.permutations(kinds))
    got = found(spark, ["; ".join(kinds[k] for k in order) for order in orders])
    assert [(g[0], g[2]) for g in got] == [(i, kind) for i, order in enumerate(orders) for kind in order]


def test_redact(spark):
    notes = [parcel(seed) for seed in range(40)]
    got = redacted_texts(spark, [*(said for said, _ in notes), "", None, spans._MARK + NOTE], all_detectors())
    assert got == [*(shown for _, shown in notes), "", None, spans._MARK + SHOWN]


def long_text(separator, seed=1):
    rng = random.Random(seed)
    items = [NOTE, parcel(9)[0], "172.31.0.6", "two sacks of oats", "ring +1 365 555 0144", "inn 7707083893", token(30, 9)]
    return separator.join(rng.choice(items) for _ in range(9000))


def test_long_units_are_cut_without_changing_results(spark, monkeypatch):
    detectors = build_detectors(
        {"national_id": {"profiles": ["us_ssn", "ru_inn"]}}, only=[*DETECTOR_NAMES]
    )
    text = long_text(", ")
    assert len(text) > 5 * spans.PIECE_CHARS
    lines = text.split(", ")
    got = found(spark, [text], detectors)
    # every item stands alone, so the whole is the sum of its parts
    alone = {t: found(spark, [t], detectors) for t in set(lines)}
    expected, at = [], 0
    for line in lines:
        expected += [(0, at + offset, kind, mask) for _, offset, kind, mask in alone[line]]
        at += len(line) + 2
    assert got == sorted(expected) and len(got) > 9000
    assert redacted_texts(spark, [text])[0] == ", ".join(redacted_texts(spark, lines))


def test_long_unit_without_a_place_to_cut(spark):
    digits = luhn_number("36", 14, 5)
    text = "oat " * 25000 + digits + " oat" * 25000
    assert found(spark, [text]) == [(0, 100001, "credit_card", "**** ****** " + digits[-4:])]


def test_invariant_under_partitioning(spark):
    texts = [f"{parcel(i)[0]} via 172.31.4.{i}" for i in range(150)]
    frames = [units(spark, texts).repartition(n) for n in (1, 7)]
    one, seven = (sorted(map(str, scan_units(f, all_detectors()).collect())) for f in frames)
    assert one == seven and len(one) == 4 * 150


def test_registry():
    names = [d.name for d in build_detectors()]
    assert names == ["credit_card", "national_id", "api_key", "email"]
    assert [d.name for d in all_detectors()] == list(DETECTOR_NAMES)
    with pytest.raises(ValueError, match="no detector is named"):
        build_detectors({"passport": {"enabled": True}})
    with pytest.raises(ValueError, match="two detectors"):
        in_order([*build_detectors(), regex_detector("email", 1, "@", lambda value, subtype: value)])
    assert build_detectors() == build_detectors()  # equal options give the same detectors


def test_custom_detectors(spark):
    def mirrored(text):
        """Words of five letters or more that read the same backwards."""
        for m in re.finditer(r"[a-z]{5,}", text):
            if m.group() == m.group()[::-1]:
                yield *m.span(), "even" if len(m.group()) % 2 == 0 else "odd"

    def mask(value, subtype):
        return mask_keep_last(value, 1)

    own = [python_detector("mirror", 5, mirrored, mask), regex_detector("release", 6, r"v\d+\.\d+", mask)]
    detectors = build_detectors(only=["email"], extra=own)
    texts = ["level noon rotor stats v12.40 redder", "v3.1@depot.net"]
    assert found(spark, texts, detectors) == [
        (0, 1, "mirror", "****l"), (0, 12, "mirror", "****r"), (0, 18, "mirror", "****s"), (0, 24, "release", "***.*0"), (0, 31, "mirror", "*****r"),
        (1, 1, "release", "**.1"),  # an address begins there, but its priority is lower
    ]
    assert redacted_texts(spark, texts, detectors) == ["****l noon ****r ****s ***.*0 *****r", "**.1@depot.net"]


def test_classification(spark):
    kinds = [(k, None) for k in classify.DEFAULTS] + [("passport", None)]
    frame = spark.createDataFrame([(i, *k) for i, k in enumerate(kinds)], "i int, d string, s string")
    plain = frame.select("i", classify.risk_of(F.col("d"), F.col("s")), classify.category_of(F.col("d")))
    got = [tuple(r)[1:] for r in sorted(plain.collect())]
    assert got == [*classify.DEFAULTS.values(), classify.OTHER]
    overrides = {"national_id": "MEDIUM", "national_id.uk_nino": " low "}
    ids = spark.createDataFrame([("us_ssn",), ("uk_nino",)], "s string")
    levels = ids.select("s", classify.risk_of(F.lit("national_id"), F.col("s"), overrides).alias("r")).collect()
    assert {r["s"]: r["r"] for r in levels} == {"us_ssn": "MEDIUM", "uk_nino": "LOW"}
    with pytest.raises(ValueError, match="a risk is one of"):
        classify.parse_level("critical")


def test_tables_and_logs_are_redacted(spark):
    frame = spark.createDataFrame([(1, NOTE, NOTE), (2, None, None)], "id int, said string, kept string")
    rows = sorted(redact_table(frame, ["said"]).collect())
    assert [tuple(r) for r in rows] == [(1, SHOWN, NOTE), (2, None, None)]
    logs = spark.createDataFrame([(f"gate code 77-Oats-77 and oats: {NOTE}",)], "m string")
    # a secret is replaced as it is written, one of fewer than six characters never
    assert redact_logs(logs, "m", ["77-Oats-77", "oats"]).first()["m"] == f"gate code [REDACTED] and oats: {SHOWN}"


def test_one_regex_pass_per_pattern(spark):
    """The optimizer must not repeat the span expression below the generator."""
    plan = scan_units(units(spark, [NOTE]), build_detectors(only=["phone"]))._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("regexp_replace(piece") <= 1 and "Generate" in plan.toString()


def test_stream(spark, tmp_path):
    from veilsift.streaming.stream import scan_stream, write_findings

    source = tmp_path / "in"
    spark.createDataFrame([("d", NOTE + "\n" + NOTE.split("; ")[0])], "name string, text string").write.parquet(str(source))
    stream = spark.readStream.schema("name string, text string").parquet(str(source))
    query = write_findings(
        scan_stream(stream, "text", F.col("name")), str(tmp_path / "out"), str(tmp_path / "check"), once=True
    )
    query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["line"], r["data_type"]) for r in rows) == [
        (1, "credit_card"), (1, "email"), (1, "national_id"), (2, "email"),
    ]


def test_counters_and_reports_of_a_stream(spark, tmp_path):
    """Two runs with more files: counters go on, each run adds a batch, and a batch run again changes nothing."""
    schema = "name string, text string"
    batches = [[("p", parcel(1)[0]), ("q", "no data")], [("p", parcel(2)[0] + "\n" + parcel(3)[0]), ("r", parcel(4)[0])]]

    def found():
        rows = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        return stream.scan_stream(rows, "text", F.col("name"))

    def run():
        stream.write_counters(found(), str(tmp_path / "counters"), str(tmp_path / "c1"), once=True).awaitTermination()
        stream.write_reports(found(), str(tmp_path / "reports"), str(tmp_path / "c2"), once=True).awaitTermination()

    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    batch = stream.counters(scan_units(lines_of(spark.read.schema(schema).parquet(str(tmp_path / "in")), "text", F.col("name"), "stream"), build_detectors()))
    latest = stream.read_counters(spark, str(tmp_path / "counters"))
    assert sorted(map(str, latest.collect())) == sorted(map(str, batch.collect())) and batch.count() == 6
    reports = spark.read.parquet(str(tmp_path / "reports"))
    assert reports.count() == 4 * 3 and reports.select("batch").distinct().count() == 2
    # a failure before a batch is committed runs it again
    for folder in ("c1", "c2"):
        commits = sorted((tmp_path / folder / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
        commits[-1].unlink()
        (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    run()
    assert sorted(map(str, stream.read_counters(spark, str(tmp_path / "counters")).collect())) == sorted(map(str, batch.collect()))
    assert spark.read.parquet(str(tmp_path / "reports")).count() == 4 * 3


def test_a_stream_is_redacted_like_a_table(spark, tmp_path):
    rows = [(i, parcel(i)[0]) for i in range(20)] + [(20, None)]
    spark.createDataFrame(rows, "k int, said string").write.parquet(str(tmp_path / "in"))
    clean = stream.redact_stream(spark.readStream.schema("k int, said string").parquet(str(tmp_path / "in")), ["said"])
    stream.write_findings(clean, str(tmp_path / "out"), str(tmp_path / "c"), once=True).awaitTermination()
    got = {r["k"]: r["said"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {i: parcel(i)[1] for i in range(20)} | {20: None}
