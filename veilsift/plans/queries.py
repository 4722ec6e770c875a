"""The registered queries: every operator over the given tables, whole."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import checks, globs, masks, texts
from ..functions.spans import let
from ..operators import classify
from ..operators.cards import card_scheme, is_card
from ..operators.emails import is_email
from ..operators.registry import all_detectors, build_detectors
from ..operators.scan import redact_logs, redact_table, redacted, scan_rows, scan_units
from ..sources import files, synth, tables
from ..sources.lines import lines_of
from ..sources.spread import spread, spread_rows
from ..streaming.stream import scan_stream, write_findings
from . import report
from .inputs import derived, derived_units, document_lines, page_lines, table
from .shared import new_folder

Query = Callable[[SparkSession, str], DataFrame]

#: What the per-detector queries show of a finding.
SHOWN = ("source", "line", "offset", "subtype", "masked_value")


def _only(name: str, **options) -> tuple:
    return build_detectors({name: options}, only=[name])


def _ids(*profiles: str, custom=()) -> tuple:
    return _only("national_id", profiles=profiles, custom_patterns=custom)


def _scan_derived(name: str, detectors: Callable[[], tuple]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scan_units(derived_units(spark, sf_dir, name), detectors()).select(*SHOWN)

    return query


def _places(name: str, detectors: Callable[[], tuple]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scan_units(derived_units(spark, sf_dir, name), detectors()).select("source", "line", "offset", "data_type", "risk")

    return query


def _scan_documents(detectors: Callable[[], tuple]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scan_units(document_lines(spark, sf_dir), detectors()).select(*SHOWN)

    return query


# ------------------------------------------------------------------ detectors


def secrets_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random tokens in all document lines, with a line of its own random token in every document."""
    key = F.col("doc_id").cast("string")
    random = F.concat(
        F.lit("\nkey Zz"), F.substring(F.upper(F.md5(key)), 1, 20), F.lit("pqrstuvwxyz"), F.substring(F.md5(F.concat(key, F.lit("x"))), 1, 8)
    )
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), random).alias("text")))
    lines = lines_of(docs, "text", F.concat(F.lit("doc/"), key))
    return scan_units(lines, _only("api_key")).select(*SHOWN)


def email_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_units(document_lines(spark, sf_dir), _only("email"))
    return found.select("source", "line", "offset", "category", "risk", "masked_value")


def email_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses per crawl source of the documents, most first."""
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("source"), F.col("source").alias("crawl")
    )
    found = scan_units(document_lines(spark, sf_dir), _only("email")).groupBy("source").agg(F.count("*").alias("n"))
    # findings per document are few; the join side that grows is already aggregated
    by_crawl = found.join(docs, "source").groupBy("crawl").agg(F.sum("n").alias("findings"))
    return by_crawl.orderBy(F.desc("findings"), "crawl")


def document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six detectors over every line of every document."""
    found = scan_units(document_lines(spark, sf_dir), all_detectors())
    return found.select("source", "line", "offset", "data_type", "risk", "category", "masked_value")


def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_units(page_lines(spark, sf_dir), all_detectors())
    return found.select("source", "line", "offset", "data_type", "risk", "category", "masked_value")


def email_ignoring_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    ignore = ["mail1.example.com", "@Mail2.Example.com"]
    return _scan_derived("log_lines", lambda: _only("email", ignore_domains=ignore))(spark, sf_dir)


def email_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "log_lines").select("k", "mail").where(is_email(F.col("mail")))


CUSTOM_ID = {
    "name": "part_no",
    "regex": r"\bPX-\d{6}\b",
    "keep_last": 2,
    "context_keywords": ["Part-ID"],
    "context_window": 12,
}
# a group that repeats without bound runs on Python's engine
CUSTOM_ID_PYTHON = CUSTOM_ID | {"name": "part_no_py", "regex": r"\bPX-(?:\d{2})+\b", "context_keywords": []}


def overlap_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card wins over a phone number, which wins where the card is no card."""
    found = scan_units(derived_units(spark, sf_dir, "overlap_texts"), all_detectors())
    return found.select("source", "offset", "data_type", "subtype", "masked_value")


# ----------------------------------------------------------- functions, checks


def entropy_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = derived(spark, sf_dir, "token_texts")
    return tokens.select("k", F.round(checks.entropy(F.col("token")), 6).alias("bits"))


def luhn_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "card_texts").select("k", "text").where(
        checks.luhn_ok(F.regexp_replace("text", "paid by |[.]", ""))
    )


def checksum_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many order numbers would pass each check as an identifier."""
    rows = []
    for name, column in (
        ("us_ssn", "ssn_texts"),
        ("ca_sin", "sin_texts"),
        ("ru_inn", "inn_texts"),
        ("ru_snils", "snils_texts"),
        ("pl_pesel", "pesel_texts"),
        ("br_cpf", "cpf_texts"),
    ):
        digits = checks.digits_of(F.col("text"))
        texts_ = derived(spark, sf_dir, column).select(digits.alias("d"))
        passed = texts_.agg(F.count_if(checks.VALIDATORS[name](F.col("d"))).alias("passed"), F.count("*").alias("tested"))
        rows.append(passed.select(F.lit(name).alias("check"), "passed", "tested"))
    union = rows[0]
    for row in rows[1:]:
        union = union.unionByName(row)
    return union


def card_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = derived(spark, sf_dir, "card_texts").select(checks.digits_of(F.substring_index("text", " ", -1)).alias("d"))
    named = digits.select(F.coalesce(card_scheme(F.col("d")), F.lit("none")).alias("scheme"), is_card(F.col("d")).alias("ok"))
    return named.groupBy("scheme").agg(F.count("*").alias("numbers"), F.count_if("ok").alias("valid"))


def mask_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = derived(spark, sf_dir, "profile_texts")
    return people.select(
        "k",
        masks.mask_email(F.col("mail")).alias("mail"),
        masks.mask_keep_last(F.col("ssn"), 4).alias("ssn"),
        masks.mask_keep_last(F.col("ssn"), 2).alias("ssn_short"),
    )


def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    size = F.col("o_orderkey") * F.col("o_orderkey") * 13
    return orders.select("o_orderkey", texts.human_size(size).alias("size"))


# --------------------------------------------------------- classify and redact


def classify_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    overrides = {"ip_address": "medium", "email": " HIGH ", "ip_address.ipv6": "LOW"}
    found = scan_units(derived_units(spark, sf_dir, "log_lines"), all_detectors(), overrides)
    return found.groupBy("data_type", "category", "risk").agg(F.count("*").alias("findings"))


def classify_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of every event type taken as a data type: the fallback rule."""
    kinds = table(spark, sf_dir, "events").select("event_type").distinct()
    overrides = {"click": "low", "view.sub": "high"}
    kind = F.col("event_type")
    return kinds.select(
        "event_type",
        classify.risk_of(kind, F.lit("sub"), overrides).alias("risk"),
        classify.category_of(kind).alias("category"),
    )


def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return redact_table(docs, ["text"])


def redact_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_table(derived(spark, sf_dir, "profile_texts", dealt=True).select("k", "text"), ["text"])


def redact_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = derived(spark, sf_dir, "log_lines", dealt=True).select("k", "text")
    return redact_logs(lines, "text", secrets=["signed in", "event"])


# --------------------------------------------------------------------- reports


def log_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_units(derived_units(spark, sf_dir, "log_lines"), build_log_detectors())


def build_log_detectors() -> tuple:
    return build_detectors(only=["email", "ip_address"])


def shipment_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors over one log line per line item."""
    found = scan_units(derived_units(spark, sf_dir, "shipment_log"), all_detectors())
    return found.groupBy("data_type", "risk", "masked_value").agg(F.count("*").alias("findings"))


def _ranked(counts: DataFrame, *order) -> DataFrame:
    """Rows of a report, one for each type, with their place in it."""
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _on_log(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(log_findings(spark, sf_dir))


def location_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = [F.col(c) for c in ("line", "offset", "column_name", "row", "row_id")]
    found = log_findings(spark, sf_dir)
    return found.select(
        "source", texts.location_text(*place).alias("compact"), texts.location_long(*place).alias("long")
    )


def formula_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(F.substring(F.lit("=+-@\t\rab"), (F.col("p_partkey") % 8 + 1).cast("int"), F.lit(1)), F.col("p_name")).alias("cell"),
    )
    return cells.select("p_partkey", texts.guard_formula(F.col("cell")).alias("cell"))


def _target_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _document_rows(spark, sf_dir).where("stat is not null").select("stat.*")
    return rows.select(
        (F.col("status") == "scanned").cast("bigint").alias("files_scanned"),
        F.col("lines").alias("lines_scanned"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("objects_scanned", "tables_scanned", "rows_scanned")],
        F.when(F.col("status") == "scanned", F.col("bytes")).otherwise(0).alias("bytes_scanned"),
        (F.col("status") == "skipped").cast("bigint").alias("skipped"),
        F.when(F.col("status") == "error", F.concat_ws(": ", "source", "error")).alias("error"),
    )


def scan_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.scan_stats(_target_stats(spark, sf_dir))


def summary_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = report.summary(log_findings(spark, sf_dir))
    return row.select(
        "total_findings",
        F.col("by_risk.HIGH").alias("high"),
        F.col("by_risk.MEDIUM").alias("medium"),
        F.col("by_risk.LOW").alias("low"),
        F.array_join(F.map_keys("by_type"), ",").alias("types"),
        F.try_element_at("by_type", F.lit("email")).alias("emails"),
        F.try_element_at("by_source_type", F.lit("log_lines")).alias("log_lines"),
        "sources_with_findings",
    )


# --------------------------------------------------------------------- sources


def _table_cells(spec: tables.TableSpec, *allowed: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = table(spark, sf_dir, spec.name)
        cells, _ = tables.with_numbers(tables.cells_of(frame, spec, allowed), frame, spec, allowed)
        return cells.select("source", "column_name", "row", "row_id", "text")

    return query


def text_column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = tables.text_columns(table(spark, sf_dir, "customer"))
    rows = table(spark, sf_dir, "customer").agg(F.count("*").alias("rows"))
    return rows.select(F.explode(F.array(*[F.lit(n) for n in names])).alias("column_name"), "rows")


def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return tables.with_row_number(orders, "o_orderkey").select("o_orderkey", "row")


def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer and UUID keys are shown, any other text key is not."""
    people = table(spark, sf_dir, "customer")
    h = F.md5(F.col("c_name"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    key = F.when(F.col("c_custkey") % 2 == 0, F.concat_ws("-", *cut)).otherwise(F.col("c_name"))
    return people.select(
        "c_custkey",
        texts.shown_row_id(F.col("c_custkey"), "bigint").alias("int_id"),
        texts.shown_row_id(key, "string").alias("text_id"),
    )


ALLOW = ["**/de/**", "*.min.json", "m.*", "therin.example.*/**", "x[!0-9]/?.txt"]


def _key_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "key_listing").select(
        F.concat(F.lit("s3a://bkt/"), F.col("relative")).alias("path"),
        "relative",
        "size",
        F.lit(False).alias("link"),
        F.lit(None).cast("string").alias("error"),
    )


def path_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = _key_listing(spark, sf_dir)
    return listing.select("relative", globs.path_matches(ALLOW, F.col("relative")).alias("allowed"))


def target_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = files.FileRules(allow=ALLOW, max_mb=0.008)
    judged = files.verdicts(_key_listing(spark, sf_dir), rules, absolute=False)
    return judged.select("relative", "size", "verdict")


def directory_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below an allowlisted directory are no candidates at all."""
    judged = files.verdicts(_key_listing(spark, sf_dir), files.FileRules(allow=ALLOW))
    return judged.groupBy("verdict").agg(F.count("*").alias("targets"), F.sum("size").alias("bytes"))


def plan_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = files.verdicts(_key_listing(spark, sf_dir), files.FileRules(allow=ALLOW), absolute=False)
    planned = files.plan_targets(judged, F.concat(F.lit("s3://bkt/"), F.col("relative")), "s3")
    return report.targets_table(planned)


def _document_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files in four encodings, a few of them binary."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.col("doc_id") % 10
    utf8 = F.encode("text", "UTF-8")
    content = (
        F.when(n == 1, F.concat(F.expr("X'EFBBBF'"), utf8))
        .when(n == 2, F.concat(F.expr("X'FFFE'"), F.encode("text", "UTF-16LE")))
        .when(n == 3, F.concat(F.expr("X'0001'"), utf8))
        .when(n == 4, F.concat(utf8, F.expr("X'0AFF'")))
        .otherwise(utf8)
    )
    return docs.select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.length(content).cast("bigint").alias("size"),
        content.alias("content"),
        F.lit(None).cast("string").alias("error"),
    )


def _document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = files.line_units(_document_contents(spark, sf_dir), F.col("path"), "file")
    return scan_rows(units, build_detectors(only=["email"]), carry="stat")


def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every decoded file: number and length."""
    units = files.line_units(_document_contents(spark, sf_dir), F.col("path"), "file")
    lines = units.where(F.col("text").rlike(files.HAS_TEXT))
    return lines.select("source", "line", F.length("text").alias("chars"))


def file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _document_rows(spark, sf_dir).where("stat is not null")
    return rows.select("stat.source", "stat.status", "stat.lines")


def _customer_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CSV file per customer: header or none, two delimiters, quoted newlines."""
    k = F.col("c_custkey").cast("string")
    sep = F.when(F.col("c_custkey") % 2 == 0, ";").otherwise(",")
    mail = F.concat(F.lit("u"), k, F.lit("@example.com"))
    header = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("id"), sep, F.lit(" note "), sep, F.lit("mail\n")))
    record = F.concat(k, sep, F.lit('"a'), sep, F.lit('\nb"'), sep, mail, F.lit("\n"))
    second = F.concat(k, sep, F.lit("x"), sep, mail, sep, mail, F.lit("\n"))
    people = spread_rows(table(spark, sf_dir, "customer").select("c_custkey"))
    content = F.encode(F.concat(F.coalesce(header, F.lit("")), record, second), "UTF-8")
    return people.select(
        F.concat(F.lit("dir/"), k, F.lit(".csv")).alias("path"),
        F.length(content).cast("bigint").alias("size"),
        content.alias("content"),
        F.lit(None).cast("string").alias("error"),
    )


def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    detectors = build_detectors(only=["email"])
    units = files.csv_units(_customer_csv(spark, sf_dir), F.col("path"), "file", detectors)
    found = scan_rows(units, detectors, carry="stat").where("data_type is not null")
    return found.select("source", "line", "column_name", "offset", "masked_value")


def synth_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").select("c_custkey")
    return synth.people(keys, "c_custkey").select("id", "full_name", "email", "phone", "ssn", "card_number", "ip")


def synth_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan finds in a synthetic log of one line per order."""
    keys = spread_rows(table(spark, sf_dir, "orders").select("o_orderkey"))
    logs = synth.log_lines(synth.people(keys, "o_orderkey"))
    units = files.as_units(logs, source_type="file", source=F.lit("logs/app.log"), line=F.col("id"), text=F.col("text"))
    return report.count_by_type(scan_units(units, all_detectors()))


def stream_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail findings of ``documents`` read as a stream of files."""
    schema = table(spark, sf_dir, "documents").schema
    stream = spark.readStream.schema(schema).parquet(os.path.join(sf_dir, "documents*.parquet"))
    source = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    found = scan_stream(stream, "text", source, build_detectors(only=["email"]))
    folder = new_folder(spark, "stream")
    write_findings(found, f"{folder}/findings", f"{folder}/checkpoint", once=True).awaitTermination()
    rows = spark.read.schema(found.schema).parquet(f"{folder}/findings")
    return rows.select("source", "line", "offset", "category", "risk", "masked_value")


# ------------------------------------------------------------------- registry

QUERIES: dict[str, Query] = {
    # detectors over the given texts
    "email_findings": email_findings,
    "email_by_source": email_by_source,
    "document_findings": document_findings,
    "page_findings": page_findings,
    "card_findings": _scan_documents(lambda: _only("credit_card")),
    "ipv4_findings": _scan_documents(lambda: _only("ip_address")),
    "phone_findings": _scan_documents(lambda: _only("phone")),
    "generic_secret_findings": _scan_documents(lambda: _only("api_key")),
    # detectors over derived texts
    "shipment_findings": shipment_findings,
    "email_ignoring_domains": email_ignoring_domains,
    "email_valid": email_valid,
    "card_by_scheme": _scan_derived("card_texts", lambda: _only("credit_card")),
    "ipv4_public_only": _scan_derived("log_lines", lambda: _only("ip_address", ignore_private=True)),
    "ipv6_findings": _scan_derived("ipv6_texts", lambda: _only("ip_address")),
    "ipv6_public_only": _scan_derived("ipv6_texts", lambda: _only("ip_address", ignore_private=True)),
    "ssn_other_digits": _places("ssn_other_texts", lambda: _ids("us_ssn")),
    "pem_headers": _places("pem_texts", lambda: _only("api_key", detect_generic=False)),
    "email_tlds": _places("tld_texts", lambda: _only("email")),
    "ssn_findings": _scan_derived("ssn_texts", lambda: _ids("us_ssn")),
    "sin_findings": _scan_derived("sin_texts", lambda: _ids("ca_sin")),
    "nino_findings": _scan_derived("nino_texts", lambda: _ids("uk_nino")),
    "inn_findings": _scan_derived("inn_texts", lambda: _ids("ru_inn")),
    "snils_findings": _scan_derived("snils_texts", lambda: _ids("ru_snils")),
    "pesel_findings": _scan_derived("pesel_texts", lambda: _ids("pl_pesel")),
    "cpf_findings": _scan_derived("cpf_texts", lambda: _ids("br_cpf")),
    "custom_id_findings": _scan_derived("part_texts", lambda: _ids(custom=[CUSTOM_ID])),
    "custom_id_python": _scan_derived("part_texts", lambda: _ids(custom=[CUSTOM_ID_PYTHON])),
    "api_key_provider": _scan_derived("key_texts", lambda: _only("api_key", detect_generic=False)),
    "secrets_in_documents": secrets_in_documents,
    "fine_grained_tokens": _places("pat_texts", lambda: _only("api_key", detect_generic=False)),
    "api_key_generic": _scan_derived("token_texts", lambda: _only("api_key")),
    "overlap_resolution": overlap_resolution,
    # functions
    "entropy_values": entropy_values,
    "luhn_filter": luhn_filter,
    "checksum_filters": checksum_filters,
    "card_schemes": card_schemes,
    "mask_table": mask_table,
    "human_sizes": human_sizes,
    # classification and redaction
    "classify_override": classify_override,
    "classify_pairs": classify_pairs,
    "redact_documents": redact_documents,
    "redact_profiles": redact_profiles,
    "redact_log_lines": redact_log_lines,
    # reports
    "type_counts": _on_log(lambda f: _ranked(report.count_by_type(f), F.desc("findings"), "data_type")),
    "risk_counts": _on_log(report.count_by_risk),
    "source_type_counts": _on_log(report.count_by_source_type),
    "headline": _on_log(report.headline),
    "summary": summary_document,
    "scan_stats": scan_statistics,
    "finding_order": _on_log(lambda f: report.ranked(f).select("rank", "source", "line", "offset", "data_type", "risk")),
    "severity_topn": _on_log(lambda f: report.findings_table(f, 50)),
    "hidden_findings": _on_log(lambda f: report.hidden_count(f, 50)),
    "risk_gate": _on_log(lambda f: report.risk_gate(f, "medium")),
    "location_text": location_texts,
    "csv_rows": _on_log(report.csv_rows),
    "csv_formula_guard": formula_guard,
    "column_profile": _on_log(report.column_profile),
    # sources
    "table_cells": _table_cells(tables.TableSpec("customer", id_column="c_custkey", order_by="c_custkey")),
    "table_cells_scan_order": _table_cells(tables.TableSpec("part", columns=["p_name", "p_size"], id_column="p_name")),
    "column_allowlist": _table_cells(tables.TableSpec("customer", id_column="c_custkey"), "customer.C_Name", "x.*"),
    "text_columns": text_column_names,
    "row_ordinal": row_numbers,
    "row_ids": row_ids,
    "path_allowlist": path_allowlist,
    "target_verdicts": target_verdicts,
    "directory_pruning": directory_pruning,
    "plan_targets": plan_targets,
    "file_lines": file_lines,
    "file_status": file_status,
    "csv_cells": csv_cells,
    "synth_people": synth_people,
    "synth_scan": synth_scan,
    "stream_findings": stream_findings,
}
