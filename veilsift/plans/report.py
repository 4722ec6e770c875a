"""Report tables and files made from findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import guard_formula, human_size, location_text
from ..operators.classify import RISK_RANK, at_least, parse_level, risk_rank
from ..operators.scan import FINDING_COLUMNS
from .ordinals import numbered

#: Additive counters of a scan.
COUNTERS = (
    "files_scanned",
    "lines_scanned",
    "objects_scanned",
    "tables_scanned",
    "rows_scanned",
    "bytes_scanned",
    "skipped",
)
STATS_SCHEMA = ", ".join([*(f"{c} bigint" for c in COUNTERS), "error string"])


def finding_order() -> list[Column]:
    """Source, row, line, offset, type; then what is needed to leave no ties (O1)."""
    return [
        F.col("source_type"),
        F.col("source"),
        F.coalesce("row", F.lit(0)),
        F.coalesce("line", F.lit(0)),
        F.coalesce("offset", F.lit(0)),
        F.col("data_type"),
        F.col("column_name"),
        F.col("subtype"),
        F.col("masked_value"),
    ]


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*finding_order())


def ranked(findings: DataFrame) -> DataFrame:
    """Findings with their ``rank`` in report order: sorted ranges and sums of their sizes, no global sort (O1)."""
    return numbered(findings, *finding_order(), number="rank")


def count_by_type(findings: DataFrame) -> DataFrame:
    """Most frequent type first (G1)."""
    counts = findings.groupBy("data_type").agg(F.count("*").alias("findings"))
    return counts.orderBy(F.desc("findings"), "data_type")


def count_by_risk(findings: DataFrame) -> DataFrame:
    """HIGH, MEDIUM, LOW, each with a row even when nothing was found."""
    totals = findings.agg(*[F.count_if(F.col("risk") == level).alias(level) for level in RISK_RANK])
    rows = [F.struct(F.lit(level).alias("risk"), F.col(level).alias("findings")) for level in RISK_RANK]
    return totals.select(F.inline(F.array(*reversed(rows))))


def count_by_source_type(findings: DataFrame) -> DataFrame:
    return findings.groupBy("source_type").agg(F.count("*").alias("findings")).orderBy("source_type")


def headline(findings: DataFrame) -> DataFrame:
    """Total, sources with findings, highest risk or null: one row."""
    # per source first: a source with a third of all findings is one row below
    per_source = findings.groupBy("source_type", "source").agg(
        F.count("*").alias("n"), F.max(risk_rank(F.col("risk"))).alias("top")
    )
    top = F.max("top")
    level = F.lit(None).cast("string")
    for name, rank in RISK_RANK.items():
        level = F.when(top == rank, F.lit(name)).otherwise(level)
    return per_source.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_findings"),
        F.count("*").alias("sources_with_findings"),
        level.alias("highest_risk"),
    )


def scan_stats(target_stats: DataFrame) -> DataFrame:
    """Counters summed over targets, and the number of errors: one row."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS]
    return target_stats.agg(*sums, F.count("error").alias("errors"))


#: How findings are counted for a summary, by the bits of ``grouping_id`` (a column left out is 1).
_SETS = {3: ["source_type", "source"], 13: ["data_type"], 14: ["risk"], 7: ["source_type"], 15: []}


def summary(findings: DataFrame, target_stats: DataFrame | None = None) -> DataFrame:
    """The summary document as one row (G8), in two exchanges: all counts leave one pass as
    grouping sets, aggregated before they shuffle, so no source is hot; a last aggregate reads
    these few rows and the counters side by side."""
    counts = findings.groupingSets(list(_SETS.values()), "source_type", "source", "data_type", "risk").agg(
        F.grouping_id().alias("id"), F.count("*").alias("n")
    )
    rows = counts.select("id", "n", "source_type", "data_type", "risk")
    if target_stats is not None:
        rows = rows.unionByName(target_stats.withColumn("id", F.lit(-1)), allowMissingColumns=True)

    def one(number: int, test: Column | None = None) -> Column:
        hit = F.col("id") == number if test is None else (F.col("id") == number) & test
        return F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))

    def as_map(number: int, key: str, *order: Column) -> Column:
        pairs = F.collect_list(F.when(F.col("id") == number, F.struct(*order, F.col(key).alias("k"), F.col("n").alias("v"))))
        return F.map_from_entries(F.transform(F.array_sort(pairs), lambda p: F.struct(p["k"], p["v"])))

    row = [
        one(15).alias("total_findings"),
        F.struct(*[one(14, F.col("risk") == r).alias(r) for r in reversed(RISK_RANK)]).alias("by_risk"),
        as_map(13, "data_type", (-F.col("n")).alias("o")).alias("by_type"),
        as_map(7, "source_type").alias("by_source_type"),
        F.count_if(F.col("id") == 3).alias("sources_with_findings"),
    ]
    if target_stats is not None:
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS]
        row.append(F.struct(*sums, F.count("error").alias("errors")).alias("scanned"))
    return rows.agg(*row)


def severity_top(findings: DataFrame, n: int = 200) -> DataFrame:
    """The most severe findings first; ``n`` of 0 means all (O2).  A limit after a
    sort keeps n rows per task and never sorts the whole table."""
    worst = findings.orderBy(F.desc(risk_rank(F.col("risk"))), *finding_order())
    return worst.limit(n) if n > 0 else worst


def hidden_count(findings: DataFrame, n: int) -> DataFrame:
    """How many findings a top-n list leaves out."""
    left_out = F.greatest(F.count("*") - F.lit(n), F.lit(0)) if n > 0 else F.lit(0)
    return findings.agg(F.count("*").alias("total"), left_out.cast("bigint").alias("hidden"))


def risk_gate(
    findings: DataFrame, fail_on: str | None, failures: int = 0, dry_run: bool = False
) -> DataFrame:
    """Status 3 if a finding reaches the level, else 1 after failures, else 0 (O3)."""
    base = 1 if failures else 0
    if not fail_on or dry_run:
        return findings.sparkSession.range(1).select(F.lit(base).alias("status"))
    reached = F.coalesce(F.bool_or(at_least(F.col("risk"), parse_level(fail_on))), F.lit(False))
    return findings.agg(F.when(reached, F.lit(3)).otherwise(F.lit(base)).alias("status"))


def column_profile(findings: DataFrame) -> DataFrame:
    """Findings per source, column and type."""
    return findings.groupBy("source", "column_name", "data_type").agg(
        F.count("*").alias("findings"), F.max(risk_rank(F.col("risk"))).cast("int").alias("top_rank")
    )


# ---------------------------------------------------------------- report tables


def findings_table(findings: DataFrame, n: int = 200) -> DataFrame:
    """What a console report lists: risk, type, source, place, mask (K4)."""
    label = F.concat(
        F.col("data_type"), F.coalesce(F.concat(F.lit(" ("), F.nullif("subtype", F.lit("")), F.lit(")")), F.lit(""))
    )
    place = location_text(
        F.col("line"), F.col("offset"), F.col("column_name"), F.col("row"), F.col("row_id")
    )
    # what is shown is computed below the sort: one plain projection above it keeps the
    # sort and the limit one operator
    shown = findings.withColumns({"type": label, "location": place})
    return severity_top(shown, n).select("risk", "type", "source", "location", "masked_value")


def targets_table(targets: DataFrame) -> DataFrame:
    return targets.select(
        "source_type",
        "name",
        F.coalesce(human_size(F.col("size_bytes")), F.lit("")).alias("size"),
        F.coalesce("detail", F.lit("")).alias("detail"),
    )


def targets_total(targets: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum("size_bytes"), F.lit(0))
    return targets.agg(F.count("*").alias("targets"), total.alias("bytes"), human_size(total).alias("size"))


def first_errors(target_stats: DataFrame, n: int = 10) -> DataFrame:
    return target_stats.where("error is not null").select("error").orderBy("error").limit(n)


# ------------------------------------------------------------------------ sinks


def csv_rows(findings: DataFrame) -> DataFrame:
    """The 12 report columns; text that a spreadsheet would run is disarmed (K2, K3)."""
    kinds = dict(findings.dtypes)
    return findings.select(
        *[guard_formula(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in FINDING_COLUMNS]
    )


def _only_masked(findings: DataFrame) -> DataFrame:
    """Nothing but report columns may be written: raw values have no way out."""
    extra = set(findings.columns) - set(FINDING_COLUMNS)
    if extra:
        raise ValueError(f"refusing to write columns that are not part of a finding: {sorted(extra)}")
    return findings.select(*FINDING_COLUMNS)


def write_csv(findings: DataFrame, path: str) -> None:
    """CSV part files with a header, doubled quotes, empty for null (K2)."""
    (
        ordered(csv_rows(_only_masked(findings)))
        .write.mode("overwrite")
        .options(header=True, escape='"', emptyValue="", nullValue="")
        .csv(path)
    )


def finding_documents(findings: DataFrame) -> DataFrame:
    """Findings with the location as a nested struct (K1)."""
    place = F.struct("line", "offset", "column_name", "row", "row_id").alias("location")
    return _only_masked(findings).select(
        "source_type", "source", "data_type", "subtype", "category", "risk", place, "masked_value"
    )


def write_json(findings: DataFrame, path: str) -> None:
    """One finding per line, nulls kept."""
    finding_documents(ordered(_only_masked(findings))).write.mode("overwrite").option(
        "ignoreNullFields", "false"
    ).json(path)


def scan_document(
    findings: DataFrame,
    target_stats: DataFrame,
    scan: Mapping[str, object],
    failed_sources: Sequence[str] = (),
) -> DataFrame:
    """Scan metadata, summary and failed sources of a JSON report, as one row."""
    head = F.struct(*[F.lit(list(v) if isinstance(v, tuple) else v).alias(k) for k, v in scan.items()])
    failed = F.array(*[F.lit(m) for m in failed_sources]).cast("array<string>")
    document = summary(findings, target_stats)
    return document.select(
        head.alias("scan"), F.struct("*").alias("summary"), failed.alias("failed_sources")
    )


def write_report(
    path: str,
    document: DataFrame,
    findings: DataFrame,
    target_stats: DataFrame,
    targets: DataFrame | None = None,
) -> None:
    """A JSON report as a folder: ``scan`` holds the one-row document, ``findings``,
    ``errors`` and ``targets`` one line per row, however many there are."""
    parts = {"scan": document, "errors": target_stats.where("error is not null").select("error")}
    if targets is not None:
        parts["targets"] = targets.orderBy("source_type", "name")
    for name, part in parts.items():
        part.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")
    write_json(findings, f"{path}/findings")
