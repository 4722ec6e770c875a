"""Scans of one or several sources.

Each source is one Spark job: read, detect, mask, and cut the lineage with a
checkpoint that holds masked findings and counters only.  The reports then read
the checkpoint, so a source is read once whatever is asked of it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.detector import Detector
from ..operators.registry import build_detectors
from ..operators.scan import FINDING_COLUMNS, redacted, scan_rows, scan_units
from ..sources import files, tables
from . import report
from .shared import new_folder

FINDINGS_SCHEMA = (
    "source_type string, source string, data_type string, subtype string, category string, risk string, "
    "line int, offset int, column_name string, row bigint, row_id string, masked_value string"
)
TARGETS_SCHEMA = "source_type string, name string, size_bytes bigint, detail string"


@dataclass(frozen=True)
class FileSource:
    """Files below some roots of a mounted file system."""

    paths: Sequence[str]
    rules: files.FileRules = files.FileRules()
    source_type: str = "file"


@dataclass(frozen=True)
class ObjectSource:
    """Objects of a bucket; ``root`` is its URI, e.g. ``s3a://bucket``."""

    bucket: str
    root: str
    prefix: str = ""
    rules: files.FileRules = files.FileRules()
    source_type: str = "s3"


@dataclass(frozen=True)
class TableSource:
    """Tables; ``load`` maps a spec to a DataFrame (catalogue, parquet, JDBC, ...), ``key_of``
    to the column that locates its rows where the spec names none.  ``at_once`` tables run
    side by side."""

    specs: Sequence[tables.TableSpec]
    load: Callable[[SparkSession, tables.TableSpec], DataFrame]
    allow_tables: Sequence[str] = ()
    allow_columns: Sequence[str] = ()
    source_type: str = "postgres"
    key_of: Callable[[SparkSession, tables.TableSpec], str | None] | None = None
    at_once: int = 8


@dataclass
class ScanResult:
    """Findings and counters as DataFrames, plus the few scalars of a run."""

    findings: DataFrame
    target_stats: DataFrame
    targets: DataFrame
    sources: list[str]
    started_at: datetime
    finished_at: datetime
    dry_run: bool = False
    failed_sources: list[str] = field(default_factory=list)

    def summary(self) -> DataFrame:
        return report.summary(self.findings, self.target_stats)

    def stats(self) -> DataFrame:
        return report.scan_stats(self.target_stats)

    def document(self) -> DataFrame:
        scan = {
            "started_at": self.started_at.isoformat(),
            "finished_at": self.finished_at.isoformat(),
            "duration_seconds": round((self.finished_at - self.started_at).total_seconds(), 3),
            "dry_run": self.dry_run,
            "sources": self.sources,
        }
        return report.scan_document(self.findings, self.target_stats, scan, self.failed_sources)

    def write_json(self, path: str) -> None:
        targets = self.targets if self.dry_run else None
        report.write_report(path, self.document(), self.findings, self.target_stats, targets)

    def write_csv(self, path: str) -> None:
        report.write_csv(self.findings, path)

    def exit_status(self, fail_on: str | None = None) -> int:
        errors = len(self.failed_sources) + self.target_stats.where("error is not null").limit(1).count()
        return report.risk_gate(self.findings, fail_on, errors, self.dry_run).first()["status"]


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of masked rows, so that lost executors cost no rescan."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(new_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def mask_message(spark: SparkSession, text: str) -> str:
    """An error text with sensitive values masked."""
    frame = spark.createDataFrame([(text,)], "m string")
    return frame.select(redacted("m").alias("m")).first()["m"]


def _describe(name: str, problem: BaseException) -> str:
    first_line = (str(problem).strip().splitlines() or [""])[0][:300]
    return f"{name}: {type(problem).__name__}: {first_line}"


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _stats(status: Column, unit: str, lines: Column, rows: Column, size: Column, error: Column) -> list[Column]:
    scanned = status == "scanned"
    values = {
        f"{unit}_scanned": F.when(scanned, 1).otherwise(0),
        "lines_scanned": F.when(scanned | (status == "range"), lines).otherwise(0),
        "rows_scanned": F.when(scanned, rows).otherwise(0),
        "bytes_scanned": F.when(scanned, size).otherwise(0),
        "skipped": F.when(status == "skipped", 1).otherwise(0),
    }
    counters = [values.get(c, F.lit(0)).cast("bigint").alias(c) for c in report.COUNTERS]
    return [*counters, F.when(status == "error", error).alias("error")]


# -------------------------------------------------------------------- per source


def _judged_stats(judged: DataFrame, unit: str, name: Column) -> DataFrame:
    """Counters of the targets a verdict kept from being read."""
    zero = F.lit(0)
    left_out = judged.where("verdict <> 'scan'")
    error = F.concat_ws(": ", F.col("source"), F.col("error"))
    return files.with_source(left_out, name).select(*_stats(F.col("verdict"), unit, zero, zero, zero, error))


def _scan_contents(
    lines: DataFrame, cells: DataFrame, name: Column, kind: str, detectors: Sequence[Detector], overrides
) -> DataFrame:
    units = [files.line_units(lines, name, kind), files.cell_units(cells, name, kind, detectors)]
    return cut_lineage(_union([scan_rows(u, detectors, overrides, carry="stat", keep=["origin"]) for u in units]))


def _in_files(rows: DataFrame) -> DataFrame:
    """Findings with lines of their file: those of later ranges move on by the lines before, those in cells of
    files that the CSV reader gave up late are dropped (their lines were scanned too)."""
    findings = rows.where("data_type is not null").select(*FINDING_COLUMNS, "origin")
    path, number = F.col("origin.path"), F.col("origin.range")
    stats = rows.where("stat is not null").select("stat.*")
    cases = stats.agg(F.max("range"), F.max(F.col("rolled_back").cast("int"))).first()
    if cases[0]:
        # a row for each range; a file has as many as its size over the width of a range
        before = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        shifts = stats.select("path", "range", F.sum("lines").over(before).alias("shift")).where("range > 0")
        shifts = shifts.withColumnsRenamed({"path": "p", "range": "r"})
        later = findings.where(number > 0).join(shifts, (path == F.col("p")) & (number == F.col("r")), "left")
        later = later.withColumn("line", (F.col("line") + F.coalesce("shift", F.lit(0))).cast("int"))
        findings = findings.where(number == 0).unionByName(later.select(*findings.columns))
    if cases[1]:
        given_up = stats.where("rolled_back").select(F.col("path").alias("p"))
        findings = findings.join(given_up, F.col("origin.is_csv") & (path == F.col("p")), "left_anti")
    return findings.select(*FINDING_COLUMNS)


def _split_rows(rows: DataFrame, unit: str) -> tuple[DataFrame, DataFrame]:
    s = F.col("stat")
    error = F.concat_ws(": ", s["source"], s["error"])
    # later ranges of a file add lines, the first one stands for the file
    whole = F.when((s["range"] > 0) & (s["status"] != "error"), F.lit("range")).otherwise(s["status"])
    stats = rows.where("stat is not null").select(*_stats(whole, unit, s["lines"], F.lit(0), s["bytes"], error))
    return _in_files(rows), stats


def _is_csv() -> Column:
    return files.extension_of(F.col("relative")) == ".csv"


def _scan_files(spark, source: FileSource, detectors, overrides) -> tuple[DataFrame, DataFrame]:
    judged = cut_lineage(_judged_files(spark, source))
    lines, cells = files.read_tree(judged.where(~_is_csv()), source.rules.range_bytes), files.csv_cells_of(judged.where(_is_csv()))
    rows = _scan_contents(lines, cells, F.col("path"), source.source_type, detectors, overrides)
    findings, stats = _split_rows(rows, "files")
    return findings, stats.unionByName(_judged_stats(judged, "files", F.col("path")))


def _judged_files(spark, source: FileSource) -> DataFrame:
    listing = files.list_tree(spark, source.paths, source.rules.follow_links, source.rules.allow)
    return files.verdicts(listing, source.rules)


def _judged_objects(spark, source: ObjectSource) -> DataFrame:
    if not source.bucket:
        raise ValueError("object source needs a bucket name")
    listing = files.list_objects(spark, source.root, source.prefix)
    return files.verdicts(listing, source.rules, absolute=False)


def _scan_objects(spark, source: ObjectSource, detectors, overrides) -> tuple[DataFrame, DataFrame]:
    judged = cut_lineage(_judged_objects(spark, source))
    rules = source.rules
    if files.tasks_open(source.root):
        lines, cells = files.read_tree(judged.where(~_is_csv()), rules.range_bytes), files.csv_cells_of(judged.where(_is_csv()))
    else:
        others = [s for s in rules.suffixes if s != ".csv"]
        lines = files.read_objects(spark, source.root, source.prefix, rules, others)
        cells = files.whole_csv(files.read_objects(spark, source.root, source.prefix, rules, [".csv"]))
    name = files.object_uri(source.bucket, source.root)
    rows = _scan_contents(lines, cells, name, source.source_type, detectors, overrides)
    findings, stats = _split_rows(rows, "objects")
    # listed but not read: gone or unreadable
    read = rows.where("stat is not null").select(F.col("stat.path").alias("path"))
    lost = judged.where("verdict = 'scan'").join(read, "path", "left_anti")
    lost = lost.withColumns({"verdict": F.lit("error"), "error": F.lit("cannot be read")})
    return findings, _union([stats, _judged_stats(judged, "objects", name), _judged_stats(lost, "objects", name)])


def _scan_tables(spark, source: TableSource, detectors, overrides) -> tuple[DataFrame, DataFrame]:
    if not source.specs:
        raise ValueError("table source has no tables to scan")
    zero = F.lit(0)

    def told(status: str, rows: int = 0, error: str | None = None) -> DataFrame:
        frame = spark.createDataFrame([(error,)], "m string").withColumn("m", redacted("m"))
        return frame.select(*_stats(F.lit(status), "tables", zero, F.lit(rows), zero, F.col("m")))

    def one(spec: tables.TableSpec) -> tuple[DataFrame | None, DataFrame]:
        if tables.table_allowed(spec, source.allow_tables):
            return None, told("skipped")
        try:
            frame = source.load(spark, spec)
            if not tables.scan_columns(frame, spec, source.allow_columns):
                return None, told("skipped")
            if not spec.id_column and source.key_of:
                spec = replace(spec, id_column=source.key_of(spark, spec))
            units = tables.cells_of(frame, spec, source.allow_columns, source.source_type)
            found = cut_lineage(scan_units(units, detectors, overrides))
            found, rows = tables.with_numbers(found, frame, spec, source.allow_columns)
            return found, told("scanned", rows=rows)
        except Exception as problem:  # one broken table must not stop the others
            return None, told("error", error=_describe(spec.label, problem))

    with ThreadPoolExecutor(min(source.at_once, len(source.specs))) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(one), source.specs))
    findings = [_empty(spark, FINDINGS_SCHEMA), *[found for found, _ in done if found is not None]]
    return _union(findings), _union([_empty(spark, report.STATS_SCHEMA), *[stats for _, stats in done]])


def _plan_tables(spark, source: TableSource) -> DataFrame:
    if not source.specs:
        raise ValueError("table source has no tables to scan")
    # the detail is fixed output
    rows = [
        (
            source.source_type,
            spec.label,
            None,
            "columns: " + (", ".join(spec.columns) if spec.columns else "all text-like columns (auto-discovered)"),
        )
        for spec in source.specs
        if not tables.table_allowed(spec, source.allow_tables)
    ]
    return spark.createDataFrame(rows, TARGETS_SCHEMA)


def _plan(spark, source) -> DataFrame:
    if isinstance(source, TableSource):
        return _plan_tables(spark, source)
    if isinstance(source, ObjectSource):
        name = files.object_uri(source.bucket, source.root)
        return files.plan_targets(_judged_objects(spark, source), name, source.source_type)
    return files.plan_targets(_judged_files(spark, source), F.col("path"), source.source_type)


def _scan(spark, source, detectors, overrides) -> tuple[DataFrame, DataFrame]:
    if isinstance(source, TableSource):
        return _scan_tables(spark, source, detectors, overrides)
    if isinstance(source, ObjectSource):
        return _scan_objects(spark, source, detectors, overrides)
    return _scan_files(spark, source, detectors, overrides)


def run_scan(
    spark: SparkSession,
    sources: Sequence[FileSource | ObjectSource | TableSource],
    detectors: Sequence[Detector] | None = None,
    overrides: Mapping[str, str] | None = None,
    dry_run: bool = False,
) -> ScanResult:
    """Scan or, on a dry run, list every source; a source that fails is recorded and
    the others still run (S20)."""
    chosen = build_detectors() if detectors is None else detectors
    if not chosen:
        raise ValueError("a scan needs at least one detector")
    started = datetime.now(timezone.utc)
    found, stats = [_empty(spark, FINDINGS_SCHEMA)], [_empty(spark, report.STATS_SCHEMA)]
    targets, failed = [_empty(spark, TARGETS_SCHEMA)], []
    for source in sources:
        try:
            if dry_run:
                targets.append(cut_lineage(_plan(spark, source)))
            else:
                findings, counters = _scan(spark, source, chosen, overrides)
                found.append(findings)
                stats.append(counters)
        except Exception as problem:  # a broken source must not hide the others
            failed.append(mask_message(spark, _describe(source.source_type, problem)))
    return ScanResult(
        _union(found),
        _union(stats),
        _union(targets),
        [s.source_type for s in sources],
        started,
        datetime.now(timezone.utc),
        dry_run,
        failed,
    )
