"""Findings of unbounded text: the batch expressions on a streaming DataFrame.

Detection and redaction keep no state, so there is nothing to watermark: each record gives
its findings once.  Counters per source are state, one row for each source, type and risk.
Reports are written a batch at a time into a folder of the batch's number, which a repeated
batch replaces: after a failure nothing is lost or counted twice.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.detector import Detector
from ..operators.registry import build_detectors
from ..operators.scan import redact_table, scan_units
from ..plans import report
from ..sources.lines import lines_of


def scan_stream(
    stream: DataFrame,
    text: str,
    source: Column,
    detectors: Sequence[Detector] | None = None,
    overrides: Mapping[str, str] | None = None,
    source_type: str = "stream",
) -> DataFrame:
    """Masked findings of every line of a text column of a stream."""
    chosen = build_detectors() if detectors is None else detectors
    return scan_units(lines_of(stream, text, source, source_type), chosen, overrides)


def write_findings(findings: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append findings to parquet files; ``once`` drains what is there and stops."""
    writer = findings.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.start(path)


def redact_stream(stream: DataFrame, columns: Iterable[str], detectors: Sequence[Detector] | None = None) -> DataFrame:
    """The stream with the named columns redacted (M8)."""
    return redact_table(stream, columns, detectors)


def counters(findings: DataFrame) -> DataFrame:
    """Findings so far by source, type and risk: state that grows with the sources, not with the findings."""
    return findings.groupBy("source_type", "source", "data_type", "risk").agg(F.count("*").alias("findings"))


def write_counters(findings: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep counters of a stream of findings: every batch writes the rows that it changed, whole, to
    ``path/batch=<number>``."""

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = counters(findings).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """The latest counters: of each source, type and risk the row of the last batch that changed it."""
    rows = spark.read.parquet(path)
    keys = ("source_type", "source", "data_type", "risk")
    return rows.groupBy(*keys).agg(F.max_by("findings", "batch").alias("findings"))


def write_reports(findings: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append masked findings in report form, a folder a batch; a batch that is run again replaces its own."""

    def put(rows: DataFrame, number: int) -> None:
        report.csv_rows(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = findings.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
