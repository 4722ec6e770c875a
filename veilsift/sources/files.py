"""Files and objects as targets and text units.

Two stages that share no bytes: a *listing* (path, relative, size) decides what
may be read, and the *contents* of what is left are decoded, cut into lines or CSV
cells and handed on.  Files that tasks can open are listed once by tasks (``walk``), read
as byte ranges (``ranges``) or, if CSV, as streams; other stores go through Spark's reader
of whole files, which hides names that start with ``_`` or ``.``.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.globs import path_matches
from ..operators.scan import as_units, redacted
from .csv_cells import CELLS_SCHEMA, csv_batches, csv_files
from .lines import HAS_TEXT, lines_in
from .ranges import RANGE, read_ranges, spread_by_size
from .walk import entry, mounted, tasks_open, walk

# Extensions scanned and the size limit when nothing else is said.
EXTENSIONS = (".txt", ".csv", ".json", ".log", ".sql")
MAX_MB = 100

LISTING = "path string, relative string, size bigint, link boolean, error string"
CONTENTS = "path string, size bigint, content binary, error string"
#: Counters of a file, or of a range of it, that travel with the findings of a scan.
STAT = (
    "struct<path:string,range:int,source:string,status:string,lines:bigint,bytes:bigint,error:string,rolled_back:boolean>"
)
#: Where a unit was read: what turns a line of a range into one of its file.
ORIGIN = "struct<path:string,range:int,is_csv:boolean>"


@dataclass(frozen=True)
class FileRules:
    """What is scanned: extensions, allowlist globs, size limit, links; bytes of a range (even)."""

    extensions: Sequence[str] = EXTENSIONS
    allow: Sequence[str] = ()
    max_mb: float = MAX_MB
    follow_links: bool = False
    range_bytes: int = RANGE

    @property
    def suffixes(self) -> tuple[str, ...]:
        cleaned = (e.strip().lower() for e in self.extensions)
        return tuple(e if e.startswith(".") else f".{e}" for e in cleaned if e)

    @property
    def max_bytes(self) -> int:
        return int(self.max_mb * 1024 * 1024)


def extension_of(path: Column) -> Column:
    """Last suffix of the file name, lower-cased; a name like ``.csv`` has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


# --------------------------------------------------------------------- listing


def list_tree(
    spark: SparkSession, roots: Sequence[str], follow_links: bool = False, allow: Sequence[str] = ()
) -> DataFrame:
    """Every file below the roots of a file system mounted on all nodes.

    The driver looks at the roots alone; folders that ``allow`` covers are never opened (N2).
    """
    if not roots:
        raise ValueError("give at least one folder or file")
    files: list[tuple] = []
    folders: list[tuple[str, str]] = []
    for root in map(str, map(Path, roots)):
        if not os.path.exists(root):
            raise FileNotFoundError(f"nothing to read at {root}")
        if os.path.isdir(root):
            folders.append((root, ""))
        else:
            files.append(entry(root, os.path.basename(root))[:-1])

    def opened(found: DataFrame) -> DataFrame:
        return found.where(~path_matches(allow, F.col("relative"), _absolute(F.col("path")))) if allow else found

    listed = walk(spark, folders, follow_links, opened)
    return listed.unionByName(spark.createDataFrame(files, LISTING)) if files else listed


def open_store(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """A bucket or directory on a store that only Spark opens, one row per object of the longest
    folder in ``prefix``: its siblings are not listed.  Names that start with ``_`` or
    ``.`` are hidden from Spark's listing."""
    reader = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("ignoreMissingFiles", "true")
        .option("ignoreCorruptFiles", "true")
    )
    folder = prefix.rpartition("/")[0].strip("/")
    if not folder or re.search(r"[*?\[\]{}\\]", folder):  # a glob for Spark
        return reader.load(root)
    try:
        return reader.load(f"{root.rstrip('/')}/{folder}")
    except AnalysisException:  # no such folder, so no object has the prefix; a missing root still raises
        return reader.load(root).limit(0)


def _metadata_path() -> Column:
    # the metadata path is percent-encoded; a plus sign in it is a plus sign
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _key_of(path: Column, root: str) -> Column:
    """Object key: what follows the bucket root, whatever form the URI has."""
    plain = root.split(":", 1)[-1].strip("/")
    return F.regexp_replace(path, rf"^(?:[A-Za-z][A-Za-z0-9+.-]*+:)?/*+\Q{plain}\E/++", "")


def list_objects(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """Objects whose key starts with ``prefix``; folder marks and empty objects are
    dropped and not counted (S5).  Reads no content; siblings of the longest folder in
    ``prefix`` are not listed."""
    if not root:
        raise ValueError("object source needs a bucket")
    if tasks_open(root):
        base, folder = mounted(root).rstrip("/"), prefix.rpartition("/")[0].strip("/")
        if base.startswith("/") and not os.path.isdir(base):
            raise FileNotFoundError(f"nothing to read at {root}")
        keyed = walk(spark, [(f"{base}/{folder}" if folder else base, folder)], follow=True)
    else:
        objects = open_store(spark, root, prefix).select("path", F.col("length").alias("size"))
        keyed = objects.withColumn("relative", _key_of(F.col("path"), root))
    return keyed.where(F.startswith("relative", F.lit(prefix)) & (F.col("size") > 0)).select(
        "path", "relative", "size", F.lit(False).alias("link"), F.lit(None).cast("string").alias("error")
    )


# --------------------------------------------------------------------- verdicts


def verdicts(listing: DataFrame, rules: FileRules, absolute: bool = True) -> DataFrame:
    """The listing with a ``verdict``: ``scan``, ``skipped`` or ``error``.

    Other extensions, and files below an allowlisted directory, are not rows at all:
    they were never candidates.  Order of the tests: extension, allowlist, link, size.
    """
    rel, path = F.col("relative"), _absolute(F.col("path"))
    rows = listing.where(extension_of(rel).isin(*rules.suffixes))
    allowed = F.lit(False)
    if rules.allow:
        if absolute:
            rows = rows.where(~_below_allowed(rel, path, rules.allow))
        allowed = path_matches(rules.allow, rel, path if absolute else None)
    verdict = (
        F.when(allowed, "skipped")
        .when(F.col("link") & F.lit(not rules.follow_links), "skipped")
        .when(F.col("error").isNotNull(), "error")
        .when(F.col("size") > rules.max_bytes, "skipped")
        .otherwise("scan")
    )
    return rows.withColumn("verdict", verdict)


def _absolute(path: Column) -> Column:
    return F.when(path.rlike("^(?:/|[A-Za-z][A-Za-z0-9+.-]*:)"), path).otherwise(F.concat(F.lit(os.getcwd() + "/"), path))


def _below_allowed(relative: Column, path: Column, allow: Sequence[str]) -> Column:
    """Is any directory above the file allowlisted?"""
    parts = F.split(relative, "/")
    root = F.substring(path, F.lit(1), F.length(path) - F.length(relative))
    depths = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: n > 0)

    def test(n: Column) -> Column:
        above = F.array_join(F.slice(parts, F.lit(1), n), "/")
        return path_matches(allow, above, F.concat(root, above))

    return F.exists(depths, test)


def plan_targets(judged: DataFrame, name: Column, source_type: str) -> DataFrame:
    """What a scan would read, without reading it (S19); names are masked."""
    return judged.where("verdict = 'scan'").withColumn("name", name).select(
        F.lit(source_type).alias("source_type"),
        redacted("name").alias("name"),
        F.col("size").alias("size_bytes"),
        F.lit(None).cast("string").alias("detail"),
    )


# --------------------------------------------------------------------- contents


def read_tree(judged: DataFrame, width: int = RANGE) -> DataFrame:
    """Ranges of the files to scan, whole lines each; a file that cannot be read becomes an
    error row and stops nothing (S21)."""
    return read_ranges(judged.where("verdict = 'scan'"), width)


def csv_cells_of(judged: DataFrame) -> DataFrame:
    """Cells of the CSV files to scan: tasks stream the files, no content passes the JVM before it is cut."""
    chosen = judged.where("verdict = 'scan'").select("path", "size")
    return spread_by_size(chosen, F.col("size")).mapInArrow(csv_files, CELLS_SCHEMA)


def read_objects(
    spark: SparkSession, root: str, prefix: str, rules: FileRules, suffixes: Sequence[str] | None = None
) -> DataFrame:
    """Bytes of the objects to scan.  The tests are on file metadata, so Spark drops
    the other objects while planning and never opens them."""
    key = _key_of(_metadata_path(), root)
    wanted = (
        extension_of(key).isin(*(rules.suffixes if suffixes is None else suffixes))
        & F.startswith(key, F.lit(prefix))
        & F.col("_metadata.file_size").between(1, rules.max_bytes)
    )
    if rules.allow:
        wanted = wanted & ~path_matches(rules.allow, key)
    return open_store(spark, root, prefix).where(wanted).select(
        "path", F.col("length").alias("size"), "content", F.lit(None).cast("string").alias("error")
    )


# ----------------------------------------------------------------- decode, cut


@F.pandas_udf(T.StringType())
def _decode_utf16(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-16", "replace"))


def decoded(contents: DataFrame) -> DataFrame:
    """Adds ``text``: UTF-8 or UTF-16 by byte-order mark, else UTF-8, bad bytes
    replaced; null for binary content, a NUL in the first 8192 bytes (S6).

    UTF-8 stays in the JVM; only files with a UTF-16 mark are shipped to Python.
    """

    def starts(mark: str) -> Column:
        return F.startswith("content", F.expr(f"X'{mark}'"))

    utf16 = starts("FFFE") | starts("FEFF")
    binary = F.contains(F.substring("content", 1, 8192), F.expr("X'00'"))
    body = F.when(starts("EFBBBF"), F.expr("substring(content, 4)")).otherwise(F.col("content"))
    utf8 = F.make_valid_utf8(body.cast("string"))
    wide = contents.withColumn("wide", _decode_utf16(F.when(utf16, F.col("content"))))
    text = F.coalesce("wide", F.when(starts("EFBBBF") | ~binary, utf8))
    return wide.withColumn("text", text).drop("wide")


def ranged_texts(ranges: DataFrame) -> DataFrame:
    """Adds ``text`` to the rows of :func:`read_tree`: UTF-8 with bad bytes replaced, null for binary content."""
    utf8 = F.make_valid_utf8(F.col("content").cast("string"))
    return ranges.withColumn("text", F.when(F.col("status") == "scanned", utf8))


def _stat(**fields: Column) -> Column:
    defaults = {"range": F.lit(0), "rolled_back": F.lit(False)}
    names = ("path", "range", "source", "status", "lines", "bytes", "error", "rolled_back")
    return F.struct(*[(fields.get(n, defaults.get(n))).alias(n) for n in names]).cast(STAT)


def _status(text: Column) -> Column:
    return F.when(F.col("error").isNotNull(), "error").when(text.isNull(), "skipped").otherwise("scanned")


def line_units(contents: DataFrame, name: Column, source_type: str) -> DataFrame:
    """Lines of files, with the counters of a file or range on its first row.

    ``contents`` are whole files (``path, size, content, error``) or ranges of them.
    """
    texts = ranged_texts(contents) if "range" in contents.columns else decoded(contents).withColumn("range", F.lit(0))
    files = with_source(texts, name).select(
        "path", "range", "source", "size", "error", _status(F.col("text")).alias("status"), lines_in(F.col("text")).alias("lines")
    )
    rows = files.select(
        "path", "range", "source", "status", "size", "error",
        F.size("lines").alias("n"), F.posexplode_outer("lines").alias("at", "text"),
    )
    first = F.coalesce("at", F.lit(0)) == 0
    stat = F.when(
        first,
        _stat(
            path=F.col("path"), range=F.col("range"), source=F.col("source"), status=F.col("status"),
            lines=F.greatest("n", F.lit(0)), bytes=F.col("size"), error=F.col("error"),
        ),
    )
    shaped = rows.select(
        F.lit(source_type).alias("source_type"),
        "source",
        (F.col("at") + 1).cast("int").alias("line"),
        F.lit(None).cast("string").alias("column_name"),
        F.lit(None).cast("bigint").alias("row"),
        F.lit(None).cast("string").alias("row_id"),
        "text",
        stat.alias("stat"),
        F.struct("path", "range", F.lit(False).alias("is_csv")).cast(ORIGIN).alias("origin"),
    )
    return shaped.where(F.col("text").rlike(HAS_TEXT) | F.col("stat").isNotNull())


def csv_units(contents: DataFrame, name: Column, source_type: str, detectors: Sequence) -> DataFrame:
    """Cells of CSV files given as whole contents; see :func:`cell_units`."""
    return cell_units(whole_csv(contents), name, source_type, detectors)


def whole_csv(contents: DataFrame) -> DataFrame:
    texts = decoded(contents).select("path", "size", "error", "text")
    return texts.mapInArrow(csv_batches, CELLS_SCHEMA)


def cell_units(cells: DataFrame, name: Column, source_type: str, detectors: Sequence) -> DataFrame:
    """Cells of CSV files (S8).  The first record names the columns unless one of its
    cells holds a finding; that is decided once per chunk of cells, so neither a
    second read nor a join is needed.  Files the CSV reader rejects come as lines."""
    chunks = with_source(cells, name)
    header_hit = F.lit(False)
    for detector in detectors:
        header_hit = header_hit | F.coalesce(detector.any_in(F.col("header")), F.lit(False))
    named = chunks.select(
        "path",
        "source",
        "stat",
        F.when(~header_hit, F.col("header")).alias("names"),
        F.posexplode_outer("cells").alias("at", "cell"),
        F.col("is_csv"),
    )
    idx = F.col("cell.idx")
    fallback = F.concat(F.lit("col_"), (idx + 1).cast("string"))
    given = F.nullif(F.regexp_replace(F.get("names", idx), r"(?U)^\s+|\s+\z", ""), F.lit(""))
    stat = F.col("stat")
    told = _stat(
        path=F.col("path"), source=F.col("source"), status=stat["status"], lines=stat["lines"], bytes=stat["bytes"],
        error=stat["error"], rolled_back=stat["rolled_back"],
    )
    return named.select(
        F.lit(source_type).alias("source_type"),
        "source",
        F.col("cell.line").alias("line"),
        F.when(F.col("is_csv") & idx.isNotNull(), F.coalesce(given, fallback)).alias("column_name"),
        F.lit(None).cast("bigint").alias("row"),
        F.lit(None).cast("string").alias("row_id"),
        F.col("cell.text").alias("text"),
        F.when(stat.isNotNull() & (F.coalesce("at", F.lit(0)) == 0), told).alias("stat"),
        F.struct("path", F.lit(0).alias("range"), "is_csv").cast(ORIGIN).alias("origin"),
    )


def with_source(contents: DataFrame, name: Column) -> DataFrame:
    """Adds the masked ``source`` of each file: reports never show a raw name."""
    return contents.withColumn("raw_name", name).withColumn("source", redacted("raw_name")).drop("raw_name")


def object_uri(bucket: str, root: str) -> Column:
    """``s3://bucket/key``."""
    return F.concat(F.lit(f"s3://{bucket}/"), _key_of(F.col("path"), root))
