"""Files as byte ranges that end at line ends, so that a file of any size is read by many tasks.

A range owns the lines that begin in it: reading starts after the first line end at or before its first
byte and goes on to the end of the last line that it owns.  All ranges look at the head of the file for
its encoding.  Line numbers are local to a range; sums of the line counts before it make them numbers of
the file (``plans.scan_job``).  One line is one value: only a line of 2 GB or more is an error.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .walk import mounted, remote, scheme_of

#: Bytes of a range; even, so that UTF-16 units are never cut.
RANGE = 32 << 20
#: A value of a column ends below 2 GB.
LONGEST_VALUE = (1 << 31) - 64
RANGED = "path string, size bigint, range int, status string, content binary, error string"
HEAD = 8192
_STEP = 1 << 16


def open_file(path: str):
    """A readable, seekable stream of bytes."""
    local = mounted(path)
    if scheme_of(local):
        store, inner = remote(path)
        return store.open_input_file(inner)
    return open(local, "rb")


def encoding_of(head: bytes) -> tuple[str | None, int]:
    """(encoding, length of its mark) from a file's first bytes; None for binary content."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if head.startswith(mark):
            return name, len(mark)
    return (None, 0) if b"\0" in head[:HEAD] else ("utf-8", 0)


def _newline(encoding: str) -> bytes:
    return "\n".encode(encoding)


def line_start(stream, at: int, base: int, encoding: str, stop: int | None = None) -> int | None:
    """The least position >= ``at`` where a line begins, the end of the file if none does; None if it is
    not before ``stop``."""
    if at <= base:
        return base
    mark = _newline(encoding)
    unit = len(mark)
    at -= unit
    stream.seek(at)
    while block := stream.read(_STEP):
        found = block.find(mark)
        while found >= 0 and (at + found - base) % unit:
            found = block.find(mark, found + 1)
        if found >= 0:
            start = at + found + unit
            return start if stop is None or start < stop else None
        # blocks begin at whole units, so a line end is never cut
        at += len(block)
        if stop is not None and at >= stop:
            return None
    return at if stop is None or at < stop else None


def read_range(path: str, number: int, last: bool, width: int = RANGE) -> tuple[str, bytes | None]:
    """(status, text of the lines that begin in a range, as UTF-8); the last range ends with the file."""
    with open_file(path) as stream:
        encoding, base = encoding_of(stream.read(HEAD))
        if encoding is None:
            return "skipped", None
        start = line_start(stream, number * width, base, encoding, None if last or not number else (number + 1) * width)
        if start is None:
            return "empty", None
        end = None if last else line_start(stream, (number + 1) * width, base, encoding)
        if end is not None and end - start > LONGEST_VALUE:
            raise OSError("a line is larger than one value can be")
        stream.seek(start)
        content = stream.read() if end is None else stream.read(end - start)
    if encoding != "utf-8":
        content = content.decode(encoding, "replace").encode("utf-8", "replace")
    return "scanned", content


def read_ranges(chosen: DataFrame, width: int = RANGE) -> DataFrame:
    """Ranges of the files ``path, size``: one row for each range that owns a line, the first of a file always.

    A file that cannot be read becomes an error row and stops nothing (S21).
    """
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.string()]
    names = ["path", "size", "range", "status", "content", "error"]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, number in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "range"))):
                try:
                    last = (number + 1) * width >= (size or 0)
                    status, content = read_range(path, number, last, width)
                    error = None
                except OSError as problem:
                    status, content, error = "error", None, problem.strerror or str(problem) or type(problem).__name__
                if number and status in ("empty", "skipped"):
                    continue
                row = (path, size, number, status, content, error)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names)

    last = F.floor(F.greatest(F.coalesce("size", F.lit(0)) - 1, F.lit(0)) / width).cast("int")
    ranges = chosen.select("path", "size", F.explode(F.sequence(F.lit(0), last)).alias("range"))
    return spread_by_size(ranges, F.least(F.col("size"), F.lit(width))).mapInArrow(load, RANGED)


def spread_by_size(rows: DataFrame, size, most: int = 128 << 20) -> DataFrame:
    """Names of files, cheap to shuffle, dealt so that a task reads about ``most`` bytes."""
    parts = rows.agg(F.ceil(F.sum(size) / most)).first()[0] or 1
    return rows.repartition(max(int(parts), rows.sparkSession.sparkContext.defaultParallelism))


def open_lines(path: str) -> Iterator[str] | None:
    """Physical lines of a file, with their line ends, as a stream; None for binary content."""
    with open_file(path) as stream:
        encoding, base = encoding_of(stream.read(HEAD))
    if encoding is None:
        return None

    def lines() -> Iterator[str]:
        with open_file(path) as stream:
            stream.seek(base)
            yield from io.TextIOWrapper(stream, encoding, "replace", newline="\n")

    return lines()
