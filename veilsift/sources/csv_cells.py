"""CSV records to cells: the one part of a scan that needs Python's csv reader.

Every file is parsed once, as a stream of lines.  Its first cells wait in a spool of bounded size; a file
that the reader rejects within it leaves nothing but its lines.  Beyond the spool cells leave at once, and
if the reader then rejects the file, its lines follow and its counters say ``rolled_back``: the scan drops
the findings in its cells (``plans.scan_job``).  Small files share a batch.

Column names, detection and counters stay in Spark.
"""

from __future__ import annotations

import csv
import itertools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: Cells of an output row, and what an output batch holds at least before it leaves.
CHUNK_CELLS = 4096
BATCH_CELLS = 16384
BATCH_ROWS = 1024
#: Characters of cells held back while a file may still be rejected.
SPOOL = 32 << 20
#: Lines the delimiter is guessed from, and the delimiters tried.
SNIFF_LINES = 20
DELIMITERS = ",;\t|"

CELLS_SCHEMA = (
    "path string, is_csv boolean, header array<string>, "
    "cells array<struct<line:int,idx:int,text:string>>, "
    "stat struct<status:string,lines:bigint,bytes:bigint,error:string,rolled_back:boolean>"
)
_CELL = pa.struct([("line", pa.int32()), ("idx", pa.int32()), ("text", pa.string())])
_STAT = pa.struct(
    [("status", pa.string()), ("lines", pa.int64()), ("bytes", pa.int64()), ("error", pa.string()), ("rolled_back", pa.bool_())]
)
_NAMES = ["path", "is_csv", "header", "cells", "stat"]


def physical_lines(text: str) -> list[str]:
    lines = [line + "\n" for line in text.split("\n")]
    last = lines.pop()[:-1]
    return lines + [last] if last else lines


def guess_delimiter(lines: list[str]) -> str:
    try:
        return csv.Sniffer().sniff("".join(lines), delimiters=DELIMITERS).delimiter
    except csv.Error:
        return ","


class _Counted:
    """Lines passed on, counted."""

    def __init__(self, lines: Iterable[str]) -> None:
        self.lines, self.count = lines, 0

    def __iter__(self) -> Iterator[str]:
        for line in self.lines:
            self.count += 1
            yield line


def _records(lines: Iterable[str]) -> Iterator[tuple[int, list[str]]]:
    """(physical first line, cells) of every record that is not empty."""
    lines = iter(lines)
    first = list(itertools.islice(lines, SNIFF_LINES))
    reader = csv.reader(itertools.chain(first, lines), delimiter=guess_delimiter(first))
    line = 1
    for record in reader:
        if record:
            yield line, record
        line = reader.line_num + 1


def _chunks(cells: Iterable[tuple]) -> Iterator[list[tuple]]:
    cells = iter(cells)
    while chunk := list(itertools.islice(cells, CHUNK_CELLS)):
        yield chunk


def _stat(lines: int, size: int, rolled_back: bool = False) -> dict:
    return {"status": "scanned", "lines": lines, "bytes": size, "error": None, "rolled_back": rolled_back}


def file_rows(path: str, size: int, open_lines: Callable[[], Iterable[str]], spool: int = SPOOL) -> Iterator[tuple]:
    """Rows of one file: cells in chunks, then the counters, once."""
    lines = _Counted(open_lines())
    held: list[tuple] = []
    waiting, free = 0, False
    header: list[str] = []

    def cells(records: Iterator[tuple[int, list[str]]]) -> Iterator[tuple]:
        for line, record in records:
            if not header:
                header.extend(record)
            for idx, text in enumerate(record):
                if text and not text.isspace():
                    yield line, idx, text

    try:
        for chunk in _chunks(cells(_records(lines))):
            row = (path, True, header, chunk, None)
            if free:
                yield row
                continue
            held.append(row)
            waiting += sum(len(text) for _, _, text in chunk)
            if waiting > spool:
                free = True
                yield from held
                held = []
    except csv.Error:
        lines = _Counted(open_lines())
        plain = ((n, None, text.removesuffix("\n")) for n, text in enumerate(lines, 1) if text.strip())
        for chunk in _chunks(plain):
            yield path, False, [], chunk, None
        yield path, False, [], [], _stat(lines.count, size, free)
        return
    if held:
        yield from held[:-1]
        yield *held[-1][:4], _stat(lines.count, size)
    else:
        yield path, True, header, [], _stat(lines.count, size)


def _unread(path: str, size: int, error: str | None) -> tuple:
    status = "error" if error else "skipped"
    return path, False, [], [], {"status": status, "lines": 0, "bytes": size, "error": error, "rolled_back": False}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    paths, is_csv, headers, cells, stats = zip(*rows)
    ends = list(itertools.accumulate(map(len, cells), initial=0))
    columns = zip(*itertools.chain.from_iterable(cells)) if ends[-1] else ((), (), ())
    arrays = [pa.array(v, t.type) for v, t in zip(columns, _CELL)]
    listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(arrays, fields=list(_CELL)))
    return pa.RecordBatch.from_arrays(
        [pa.array(paths, pa.string()), pa.array(is_csv, pa.bool_()), pa.array(headers, pa.list_(pa.string())), listed, pa.array(stats, _STAT)],
        _NAMES,
    )


def batched(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of many files in batches of bounded size."""
    csv.field_size_limit(1 << 28)
    held: list[tuple] = []
    cells = 0
    for row in rows:
        held.append(row)
        cells += len(row[3])
        if cells >= BATCH_CELLS or len(held) >= BATCH_ROWS:
            yield _batch(held)
            held, cells = [], 0
    if held:
        yield _batch(held)


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for path, size, error, text in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "error", "text"))):
            if text is None:
                yield _unread(path, size, error)
            else:
                yield from file_rows(path, size, lambda text=text: physical_lines(text))


def csv_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of whole files (``path, size, error, text``) in, cells out."""
    yield from batched(_text_rows(batches))


def csv_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of files (``path, size``) in, cells out: tasks open the files and stream them."""
    from .ranges import open_lines

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist()):
                try:
                    if open_lines(path) is None:
                        yield _unread(path, size, None)
                    else:
                        yield from file_rows(path, size, lambda path=path: open_lines(path))
                except OSError as problem:
                    yield _unread(path, size, problem.strerror or str(problem) or type(problem).__name__)

    yield from batched(rows())
