"""Helpers shared by the operators of this folder: intermediate tables, words, ids of words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilsift.plans.shared import written  # noqa: F401, the operators take it from here


def small_side(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` marked for a broadcast if its counted ``rows`` stay within ``most``; otherwise
    as it is, and the join shuffles."""
    return F.broadcast(df) if rows <= most else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Freed memory goes back to the system: workers live on and share an executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # only glibc can be asked
            ctypes.CDLL(None).malloc_trim(0)


def sliced(batches, most_bytes: int = 1 << 23):
    """Record batches cut so that each holds about ``most_bytes`` (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        give_back()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """A text column, null as the empty text."""
    return pc.fill_null(batch.column(column).cast(pa.string()), "")


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space: where each text starts, the code of each word, the vocabulary."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    counts = np.diff(lists.offsets.to_numpy(zero_copy_only=False)) if len(lists) else np.zeros(0, int)
    filled = pc.greater(pc.binary_length(flat), 0)
    owner = np.repeat(np.arange(len(texts)), counts)[filled.to_numpy(zero_copy_only=False)]
    coded = flat.filter(filled).dictionary_encode()
    starts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts))))).astype(np.int64)
    return starts, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit values (the splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` consecutive word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(width):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n] + np.uint64(k + 1))
    return out
