"""Line dedup (2): lines that repeat across documents stay in one document only.

1. Every task hashes the long lines of its rows (each once a row) and sends the Bloom bit
   positions, split by filter slice.  Folding a slice gives two filters: bits seen once and
   bits seen at least twice.
2. Only lines whose bits are all in the twice-seen filter are suspects; their 128-bit
   digests and document ids shuffle for exact counts and the choice of the document that
   keeps the line (the largest id).  A filter that fills up only adds suspects.
3. The confirmed digests go to all tasks if they are few (checked), which then rewrite
   their rows in place; otherwise the dropped digests of each document join it by id.

Null text is one empty line.  Rows without an id keep all lines and do not count; rows that
share an id are one document.  Extra columns pass through; input columns named like the
added ``n_lines`` and ``n_dropped`` are replaced.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mixed, sliced, texts_of, unused, written

_BLANK = " \t\n\x0b\x0c\r"
_SLICE = 20  # log2 of the bits in one slice of a filter
_FLUSH = 1 << 21  # hashes a task holds


class _Lines:
    """The lines of some texts; ``row`` and ``key`` of the long ones."""

    def __init__(self, texts: pa.Array, least: int):
        lists = pc.split_pattern(texts, "\n")
        self.flat = lists.flatten()
        self.ends = lists.offsets.to_numpy(zero_copy_only=False)
        self.ends = self.ends - self.ends[0]
        keys = pc.ascii_lower(pc.ascii_trim(self.flat, characters=_BLANK))
        wide = pc.greater_equal(pc.utf8_length(keys), least).to_numpy(zero_copy_only=False)
        self.at = np.flatnonzero(wide)
        self.row = np.searchsorted(self.ends, self.at, side="right") - 1
        coded = keys.filter(pa.array(wide)).dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False)
        self.keys = coded.dictionary.cast(pa.binary()).to_pylist()
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.keys), np.uint64, len(self.keys))

    def once_a_row(self) -> np.ndarray:
        """Places in ``row`` and ``code`` of each (row, key), once."""
        return np.unique(self.row.astype(np.int64) * max(len(self.keys), 1) + self.code, return_index=True)[1]


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - bits)
    return mixed(hashes) >> shift, mixed(hashes + np.uint64(0x9E3779B97F4A7C15)) >> shift


def _marks(docs: DataFrame, least: int, bits: int) -> DataFrame:
    """Per task and slice: offsets of bits set once or more, and of those set twice or more."""

    def emit(held: list[np.ndarray]):
        places, counts = np.unique(np.concatenate(held), return_counts=True)
        slices = places >> np.uint64(_SLICE)
        cuts = np.flatnonzero(np.diff(slices, prepend=slices[:1] + 1 if len(slices) else slices))
        ids, once, twice = [], [], []
        for lo, hi in zip(cuts, [*cuts[1:], len(places)]):
            part = (places[lo:hi] & np.uint64((1 << _SLICE) - 1)).astype("<u4")
            ids.append(int(slices[lo]))
            once.append(part.tobytes())
            twice.append(part[counts[lo:hi] > 1].tobytes())
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["slice", "once", "twice"])

    def run(batches):
        held, size = [], 0
        for batch in sliced(batches, 1 << 21):
            lines = _Lines(texts_of(batch), least)
            found = lines.hashes[lines.code[lines.once_a_row()]]
            for places in _positions(found, bits):
                held.append(places)
            size += 2 * len(found)
            if size > _FLUSH:
                yield emit(held)
                held, size = [], 0
        if size:
            yield emit(held)

    return docs.select("text").mapInArrow(run, "slice long, once binary, twice binary")


def _fold(marks: DataFrame) -> DataFrame:
    """The twice-seen filter, a packed bitmap for each slice; tasks stream over sorted slices."""

    def run(batches):
        current, seen, twice = None, None, None
        out = lambda: pa.record_batch([pa.array([current], pa.int64()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["slice", "bits"])
        for batch in batches:
            for at, once, more in zip(*(c.to_pylist() for c in batch.columns)):
                if at != current:
                    if current is not None:
                        yield out()
                    current = at
                    seen, twice = np.zeros(1 << _SLICE, bool), np.zeros(1 << _SLICE, bool)
                places = np.frombuffer(once, "<u4")
                twice[places[seen[places]]] = True
                seen[places] = True
                twice[np.frombuffer(more, "<u4")] = True
        if current is not None:
            yield out()

    return marks.repartition("slice").sortWithinPartitions("slice").mapInArrow(run, "slice long, bits binary")


class _Filter:
    def __init__(self, packed: bytes, bits: int):
        self.packed, self.bits = np.frombuffer(packed, np.uint8), bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for places in _positions(hashes, self.bits):
            found &= (self.packed[places >> np.uint64(3)] >> (7 - (places & np.uint64(7))).astype(np.uint8)) & 1 == 1
        return found


def _twice_seen(docs: DataFrame, least: int, bits: int) -> _Filter:
    """The filter has 2 ** bits bits whatever the input: bounded on the driver and the tasks."""
    whole = bytearray(1 << (bits - 3))
    width = 1 << (_SLICE - 3)
    for row in _fold(_marks(docs, least, bits)).toLocalIterator():
        whole[row["slice"] * width : (row["slice"] + 1) * width] = row["bits"]
    return _Filter(bytes(whole), bits)


def _suspects(docs: DataFrame, least: int, shared) -> DataFrame:
    def run(batches):
        for batch in sliced(batches, 1 << 21):
            lines = _Lines(texts_of(batch), least)
            likely = shared.value.has(lines.hashes)
            digests = [_digest(k) if s else None for k, s in zip(lines.keys, likely)]
            places = lines.once_a_row()
            places = places[likely[lines.code[places]]]
            ids = batch.column("doc_id").to_pylist()
            rows = [(digests[lines.code[p]], ids[lines.row[p]]) for p in places]
            rows = [r for r in rows if r[1] is not None]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], ["digest", "doc_id"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "digest binary, doc_id long")


def dedup_lines(
    docs: DataFrame,
    least_chars: int = 40,
    least_docs: int = 5,
    bits_per_line: int = 12,
    most_bits: int = 30,
    most_confirmed: int = 400_000,
) -> DataFrame:
    """``docs`` with lines of at least ``least_chars`` (trimmed, lower-cased) that at least
    ``least_docs`` documents hold dropped from all but the largest ``doc_id``.

    ``most_bits`` bounds the filters (log2 of bits), ``most_confirmed`` the digests sent to
    all tasks; beyond it a join by document id does the same.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(most_bits, max(_SLICE, math.ceil(math.log2(1 + bits_per_line * chars / (2 * least_chars)))))
    shared = spark.sparkContext.broadcast(_twice_seen(docs, least_chars, bits))
    suspects = written(_suspects(docs, least_chars, shared), "line-suspects")
    counted = suspects.groupBy("digest").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keep"))
    confirmed = written(counted.where(F.col("n") >= least_docs).select("digest", "keep"), "line-confirmed")
    few = confirmed.count() <= most_confirmed

    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(*[docs[c] for c in names])
    gone_name, gone_id = unused(docs, "gone"), unused(docs, "gone_id")
    if few:
        keep = spark.sparkContext.broadcast({bytes(r["digest"]): r["keep"] for r in confirmed.collect()})
    else:
        gone = suspects.join(confirmed, "digest").where("doc_id <> keep").groupBy("doc_id")
        gone = gone.agg(F.collect_set("digest").alias(gone_name)).withColumnRenamed("doc_id", gone_id)
        rows = rows.join(gone, F.col("doc_id").cast("long") == F.col(gone_id), "left").drop(gone_id)
    fields = [f for f in rows.schema if f.name in names]
    schema = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def rewrite(batches):
        for batch in sliced(batches, 1 << 21):
            texts = texts_of(batch)
            lines = _Lines(texts, least_chars)
            ids = batch.column("doc_id").to_pylist()
            drop = np.zeros(len(lines.flat), bool)
            if few:
                likely = shared.value.has(lines.hashes)
                keepers = [keep.value.get(_digest(k)) if s else None for k, s in zip(lines.keys, likely)]
                hit = np.array([k is not None for k in keepers], bool)
                for p in np.flatnonzero(hit[lines.code]) if len(keepers) else []:
                    own = ids[lines.row[p]]
                    drop[lines.at[p]] = own is not None and own != keepers[lines.code[p]]
            else:
                gone = [frozenset(map(bytes, g)) if g else () for g in batch.column(gone_name).to_pylist()]
                for p in range(len(lines.at)) if any(gone) else []:
                    own = gone[lines.row[p]]
                    drop[lines.at[p]] = bool(own) and _digest(lines.keys[lines.code[p]]) in own
            texts = texts.to_pylist()
            dropped = np.add.reduceat(drop, lines.ends[:-1]) if len(drop) else np.zeros(len(ids), int)
            for row in np.flatnonzero(dropped):
                lo, hi = lines.ends[row], lines.ends[row + 1]
                own = lines.flat.slice(lo, hi - lo).to_pylist()
                texts[row] = "\n".join(x for x, d in zip(own, drop[lo:hi]) if not d)
            given = batch.column("text").is_null().to_pylist()
            columns = [
                pa.array([None if g and not d else t for t, g, d in zip(texts, given, dropped)], pa.string())
                if c == "text"
                else batch.column(c)
                for c in names
            ]
            columns += [pa.array(np.diff(lines.ends), pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.record_batch(columns, [*names, "n_lines", "n_dropped"])

    return rows.mapInArrow(rewrite, schema)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more that 5 documents share, over all documents."""
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return found.select("doc_id", "n_lines", "n_dropped", kept)


SQL = """
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, parts[i] AS line, i,
         translate(trim(parts[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM split)
), repeated AS (
  SELECT key, max(doc_id) AS keep FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT doc_id, line, i, keep IS NOT NULL AND keep <> doc_id AS gone FROM lines LEFT JOIN repeated USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
