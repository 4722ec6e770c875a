"""Packing (4): hierarchical multi-length packing.

Documents become token ids (with an end id each).  A document is routed by its length to
the smallest context tier that holds it; longer ones first give whole windows of the
longest tier.  Windows open with a document of their own tier, gaps are filled with whole
documents of the same or shorter tiers, and what then remains with the cut head of a
short one, so a closed window is full: no padding.  What a partition cannot close goes
on, ids and all, to a second stage that packs the leftovers of up to ``merge`` partitions
together; only the last window there may be partly empty.  Windows of each flush are
dealt, longest first, to step groups of equal token sums.

Null text is an empty text (a document of the end id alone).  Null ids stay null, repeated
rows are packed each for itself, other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import deque

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, sliced, texts_of, written
from .word_ids import WordIds, tokenizer_json

TIERS = (512, 1024, 2048, 4096)
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long, ids binary"
)


class _Packer:
    """Streams documents into windows; holds at most about ``pool`` ids."""

    def __init__(self, base: int, tiers, pool: int, step: int):
        self.tiers, self.pool, self.step = tuple(sorted(tiers)), pool, step
        self.queues = {t: deque() for t in self.tiers}
        self.base, self.next, self.held, self.dealt = base, 0, 0, 0
        self.closed: list[tuple[int, list]] = []

    def add(self, doc_id, start: int, ids: bytes, total: int) -> None:
        longest = self.tiers[-1] * 4
        at = 0
        while len(ids) - at >= longest:
            self.closed.append((self.tiers[-1], [(doc_id, start + at // 4, ids[at : at + longest], total)]))
            at += longest
        if at < len(ids):
            self._queue((doc_id, start + at // 4, ids[at:], total), False)

    def _queue(self, piece, front: bool) -> None:
        size = len(piece[2]) // 4
        queue = self.queues[next(t for t in self.tiers if size <= t)]
        queue.appendleft(piece) if front else queue.append(piece)
        self.held += size

    def _take(self, tier: int):
        piece = self.queues[tier].popleft()
        self.held -= len(piece[2]) // 4
        return piece

    def _window(self, size: int) -> bool:
        """Fill one window of ``size``; undone if the pool has too little for it."""
        if self.held < size:
            return False
        gap, pieces = size, []
        while gap:
            fits = next(
                (t for t in reversed(self.tiers) if t <= size and self.queues[t] and len(self.queues[t][0][2]) <= gap * 4),
                None,
            )
            if fits is None:
                fits = next(t for t in self.tiers if self.queues[t])
            doc_id, start, ids, total = self._take(fits)
            if len(ids) > gap * 4:
                self._queue((doc_id, start + gap, ids[gap * 4 :], total), True)
                ids = ids[: gap * 4]
            pieces.append((doc_id, start, ids, total))
            gap -= len(ids) // 4
        self.closed.append((size, pieces))
        return True

    def pack(self, low: int) -> None:
        """Close windows, of the longest tier that waits first, until ``low`` ids are held."""
        while self.held > low:
            size = next(t for t in reversed(self.tiers) if self.queues[t])
            if not self._window(size):
                break

    def rows(self, with_ids: bool):
        """The pieces of all closed windows, dealt to step groups longest first."""
        self.dealt += -self.dealt % self.tiers[-1]
        for tier, pieces in sorted(self.closed, key=lambda w: -w[0]):
            offset = 0
            for doc_id, start, ids, total in pieces:
                yield (
                    doc_id, start, len(ids) // 4, zlib.crc32(ids), total, self.base + self.next, offset, tier,
                    self.base + self.dealt // self.step, ids if with_ids else None,
                )
                offset += len(ids) // 4
            self.next += 1
            self.dealt += tier
        self.closed = []

    def finish(self) -> None:
        """Close what is left: full windows, then one window that may be partly empty."""
        left = [p for t in reversed(self.tiers) for p in self.queues[t]]
        longest, pieces, gap = self.tiers[-1], [], self.tiers[-1]
        for doc_id, start, ids, total in left:
            while ids:
                head, ids = ids[: gap * 4], ids[gap * 4 :]
                pieces.append((doc_id, start, head, total))
                start, gap = start + len(head) // 4, gap - len(head) // 4
                if not gap:
                    self.closed.append((longest, pieces))
                    pieces, gap = [], longest
        if pieces:
            self.closed.append((longest, pieces))


def _schema(extra=()) -> pa.Schema:
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.binary()]
    names = [f.split()[0] for f in PIECES.split(", ")]
    return pa.schema([*zip(names, kinds), *extra])


def _table(rows: list, extra=()) -> pa.RecordBatch:
    schema = _schema(extra)
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def pack(
    spark: SparkSession,
    docs: DataFrame,
    tokenizer: str | None = None,
    tiers: tuple[int, ...] = TIERS,
    end_id: int = 2,
    pool: int = 1 << 20,
    step_tokens: int = 1 << 16,
    merge: int = 256,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece (``PIECES``): where its ids lie in the document and in the sequence.

    ``tiers`` are powers of two, ``pool`` bounds the ids that a task holds, ``with_ids``
    adds the ids themselves, ready to be concatenated by sequence and offset.
    """
    shared = spark.sparkContext.broadcast(tokenizer_json(tokenizer))
    tail = end_id.to_bytes(4, "little")

    def first(batches):
        words = WordIds(shared.value)
        part = TaskContext.get().partitionId()
        packer = _Packer(part << 32, tiers, pool, step_tokens)
        extra = (pa.field("part", pa.int32()), pa.field("open", pa.bool_()))
        for batch in sliced(batches, 1 << 22):
            starts, ids = words.batch(texts_of(batch))
            for row, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                own = ids[starts[row] : starts[row + 1]].tobytes() + tail
                packer.add(doc_id, 0, own, len(own) // 4)
            if packer.held >= pool:
                packer.pack(pool // 4)
            yield _table([(*r, part, False) for r in packer.rows(with_ids)], extra)
        packer.pack(0)
        yield _table([(*r, part, False) for r in packer.rows(with_ids)], extra)
        waiting = [p for queue in packer.queues.values() for p in queue]
        yield _table(
            [(d, s, len(i) // 4, None, n, None, None, None, None, i, part, True) for d, s, i, n in waiting], extra
        )
        del words, packer, waiting
        give_back()  # an idle worker would hold the vocabulary and its cache beside those of the busy ones

    def second(table: pa.Table) -> pa.Table:
        base = (1 << 62) + (table.column("bundle")[0].as_py() << 32)
        packer = _Packer(base, tiers, pool, step_tokens)
        table = table.sort_by([("part", "ascending"), ("doc_id", "ascending"), ("start", "ascending"), ("length", "ascending")])
        for row in table.select(["doc_id", "start", "ids", "doc_tokens"]).to_pylist():
            packer.add(row["doc_id"], row["start"], row["ids"], row["doc_tokens"])
        packer.pack(0)
        packer.finish()
        return pa.Table.from_batches([_table(list(packer.rows(with_ids)))])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    done = written(rows.mapInArrow(first, PIECES + ", part int, open boolean"), "pack")
    left = done.where("open").withColumn("bundle", F.floor(F.col("part") / merge).cast("long"))
    return done.where("not open").drop("part", "open").union(left.groupBy("bundle").applyInArrow(second, PIECES))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 4096 ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = pack(spark, docs).withColumn("ids_crc32", F.crc32("ids"))  # of what a reader gets
    return pieces.select(*[c.split()[0] for c in PIECES.split(", ")][:-1])
