"""Conversation structure repair (11): weighted interval parsing over the rows of a conversation.

A repaired conversation has role initials ``(s?(ua)+)?``.  The repair grammar is in Chomsky normal form:
a nonterminal A(p,q) derives what leads the pattern from place p to place q, with rules
A(p,q) -> A(p,r) A(r,q) and, for one row, Keep, Rerole, Delete.  A chart cell is a span of rows and holds
for each nonterminal the least (cost, audit); cells of single rows are closed under insertions on both
sides, so every gap is covered.  Cells are combined bottom-up by span length, 1, 2, 4, ...: as A(p,q)
may be split at any row, one split a span gives its minimum and only these spans need cells.  Minima
compose, because no audit of a cell begins with another one of the same cost.

That holds for parts of a conversation too: rows are dealt into sorted ranges, each range parses its own
part of a conversation, and cells of parts are combined over spans of parts.  So a conversation of any
length is parsed by many tasks; one value, its audit, grows with it.

Rows that are alike in conversation, turn, role and text are counted before they move; all but the first
are duplicates (or blank).  Null roles and texts are one space.  Rows are ordered by turn (null first),
role and text.  Rows without a conversation id are one conversation.  A role that is empty or begins
with another letter than s, u, a is never kept as it is.  Extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from veilsift.plans.ordinals import ranged

from .common import sliced, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANK = r"\A[\x20\x09-\x0D]*\z"
TRUNC = r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"

# ------------------------------------------------------------------- the chart

#: Places of the pattern: 0 nothing yet, 1 after s, 2 after u, 3 after a.  0 and 3 may end it.
PAIRS = ((0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3))
RULES = tuple(
    (head, PAIRS.index((p, r)), PAIRS.index((r, q)))
    for head, (p, q) in enumerate(PAIRS)
    for r in range(4)
    if (p, r) in PAIRS and (r, q) in PAIRS
)
_USER, _ASSISTANT = ((0, 2), (1, 2), (3, 2)), ((2, 3),)
_MOVES = {"s": ((0, 1),), "u": _USER, "a": _ASSISTANT}
Cell = tuple  # for each of PAIRS (cost, audit) or None
_BLOCK = 32


def joined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out: list = [None] * len(PAIRS)
    for head, a, b in RULES:
        x, y = left[a], right[b]
        if x is None or y is None:
            continue
        best = out[head]
        cost = x[0] + y[0]
        if best is None or cost < best[0]:
            out[head] = (cost, x[1] + y[1])
        elif cost == best[0]:
            audit = x[1] + y[1]
            if audit < best[1]:
                out[head] = (cost, audit)
    return tuple(out)


def _cell(found: dict) -> Cell:
    return tuple(found.get(pair) for pair in PAIRS)


def _inserted() -> Cell:
    """The cell of no rows: insertions alone, closed."""
    none = _cell({(p, p): (0, "") for p in range(4)})
    one = _cell({pair: (INSERT, "I") for pair in (*_USER, *_ASSISTANT)} | {(p, p): (0, "") for p in range(4)})
    now = joined(none, one)
    while (after := joined(now, one)) != now:
        now = after
    return now


_NONE = _inserted()
#: Codes of rows: 3 * initial + fault; initials s, u, a, other; faults sound, truncated, to be deleted.
INITIALS = "sua"
SOUND, CUT, LOST = range(3)


@lru_cache(maxsize=None)
def _leaf(code: int) -> Cell:
    """The cell of one row, closed under insertions.  A kept system row is ``L``: it tells the two
    places after a first row apart and stands where K would in any comparison."""
    initial, fault = divmod(code, 3)
    options = {(p, p): [(DELETE, "D")] for p in range(4)}
    if fault != LOST:
        extra = TRUNCATED if fault == CUT else 0
        for pair in _USER + _ASSISTANT:
            options.setdefault(pair, []).append((REROLE + extra, "R"))
        for pair in _MOVES[INITIALS[initial]] if initial < 3 else ():
            options.setdefault(pair, []).append((KEEP + extra, "L" if initial == 0 else "K"))
    return joined(joined(_NONE, _cell({pair: min(o) for pair, o in options.items()})), _NONE)


def bottom_up(cells: list[Cell]) -> Cell:
    """The cell of neighbouring spans, span lengths doubling."""
    while len(cells) > 1:
        cells = [joined(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else _NONE


@lru_cache(maxsize=1 << 12)
def _block(codes: bytes) -> Cell:
    return bottom_up([_leaf(c) for c in codes])


def chart(codes: bytes) -> Cell:
    """The cell of consecutive rows; short runs of equal codes are parsed once."""
    return bottom_up([_block(codes[i : i + _BLOCK]) for i in range(0, len(codes), _BLOCK)])


def cheapest(cell: Cell) -> tuple[int, str]:
    """(cost, audit) of a whole conversation, system rows kept as L."""
    return min(c for pair, c in zip(PAIRS, cell) if c is not None and pair in ((0, 0), (0, 3)))


# ------------------------------------------------------------------ the damage


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage that crc32(conv_id:turn) % 20 chooses."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.crc32(key) % 20).alias("how"),
    ).where("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("how") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_")).drop("_")


# ------------------------------------------------------------------ the repair


@dataclass(frozen=True)
class Repaired:
    """``summary``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, one row a conversation.
    ``turns``: conv_id, part, at (in this order), role, text, edit of the rows that stay or are inserted."""

    summary: DataFrame
    turns: DataFrame


def _units(rows: DataFrame) -> DataFrame:
    """Rows counted, ordered, with their faults: ``part, place`` follow the order of a conversation."""
    space = F.lit(" ")
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    units = written(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")), "repair-rows")
    # the first turn of a role and text: one row each, so that no key meets many rows
    digest = F.sha2("text", 256)
    rank = F.struct(F.col("turn").isNotNull().alias("later"), "turn")
    first = units.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), digest.alias("d")).agg(F.min(rank).alias("f"))
    same = (
        F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (digest == F.col("d"))
        & F.col("turn").eqNullSafe(F.col("f.turn"))
    )
    units = units.join(first, same, "left")
    blank, cut = F.col("text").rlike(BLANK), F.col("text").rlike(TRUNC)
    fault = F.when(blank, "blank").when(F.col("f").isNull(), "duplicate").when(cut, "truncated").otherwise("none")
    units = units.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    return ranged(units, *order, bounds=(*order[:3], F.substring("text", 1, 64).asc()), name="repair-units")


def _segments(units: DataFrame) -> DataFrame:
    """One row for each conversation and part: its cell, and what is needed to join it to its neighbours."""
    kind = units.schema["conv_id"].dataType.simpleString()
    initial = F.substring("role", 1, 1)
    lost = F.col("fault").isin("blank", "duplicate")
    code = 3 * F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = code + F.when(lost, LOST).when(F.col("fault") == "truncated", CUT).otherwise(SOUND)
    rows = units.select("conv_id", "part", "place", "n", code.cast("int").alias("code"))
    rows = rows.repartition("part").sortWithinPartitions("part", "place")
    legal = {(0, 1), (1, 2), (2, 1)}

    def closed(conv, part: int, codes: list, counts: list) -> tuple:
        whole = b"".join(bytes([c]) + bytes([c - c % 3 + LOST]) * (n - 1) for c, n in zip(codes, counts))
        first, last = codes[0] // 3, codes[-1] // 3
        illegal = sum((a // 3, b // 3) not in legal for a, b in zip(codes, codes[1:])) + sum(counts) - len(counts)
        cells = [None if c is None else {"cost": c[0], "audit": c[1]} for c in chart(whole)]
        return conv, part, [{"part": part, "rows": len(whole)}], first, last, illegal, cells

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "part", "parts", "first", "last", "illegal", "cells"]
        key, codes, counts, out = None, [], [], []
        for batch in sliced(batches):
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "part", "code", "n")]
            for conv, part, c, n in zip(*columns):
                if key != (conv, part):
                    if key is not None:
                        out.append(closed(*key, codes, counts))
                    key, codes, counts = (conv, part), [], []
                codes.append(c)
                counts.append(n)
            if out:
                yield _batch(out, names, schema)
                out = []
        if key is not None:
            yield _batch([closed(*key, codes, counts)], names, schema)

    told = f"conv_id {kind}, part int, {_PART}"
    schema = _arrow(told)
    return rows.mapInArrow(parse, told)


_PART = (
    "parts array<struct<part:int,rows:long>>, first int, last int, illegal long, "
    "cells array<struct<cost:long,audit:string>>"
)


def _arrow(told: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(told))


def _batch(rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(names, zip(*rows))], names)


def _combined(segments: DataFrame, fan: int = 16) -> DataFrame:
    """One row for each conversation: parts are joined by spans of ``fan`` neighbours, in rounds."""
    segments = written(segments, "repair-cells")
    kind = segments.schema["conv_id"].dataType.simpleString()
    many = segments.groupBy(F.col("conv_id").alias("c")).count().where("count > 1")
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    open_ = written(segments.join(many, same, "left_semi"), "repair-spans")
    legal = {(0, 1), (1, 2), (2, 1)}

    def join(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("part").to_dict("records")
        cells = [tuple(None if c is None else (c["cost"], c["audit"]) for c in r["cells"]) for r in rows]
        illegal = sum(r["illegal"] for r in rows) + sum((a["last"], b["first"]) not in legal for a, b in zip(rows, rows[1:]))
        cell = [None if c is None else {"cost": c[0], "audit": c[1]} for c in bottom_up(cells)]
        parts = [p for r in rows for p in r["parts"]]
        told = (rows[0]["conv_id"], rows[0]["part"] // fan, parts, rows[0]["first"], rows[-1]["last"], illegal, cell)
        names = ["conv_id", "part", "parts", "first", "last", "illegal", "cells"]
        return pd.DataFrame([told], columns=names).astype({"conv_id": group["conv_id"].dtype})

    left = open_.agg(F.max("part")).first()[0]
    done = open_
    while left:
        span = F.floor(F.col("part") / fan).cast("int").alias("span")
        done = written(done.groupBy("conv_id", span).applyInPandas(join, f"conv_id {kind}, part int, {_PART}"), "repair-spans")
        left //= fan
    return segments.join(many, same, "left_anti").unionByName(done)


def _letters(whole: DataFrame) -> DataFrame:
    """Edits that leave a row: ``conv_id, part, nth, at, edit, role`` (``nth`` null: inserted, role null: as it is)."""
    kind = whole.schema["conv_id"].dataType.simpleString()
    told = f"conv_id {kind}, part int, nth long, at long, edit string, new_role string"
    schema = _arrow(told)
    step = 1 << 16

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            kept: list = []
            size = 0
            for conv, parts, audit in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "parts", "edits"))):
                letters = np.frombuffer(audit.encode(), np.uint8)
                sizes = np.array([p["rows"] for p in parts], np.int64)
                ends = np.cumsum(sizes)
                numbers = np.array([p["part"] for p in parts], np.int64)
                before_rows, before_out, system = 0, 0, bool((letters[letters != 68][:1] == 76).any())
                for start in range(0, len(letters), step):
                    own = letters[start : start + step]
                    is_row, is_out = own != 73, own != 68
                    row = before_rows + np.cumsum(is_row) - 1
                    out = before_out + np.cumsum(is_out) - 1
                    before_rows, before_out = before_rows + int(is_row.sum()), before_out + int(is_out.sum())
                    where = np.searchsorted(ends, np.maximum(row, 0), side="right").clip(max=len(ends) - 1)
                    nth = row - (ends - sizes)[where]
                    user = (out - system) % 2 == 0
                    free = (own == 82) | (own == 73)  # R, I
                    stays = np.nonzero(is_out)[0]
                    role = np.where(free, np.where(user, "user", "assistant"), None)
                    kept.append(
                        pa.RecordBatch.from_arrays(
                            [
                                pa.array([conv] * len(stays), schema.field("conv_id").type),
                                pa.array(numbers[where[stays]], pa.int32()),
                                pa.array(nth[stays], mask=~is_row[stays]),
                                pa.array(start + stays),
                                pa.array([{75: "K", 76: "K", 82: "R", 73: "I"}[x] for x in own[stays].tolist()], pa.string()),
                                pa.array(role[stays], pa.string()),
                            ],
                            schema.names,
                        )
                    )
                    size += len(stays)
                    if size >= step:
                        yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
                        kept, size = [], 0
            if kept:
                yield from pa.Table.from_batches(kept).combine_chunks().to_batches()

    return whole.select("conv_id", "parts", "edits").mapInArrow(spell, told)


def repair(conversations: DataFrame) -> Repaired:
    """The cheapest repair of every conversation of ``conv_id, turn, role, text``."""
    units = _units(conversations)
    whole = _combined(_segments(units))
    kind = whole.schema["conv_id"].dataType.simpleString()
    told = f"conv_id {kind}, parts array<struct<part:int,rows:long>>, illegal long, cost long, edits string"
    schema = _arrow(told)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            cells = batch.column("cells").to_pylist()
            best = [cheapest(tuple(None if c is None else (c["cost"], c["audit"]) for c in own)) for own in cells]
            costs, audits = [b[0] for b in best], [b[1] for b in best]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv_id", "parts", "illegal")), pa.array(costs), pa.array(audits)], schema.names
            )

    chosen = written(whole.mapInArrow(choose, told), "repair-audits")

    def counted(fault: str, first: Column, later: Column) -> Column:
        return F.sum(F.when(F.col("fault") == fault, first).otherwise(later)).cast("long").alias(fault)

    n, zero, one = F.col("n"), F.lit(0), F.lit(1)
    # copies of a row are duplicates of it unless they are blank
    again = F.when(F.col("fault") == "blank", 0).otherwise(n - 1)
    turns = units.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), zero).cast("long").alias("gaps"),
        counted("blank", n, zero), counted("duplicate", n, again), counted("truncated", one, zero),
    )
    turns = turns.withColumnRenamed("conv_id", "c")
    summary = chosen.join(turns, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.translate("edits", "L", "K").alias("audit")
    )
    return Repaired(summary, _applied(units, _letters(chosen)))


def _applied(units: DataFrame, letters: DataFrame) -> DataFrame:
    """The rows that the edits leave."""
    before = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    first = F.min("total").over(Window.partitionBy("part", "conv_id"))
    rows = units.select("part", "conv_id", "place", "role", "text", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("total"))
    rows = rows.select(
        F.col("part").alias("p"), F.col("conv_id").alias("c"), (F.col("total") - first).cast("long").alias("row"), "role", "text"
    )
    same = (F.col("part") == F.col("p")) & (F.col("nth") == F.col("row")) & F.col("conv_id").eqNullSafe(F.col("c"))
    # an edit is many rows for few bytes of its audit: Spark would take them for a small side and broadcast them
    met = letters.hint("merge").join(rows, same, "left")
    # inserted rows meet none
    return met.select("conv_id", "part", "at", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of the turns as ``role:text`` lines; rows stream through the digest."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    line = F.concat("role", F.lit(":"), "text").alias("line")
    rows = turns.select("conv_id", "at", line).repartition("conv_id").sortWithinPartitions("conv_id", "at")
    told = f"conv_id {kind}, repaired_sha256 string"
    schema = _arrow(told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out, any_row = None, None, [], False
        for batch in sliced(batches):
            for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
                if not any_row or conv != now:
                    if any_row:
                        out.append((now, state.hexdigest()))
                    now, state, any_row = conv, hashlib.sha256(text.encode()), True
                else:
                    state.update(b"\n" + text.encode())
            if out:
                yield _batch(out, schema.names, schema)
                out = []
        if any_row:
            yield _batch([(now, state.hexdigest())], schema.names, schema)

    return rows.mapInArrow(run, told)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged and repaired."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    done = repair(damaged(given))
    every = given.select("conv_id").distinct()
    summary = done.summary.withColumnRenamed("conv_id", "c")
    hashes = digests(done.turns).withColumnRenamed("conv_id", "h")
    rows = every.join(summary, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    rows = rows.join(hashes, F.col("conv_id").eqNullSafe(F.col("h")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = F.lit(hashlib.sha256().hexdigest())
    return rows.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256")
    )


# --------------------------------------------------------------------- the SQL

_CRC = """xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
      lambda c: CAST(ord(c) AS BIGINT)),
    lambda crc, b: list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(crc, b)),
    CAST(4294967295 AS BIGINT)), 4294967295)"""

#: The same by a walk over the rows of a conversation from left to right.
SQL = rf"""
WITH RECURSIVE hurt AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS how FROM conversations),
damage AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN how = 1 THEN '' WHEN how = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN how = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hurt WHERE how <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damage),
flawed AS MATERIALIZED (
  SELECT *, substr(role, 1, 1) AS c,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
         WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
         WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault,
    lead(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS next
  FROM placed),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (next IS NOT NULL AND c || next NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM flawed GROUP BY conv_id),
moves(p, q, c) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')),
gap(p, q, w, t) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (1, 2, 3, 'I'), (3, 2, 3, 'I'),
  (2, 3, 3, 'I'), (0, 3, 6, 'II'), (1, 3, 6, 'II')),
walk(conv_id, i, s, best) AS (
  SELECT conv_id, CAST(0 AS BIGINT), q, {{'w': CAST(w AS BIGINT), 't': t}} FROM stats, gap WHERE p = 0
  UNION ALL
  SELECT conv_id, i, q, min(best) FROM (
    SELECT e.conv_id, e.i, g.q, {{'w': CAST(e.w + g.w AS BIGINT), 't': e.t || g.t}} AS best FROM (
      SELECT w.conv_id, w.i + 1 AS i, w.s AS s, w.best.w + 4 AS w, w.best.t || 'D' AS t FROM walk w
        JOIN stats d ON w.conv_id IS NOT DISTINCT FROM d.conv_id AND w.i < d.n
      UNION ALL
      SELECT w.conv_id, f.i, m.q, w.best.w + CASE WHEN how.t = 'R' THEN 3 ELSE 0 END + CASE WHEN f.fault = 'truncated' THEN 3 ELSE 0 END, w.best.t || how.t
      FROM walk w JOIN flawed f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1 AND f.fault NOT IN ('blank', 'duplicate')
        JOIN moves m ON m.p = w.s JOIN (VALUES ('K'), ('R')) how(t) ON (how.t = 'K' AND m.c = f.c) OR (how.t = 'R' AND m.c <> 's')
      ) e JOIN gap g ON g.p = e.s)
  GROUP BY conv_id, i, q),
chosen AS (
  SELECT w.conv_id, min(best) AS best FROM walk w JOIN stats d ON w.conv_id IS NOT DISTINCT FROM d.conv_id AND w.i = d.n
  WHERE s IN (0, 3) GROUP BY w.conv_id),
spelled AS (
  SELECT conv_id, k, substr(best.t, k, 1) AS edit FROM (SELECT *, unnest(range(1, length(best.t) + 1)) AS k FROM chosen)),
counted AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS i,
    count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY k) AS o FROM spelled),
known AS (
  SELECT t.*, f.role AS own, f.text, first_value(t.edit = 'K' AND f.c = 's') OVER (PARTITION BY t.conv_id ORDER BY t.edit = 'D', t.k) AS system
  FROM counted t LEFT JOIN flawed f ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.i = f.i AND t.edit <> 'I'),
mended AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN own WHEN (o - CASE WHEN system THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || coalesce(text, ''), chr(10) ORDER BY k)) AS h
  FROM known WHERE edit <> 'D' GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.w, 0) AS cost, coalesce(best.t, '') AS audit,
  coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN stats s ON e.conv_id IS NOT DISTINCT FROM s.conv_id
LEFT JOIN chosen c ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN mended m ON e.conv_id IS NOT DISTINCT FROM m.conv_id"""
