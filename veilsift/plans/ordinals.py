"""Row numbers in a global order, by distributed prefix sums.

Rows are dealt into ranges of the order and sorted there; one pass writes them with the number of their
range and their place in it.  The counts of the ranges become offsets through sums over dyadic blocks of
ranges, so no task sees all ranges and no offset travels in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

_PLACES = 33  # bits of the place in monotonically_increasing_id
_LEVELS = 31


def part_of(at: Column | str) -> Column:
    """The partition in a ``monotonically_increasing_id``."""
    return F.shiftright(at, _PLACES).cast("int")


def place_of(at: Column) -> Column:
    """The place within it, from 0."""
    return at.bitwiseAND(F.lit((1 << _PLACES) - 1))


def ranged(
    df: DataFrame,
    *order: Column | str,
    bounds: tuple[Column | str, ...] = (),
    keep: tuple[str, ...] | None = None,
    name: str = "ranged",
) -> DataFrame:
    """``df`` as a written table with ``part`` and ``place``: (part, place) follows ``order``.

    ``bounds`` (``order`` if not given) must rise with the order; rows equal in them share a part.
    Of the columns only ``keep`` (all, if not given) are written.
    """
    kept = list(df.columns if keep is None else keep)
    rows = df.repartitionByRange(*(bounds or order)).sortWithinPartitions(*order)
    rows = written(rows.select(*kept, F.monotonically_increasing_id().alias("place")), name)
    return rows.select(*kept, part_of("place").alias("part"), place_of(F.col("place")).alias("place"))


def offsets(counts: DataFrame) -> DataFrame:
    """``part, before``: sum of ``n`` of all smaller parts, from ``counts (part, n)`` with distinct parts from 0 on.

    Every part adds its count to the block that holds it at each level; the parts before
    part p are one block for each bit that is set in p.
    """
    levels = F.sequence(F.lit(0), F.lit(_LEVELS - 1))
    at = counts.select("n", F.col("part").cast("long").alias("part"), F.explode(levels).alias("level"))
    blocks = at.groupBy("level", F.expr("shiftright(part, level)").alias("block")).agg(F.sum("n").alias("n"))
    needs = at.where("shiftright(part, level) & 1 = 1").select("part", "level", F.expr("shiftright(part, level) - 1").alias("block"))
    before = needs.join(blocks, ["level", "block"]).groupBy("part").agg(F.sum("n").alias("before"))
    own = counts.select(F.col("part").cast("long").alias("part"))
    before = own.join(before, "part", "left")
    return before.select(F.col("part").cast("int").alias("part"), F.coalesce("before", F.lit(0).cast("long")).alias("before"))


def numbered(
    df: DataFrame,
    *order: Column | str,
    number: str = "number",
    keep: tuple[str, ...] | None = None,
    most_broadcast: int = 1_000_000,
) -> DataFrame:
    """``df``, or its columns ``keep``, with the row number from 1 in ``order``."""
    rows = ranged(df, *order, keep=keep)
    counts = rows.groupBy("part").agg((F.max("place") + 1).alias("n"))
    names = [c for c in rows.columns if c not in ("part", "place")]
    return with_offsets(rows, counts, most_broadcast).select(*names, (F.col("before") + F.col("place") + 1).alias(number))


def with_offsets(rows: DataFrame, counts: DataFrame, most_broadcast: int = 1_000_000) -> DataFrame:
    """``rows (part, ...)`` with ``before``, the rows of all smaller parts; offsets are a row a part and
    are broadcast while at most ``most_broadcast``."""
    start = written(offsets(counts), "offsets")
    return rows.join(F.broadcast(start) if start.count() <= most_broadcast else start, "part")
