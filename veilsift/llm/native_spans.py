"""Spans of several kinds on a text column, by Catalyst expressions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilsift.functions.spans import find_spans, record

#: What an operator reports of a match: offsets are code points, the end is exclusive.
FOUND = "struct<start:int,rank:int,kind:string,end:int,value:string>"


def no_found() -> Column:
    return F.expr(f"cast(array() as array<{FOUND}>)")


def kind_spans(
    text: Column,
    kind: str,
    rank: int,
    pattern: str,
    gate: Column,
    test: Callable[[Column], Column] | None = None,
    opening: str | None = None,
) -> Column:
    """Leftmost non-overlapping matches of a Java regex whose value passes ``test``, where ``gate`` holds.

    A match may have a lead that is no part of the span: that begins at the first ``opening``.
    """
    spans = find_spans(text, pattern, kind)
    if opening is not None:
        lead = lambda s: F.instr(s["value"], opening) - 1
        spans = F.transform(
            spans, lambda s: record(start=s["start"] + lead(s), end=s["end"], value=F.substr(s["value"], lead(s) + 1))
        )
    if test is not None:
        spans = F.filter(spans, lambda s: test(s["value"]))
    named = F.transform(
        spans,
        lambda s: F.named_struct(
            F.lit("start"), s["start"], F.lit("rank"), F.lit(rank), F.lit("kind"), F.lit(kind),
            F.lit("end"), s["end"], F.lit("value"), s["value"],
        ),
    )
    return F.when(gate & text.rlike(pattern), named).otherwise(no_found())


def joined(found: Column) -> Column:
    """``kind:start:end`` of sorted spans, by commas."""
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
