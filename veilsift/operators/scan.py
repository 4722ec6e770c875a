"""Text units in, findings out (X2, X3), and redaction (M6-M8)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import (
    inside,
    let,
    no_spans,
    pieces,
    record,
    resolve,
    splice,
    unmarked,
)
from .classify import category_of, risk_of
from .detector import HAS_DIGIT, Detector
from .registry import in_order, redaction_detectors

#: Columns of a text unit: where a text comes from, and the text.
UNIT_COLUMNS = ("source_type", "source", "line", "column_name", "row", "row_id", "text")
#: Columns of a finding, in report order.
FINDING_COLUMNS = (
    "source_type",
    "source",
    "data_type",
    "subtype",
    "category",
    "risk",
    "line",
    "offset",
    "column_name",
    "row",
    "row_id",
    "masked_value",
)


def candidates(text: Column, detectors: Sequence[Detector]) -> Column:
    """What the detectors accept, one after the other by priority, overlaps and all."""
    return F.concat(no_spans(), *[d.spans(text) for d in in_order(detectors)])


def matches(text: Column, detectors: Sequence[Detector]) -> Column:
    """Resolved matches of one text, ordered by position."""
    return let(candidates(text, detectors), resolve)


def any_hint(text: Column, detectors: Sequence[Detector]) -> Column:
    """A cheap condition without which no detector can match.

    One regex tries the shapes of all detectors at each digit or plus sign; hints that
    need a digit come last and are tried only where there is one.
    """
    hit, digit_hit = F.lit(False), F.lit(False)
    shapes = [d.shape for d in detectors if d.shape]
    for detector in detectors:
        hit = hit | detector.hint(text) if detector.hint else hit
        digit_hit = digit_hit | detector.digit_hint(text) if detector.digit_hint else digit_hit
    if shapes:
        hit = hit | text.rlike(rf"(?U)(?=[\d+])(?:{'|'.join(shapes)})")
    return hit | (text.rlike(HAS_DIGIT) & digit_hit)


def mask_of(match: Column, detectors: Sequence[Detector]) -> Column:
    """The mask chosen by the detector that made the match."""
    shown = F.lit(None).cast("string")
    for d in detectors:
        masked = d.mask(match["value"], match["subtype"])
        shown = F.when(match["data_type"] == d.name, masked).otherwise(shown)
    return shown


def as_units(df: DataFrame, **columns: Column | str | int | None) -> DataFrame:
    """Shape a DataFrame as text units; what is not named becomes null."""
    types = {"line": "int", "row": "bigint"}

    def value(name: str) -> Column:
        given = columns.get(name)
        column = given if isinstance(given, Column) else F.lit(given)
        return column.cast(types.get(name, "string")).alias(name)

    return df.select(*[value(name) for name in UNIT_COLUMNS])


def _cuttable(detectors: Sequence[Detector]) -> bool:
    return bool(detectors) and all(d.cuttable for d in detectors)


def _piece_rows(units: DataFrame, detectors: Sequence[Detector], passed: Sequence[str]) -> DataFrame:
    """One row per piece of a unit; units up to the piece size stay whole."""
    text = unmarked(F.col("text"))
    if _cuttable(detectors):
        cut = pieces(text, max(d.margin for d in detectors))
        return units.select(*passed, F.posexplode_outer(cut).alias("piece_no", "piece"))
    whole = record(base=F.lit(0), lead=F.lit(0), body_len=F.length(text), text=text)
    return units.select(*passed, F.lit(0).alias("piece_no"), whole.alias("piece"))


def scan_rows(
    units: DataFrame,
    detectors: Sequence[Detector],
    overrides: Mapping[str, str] | None = None,
    carry: str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Findings of ``units``, one narrow pass and no shuffle; columns in ``keep`` stay on every row.

    ``carry`` names a struct column (per-file counters) that is null on most units:
    where it is set it comes out exactly once, on a finding of that unit or on a row
    of its own with a null ``data_type``.  So one read of the source gives both the
    findings and the statistics.
    """
    detectors = in_order(detectors)
    # cheap conditions first: most units hold no candidate at all
    worth = _kept("hint", "text", detectors)
    if carry:
        worth = F.coalesce(worth, F.lit(False)) | F.col(carry).isNotNull()
    passed = [c for c in UNIT_COLUMNS if c != "text"] + list(keep) + ([carry] if carry else [])
    cut = _piece_rows(units.where(worth), detectors, passed)
    # one step per column: what is a lambda stays small, the rest is compiled
    found = _kept("candidates", "piece.text", detectors).alias("found")
    resolved = (
        cut.select(*passed, "piece_no", "piece", found)
        .withColumn("found", resolve(F.col("found")))
        .withColumn("found", inside(F.col("piece"), F.col("found")))
    )
    # posexplode_outer and a null test: a plain explode would repeat the regex work
    # in the size() filter the optimizer adds below it
    rows = resolved.select(*passed, "piece_no", F.posexplode_outer("found").alias("match_no", "m"))
    first = (F.coalesce("piece_no", F.lit(0)) == 0) & (F.coalesce("match_no", F.lit(0)) == 0)
    wanted = F.col("m").isNotNull()
    if carry:
        wanted = wanted | (first & F.col(carry).isNotNull())
    m = F.col("m")
    finding = {
        "data_type": m["data_type"],
        "subtype": m["subtype"],
        "category": F.when(m.isNotNull(), category_of(m["data_type"])),
        "risk": F.when(m.isNotNull(), risk_of(m["data_type"], m["subtype"], overrides)),
        "offset": m["start"] + 1,
        "masked_value": _kept("mask", "m", detectors),
    }
    columns = [finding[c].alias(c) if c in finding else F.col(c) for c in (*FINDING_COLUMNS, *keep)]
    if carry:
        columns.append(F.when(first, F.col(carry)).alias(carry))
    return rows.where(wanted).select(*columns)


def scan_units(
    units: DataFrame,
    detectors: Sequence[Detector],
    overrides: Mapping[str, str] | None = None,
) -> DataFrame:
    """Classified, masked findings of a batch or streaming DataFrame of units."""
    return scan_rows(units, detectors, overrides)


# ------------------------------------------------------------------ redaction


def redact(text: Column, detectors: Iterable[Detector] | None = None) -> Column:
    """The text with every match replaced by its mask; other text is untouched (M6).

    ``text`` should be a plain column: the expression refers to it many times.
    """
    chosen = in_order(redaction_detectors() if detectors is None else detectors)

    def masked(found: Column) -> Column:
        return F.transform(
            found, lambda m: record(start=m["start"], end=m["end"], masked=mask_of(m, chosen))
        )

    def body_of(piece: Column) -> Column:
        # matches in the margins belong to the neighbours
        at_body = record(
            base=-piece["lead"], lead=piece["lead"], body_len=piece["body_len"], text=piece["text"]
        )
        body = F.substring(piece["text"], piece["lead"] + 1, piece["body_len"])
        found = let(unmarked(piece["text"]), lambda clean: matches(clean, chosen))
        own = let(record(p=at_body, f=found), lambda b: inside(b["p"], b["f"]))
        return splice(body, masked(own))

    if _cuttable(chosen):
        cut = pieces(text, max(d.margin for d in chosen))
        changed = F.array_join(F.transform(cut, body_of), "")
    else:
        changed = splice(text, masked(matches(unmarked(text), chosen)))
    return F.when(any_hint(text, chosen), changed).otherwise(text)


@lru_cache(maxsize=64)
def _column_of(kind: str, name: str, detectors: tuple[Detector, ...], gateway: object) -> Column:
    """A detection expression over a named column.  It takes seconds to build through
    the gateway and is the same for every DataFrame, so it is kept."""
    build = {"candidates": candidates, "hint": any_hint, "redact": redact, "mask": mask_of}[kind]
    return build(F.col(name), detectors)


def _kept(kind: str, name: str, detectors: Sequence[Detector]) -> Column:
    return _column_of(kind, name, in_order(detectors), SparkContext._gateway)


def redacted(name: str, detectors: Iterable[Detector] | None = None) -> Column:
    """:func:`redact` of a named column."""
    return _kept("redact", name, redaction_detectors() if detectors is None else tuple(detectors))


def redact_table(df: DataFrame, columns: Iterable[str], detectors: Iterable[Detector] | None = None) -> DataFrame:
    """A copy of a table with the named columns redacted."""
    chosen = tuple(detectors) if detectors is not None else redaction_detectors()
    return df.withColumns({name: redacted(name, chosen) for name in columns})


def redact_logs(df: DataFrame, column: str, secrets: Iterable[str] = ()) -> DataFrame:
    """Log lines without known secrets of six or more characters (replaced
    literally, first) and without detected values; batch or streaming (M8)."""
    line = F.col(column)
    for secret in secrets:
        if len(secret) >= 6:
            line = F.replace(line, F.lit(secret), F.lit("[REDACTED]"))
    scrubbed = df.withColumn(column, line)
    return scrubbed.withColumn(column, redacted(column))
