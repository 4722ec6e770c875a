"""The detector interface: a name, a priority and three Column builders."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spans import SPAN, find_spans
from .safe_regex import without_recursion

#: Any decimal digit, of any script.
HAS_DIGIT = r"\p{Nd}"
#: Characters of context a built-in detector looks at around a match.
DEFAULT_MARGIN = 64


@dataclass(frozen=True)
class Detector:
    """Finds one kind of sensitive data.

    ``spans`` maps a text column to ``array<span>``, ``mask`` maps (value, subtype)
    to what may be shown.  On overlap the lower ``priority`` wins.  A unit is dropped
    before any span work unless one of three cheap tests holds: ``hint``, a condition
    of any kind; ``digit_hint``, tried only where there is a digit; ``shape``, a regex
    that starts at a digit or plus sign, so that one pass can try those of all
    detectors.  A test that is not given does not hold.
    ``cuttable`` says that no match crosses a barrier character and nothing beyond
    ``margin`` characters matters, so that very long units may be cut.
    """

    name: str
    priority: int
    spans: Callable[[Column], Column]
    mask: Callable[[Column, Column], Column]
    hint: Callable[[Column], Column] | None = None
    digit_hint: Callable[[Column], Column] | None = None
    shape: str | None = None
    any_of: Callable[[Column], Column] | None = None
    cuttable: bool = False
    margin: int = DEFAULT_MARGIN

    def any_in(self, texts: Column) -> Column:
        """Does any element of an array of texts hold a match?"""
        if self.any_of is not None:
            return self.any_of(texts)
        return F.exists(texts, lambda t: F.coalesce(F.size(self.spans(t)) > 0, F.lit(False)))


def not_empty(text: Column) -> Column:
    return F.length(text) > 0


def regex_detector(
    name: str,
    priority: int,
    pattern: str,
    mask: Callable[[Column, Column], Column],
    subtype: str | None = None,
) -> Detector:
    """A detector that is nothing but one Java regex."""
    return Detector(
        name, priority, lambda text: find_spans(text, pattern, name, subtype), mask, hint=lambda text: text.rlike(pattern)
    )


def python_detector(
    name: str,
    priority: int,
    find: Callable[[str], Iterable[tuple[int, int, str | None]]],
    mask: Callable[[Column, Column], Column],
) -> Detector:
    """A detector written in Python: ``find(text)`` yields (start, end, subtype).

    It runs as an Arrow-batched pandas UDF, for rules no expression can state.
    """
    spans_udf, any_udf = _python_spans(name, find)
    return Detector(name, priority, spans_udf, mask, hint=not_empty, any_of=any_udf)


def _python_spans(name, find):
    def found(text: str | None) -> list[dict]:
        if not text:
            return []
        return [
            {"start": a, "end": b, "value": text[a:b], "subtype": kind, "data_type": name}
            for a, b, kind in find(text)
        ]

    @F.pandas_udf(f"array<{SPAN}>")
    def spans_udf(texts: pd.Series) -> pd.Series:
        return texts.map(found)

    @F.pandas_udf("boolean")
    def any_udf(groups: pd.Series) -> pd.Series:
        return groups.map(lambda texts: texts is not None and any(found(t) for t in texts))

    return spans_udf, any_udf


# ------------------------------------------------------------ custom patterns

# A repeated group over user text recurses in the JVM's regex engine, and a few
# constructs mean something else there; such patterns are rewritten or run on Python's engine.
_OTHER_ENGINE = re.compile(r"\)(?:[*+]|\{\d*,?\d*\})|\(\?P|\(\?\(|\\Z|\\N|&&|\[\^?\[|[^\\]\[[^\]]*\[")


def runs_on_jvm(pattern: str) -> bool:
    """May this Python regex be handed to ``rlike`` with the same meaning?"""
    if _OTHER_ENGINE.search(pattern):
        return False
    try:
        import re._parser as parser

        if parser.parse(pattern).getwidth()[0] == 0:
            return False
    except (ImportError, AttributeError):
        return False
    jvm = SparkContext._jvm
    if jvm is None:
        return False
    try:
        jvm.java.util.regex.Pattern.compile(java_form(pattern))
    except Exception:  # the JVM rejects the syntax
        return False
    return True


def java_form(pattern: str) -> str:
    """Unicode classes and only ``\\n`` as a line end, as in Python."""
    return "(?Ud)" + pattern


def custom_spans(pattern: str, data_type: str, subtype: str) -> tuple[Callable[[Column], Column], bool]:
    """Spans of a user's Python regex, and whether they are a native expression."""
    re.compile(pattern)
    native = java_form(pattern) if runs_on_jvm(pattern) else None
    if native is None and (safe := without_recursion(pattern)) is not None:
        native = java_form(safe)
    if native is not None:
        return (lambda text: find_spans(text, native, data_type, subtype)), True

    def find(text: str):
        return ((m.start(), m.end(), subtype) for m in re.compile(pattern).finditer(text))

    return _python_spans(data_type, find)[0], False
