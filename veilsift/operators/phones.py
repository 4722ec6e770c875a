"""Phone numbers in international, North American and Russian layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.checks import digits_of
from ..functions.masks import mask_keep_last
from ..functions.spans import find_spans, keep, let
from .detector import Detector

NAME = "phone"

# Fixed value: the three layouts.
PHONE = (
    r"(?U)(?=[\d+(])(?<![\w+])(?:"
    r"\+\d{1,3}[\s.-]?\(?\d{1,4}\)?(?:[\s.-]?\d{2,4}){2,4}"
    r"|(?:\+?1[\s.-]?)?\(?[2-9]\d{2}\)?[\s.-]\d{3}[\s.-]\d{4}"
    r"|8[\s-]?\(\d{3}\)[\s-]?\d{3}[\s-]?\d{2}[\s-]?\d{2}"
    r")(?![\w-])"
)


def is_phone(value: Column) -> Column:
    """8 to 15 digits, more than two of them different."""
    return let(
        digits_of(value),
        lambda d: F.length(d).between(8, 15) & (F.size(F.array_distinct(F.split(d, ""))) > 2),
    )


def phone_detector() -> Detector:
    return Detector(
        NAME,
        70,
        lambda text: keep(find_spans(text, PHONE, NAME), is_phone),
        lambda value, subtype: mask_keep_last(value, 4),
        shape=r"\+\d|[2-9]\d{2}\)?[\s.-]\d{3}[\s.-]\d{4}|8[\s-]?\(\d",
        cuttable=True,
    )
