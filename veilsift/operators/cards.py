"""Payment cards: printed grouping, scheme prefix and length, Luhn."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.checks import luhn_ok
from ..functions.masks import mask_card
from ..functions.spans import find_spans, let, no_spans, record, span
from .detector import Detector

NAME = "credit_card"

# Scheme -> digits of a card, first match wins.
SCHEMES = {
    "visa": r"4\d{15}(?:\d{3})?",
    "mastercard": r"(?:5[1-5]\d{2}|222[1-9]|22[3-9]\d|2[3-6]\d{2}|27[01]\d|2720)\d{12}",
    "amex": r"3[47]\d{13}",
    "discover": r"(?:6011|65\d{2}|64[4-9]\d)\d{12}",
    "diners": r"3(?:0[0-5]|[689]\d)\d{11}",
    "jcb": r"35(?:2[89]|[3-8]\d)\d{12}(?:\d{1,3})?",
    "unionpay": r"62\d{14,17}",
    "maestro": r"(?:5018|5020|5038|5893|6304|6759|676[1-3])\d{8,15}",
    "mir": r"220[0-4]\d{12}(?:\d{1,3})?",
}
SHORTEST, LONGEST = 13, 19

# Groups of one or two digits, or touching an ASCII letter, can be part of no card;
# what is left are chains of groups joined by one space or dash.  The possessive
# quantifiers keep the regex engine from recursing on long chains.
_GROUP = r"\d{3,}+(?![A-Za-z])"
# the first lookahead is cheap: one long group, or two groups with a separator
_CHAIN = rf"(?U)(?=\d{{{SHORTEST}}}|\d{{3,12}}[ -]\d{{3}})(?<![A-Za-z\d]){_GROUP}(?:[ -]{_GROUP})*+"
_ENOUGH_DIGITS = rf"(?U)\d(?:[ -]?+\d){{{SHORTEST - 1}}}"


def card_scheme(digits: Column) -> Column:
    """Name of the first scheme whose prefix and length fit, else null."""
    named = F.lit(None).cast("string")
    for name, rule in reversed(SCHEMES.items()):
        named = F.when(digits.rlike(rf"^(?:{rule})\z"), F.lit(name)).otherwise(named)
    return named


def _plausible(groups: Column) -> Column:
    """One block, or blocks of at least four digits with at least three in the last."""
    n = F.size(groups)
    return (n == 1) | (
        F.forall(F.slice(groups, F.lit(1), n - 1), lambda g: F.length(g) >= 4)
        & (F.length(F.element_at(groups, -1)) >= 3)
    )


def is_card(digits: Column) -> Column:
    """Known scheme and valid check digit."""
    return (
        F.length(digits).between(SHORTEST, LONGEST)
        & digits.rlike("^(?:" + "|".join(SCHEMES.values()) + r")\z")
        & luhn_ok(digits)
    )


def _cards_in_chain(chain: Column) -> Column:
    """Cards of one chain, left to right, each from its first group to the nearest
    group that completes a card; the search goes on after it."""

    def search(groups: Column) -> Column:
        n = F.size(groups)

        def shortest_from(i: Column) -> Column:
            # 19 digits in blocks of four span at most five groups
            widths = F.sequence(F.lit(1), F.least(F.lit(5), n - i))
            fits = F.filter(
                widths,
                lambda w: let(F.array_join(F.slice(groups, i + 1, w), ""), is_card)
                & _plausible(F.slice(groups, i + 1, w)),
            )
            return F.coalesce(F.get(fits, F.lit(0)), F.lit(0))

        init = record(pos=F.lit(0), free=F.lit(0), out=no_spans())

        def step(acc: Column, i: Column) -> Column:
            after = acc["pos"] + F.length(F.get(groups, i)) + 1

            def advance(w: Column) -> Column:
                block = F.slice(groups, i + 1, w)
                width = F.aggregate(block, F.lit(0), lambda s, g: s + F.length(g)) + w - 1
                begin = chain["start"] + acc["pos"]
                value = F.substring(chain["value"], acc["pos"] + 1, width)
                hit = span(NAME, begin, begin + width, value, card_scheme(F.array_join(block, "")))
                return record(
                    pos=after,
                    free=F.when(w > 0, i + w).otherwise(acc["free"]),
                    out=F.when(w > 0, F.concat(acc["out"], F.array(hit))).otherwise(acc["out"]),
                )

            width_here = F.when(i >= acc["free"], shortest_from(i)).otherwise(F.lit(0))
            return let(width_here, advance)

        return F.aggregate(F.sequence(F.lit(0), n - 1), init, step, lambda acc: acc["out"])

    alone = F.when(
        is_card(chain["value"]),
        F.array(span(NAME, chain["start"], chain["end"], chain["value"], card_scheme(chain["value"]))),
    ).otherwise(no_spans())
    joined = let(F.split(F.translate(chain["value"], "-", " "), " "), search)
    return F.when(chain["value"].rlike("[ -]"), joined).otherwise(alone)


def card_spans(text: Column) -> Column:
    chains = F.filter(find_spans(text, _CHAIN, NAME), lambda c: F.length(c["value"]) >= SHORTEST)
    return F.when(
        text.rlike(_ENOUGH_DIGITS), F.flatten(F.transform(chains, _cards_in_chain))
    ).otherwise(no_spans())


def card_detector() -> Detector:
    return Detector(
        NAME,
        10,
        card_spans,
        lambda value, subtype: mask_card(value),
        shape=rf"\d(?:[ -]?+\d){{{SHORTEST - 1}}}",
        cuttable=True,
    )
