"""Masks: what a report may show of a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .checks import digits_of
from .spans import let

_ALNUM = r"[\p{L}\p{N}]"
_OTHER = r"[^\p{L}\p{N}]"

# Fixed value: what stands for a PEM header.
PEM_MASK = "-----BEGIN PRIVATE KEY----- [redacted]"


def mask_keep_last(value: Column, keep: int = 4) -> Column:
    """Star every letter and digit but the last ``keep``; separators stay (M3)."""
    behind = f"(?=(?:{_OTHER}*{_ALNUM}){{{max(keep, 0)}}})"
    return F.regexp_replace(value, f"(?U){_ALNUM}{behind}", "*")


def mask_card(value: Column) -> Column:
    """Only the last four digits, in the blocks cards are printed in (M1)."""

    def build(d: Column) -> Column:
        last = F.substring(d, F.length(d) - 3, F.lit(4))
        hidden = F.length(d) - 4
        blocks = F.concat_ws(
            " ",
            F.rtrim(F.repeat(F.lit("**** "), (hidden / 4).cast("int"))),
            F.when(hidden % 4 > 0, F.repeat(F.lit("*"), (hidden % 4).cast("int"))),
            last,
        )
        return (
            F.when(F.length(d) == 15, F.concat(F.lit("**** ****** *"), last))
            .when(F.length(d) == 14, F.concat(F.lit("**** ****** "), last))
            .when(F.length(d) > 7, blocks)
            .otherwise(F.concat_ws(" ", F.when(hidden > 0, F.repeat(F.lit("*"), hidden)), last))
        )

    return let(digits_of(value), build)


def mask_email(value: Column) -> Column:
    """First character, two to six stars, the domain (M2)."""
    local_len = F.length(value) - F.length(F.substring_index(value, "@", -1)) - 1
    stars = F.least(F.greatest(local_len - 1, F.lit(2)), F.lit(6))
    shown = F.concat(
        F.substring(value, 1, 1),
        F.repeat(F.lit("*"), stars.cast("int")),
        F.lit("@"),
        F.substring_index(value, "@", -1),
    )
    return F.when(local_len > 0, shown).otherwise(F.repeat(F.lit("*"), F.length(value)))


def mask_key(value: Column, subtype: Column, generic: str) -> Column:
    """Four characters of a provider key, two of any other secret (M4)."""
    shown = F.when(subtype == generic, F.lit(2)).otherwise(F.lit(4))
    return F.when(subtype == "private_key", F.lit(PEM_MASK)).otherwise(
        F.concat(F.substring(value, F.lit(1), shown), F.lit("********"))
    )


def mask_ip(value: Column) -> Column:
    """Half of an IPv4 address, at most two groups of an IPv6 address (M5)."""
    v4 = F.concat(F.substring_index(value, ".", 2), F.lit(".*.*"))
    head = F.slice(
        F.filter(F.split(F.substring_index(value, "::", 1), ":"), lambda g: g != ""), 1, 2
    )
    v6 = let(
        head,
        lambda h: F.concat(
            F.when(F.size(h) > 0, F.array_join(h, ":")).otherwise(F.lit(":")), F.lit(":****")
        ),
    )
    return F.when(F.contains(value, F.lit(":")), v6).otherwise(v4)
