"""Checksums and structural tests as boolean Columns (usable as table filters)."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let


def digits_of(value: Column) -> Column:
    """Only the decimal digits of a string (A3)."""
    return F.regexp_replace(value, r"(?U)\D", "")


def luhn_ok(value: Column) -> Column:
    """Luhn mod 10; spaces and dashes ignored, ASCII digits only, two at least (A2)."""
    bare = F.regexp_replace(value, "[ -]", "")
    return bare.rlike("^[0-9]{2,}$") & F.call_function("luhn_check", bare)


@lru_cache(maxsize=1)
def _other_digits() -> tuple[str, str]:
    """All decimal digits outside ASCII, and the ASCII digits of the same values."""
    chars = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(chars), "".join(str(unicodedata.decimal(c)) for c in chars)


def ascii_digits(digits: Column) -> Column:
    """Decimal digits of any script as ASCII digits."""
    return F.when(digits.rlike("^[0-9]*$"), digits).otherwise(F.translate(digits, *_other_digits()))


def _digit(d: Column, at: int) -> Column:
    return F.substring(d, at, 1).try_cast("int")


def weighted_sum(d: Column, weights: Sequence[int]) -> Column:
    """Sum of digit times weight over the leading digits (A4)."""
    return sum((_digit(d, i + 1) * w for i, w in enumerate(weights)), F.lit(0))


def _on_digits(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.coalesce(let(ascii_digits(digits_of(value)), body), F.lit(False))


def ssn_ok(value: Column) -> Column:
    """Nine digits, area not 000, 666 or 9xx, group not 00, serial not 0000."""

    def test(d: Column) -> Column:
        area = F.substring(d, 1, 3).try_cast("int")
        group = F.substring(d, 4, 2).try_cast("int")
        serial = F.substring(d, 6, 4).try_cast("int")
        return (F.length(d) == 9) & (area != 0) & (area != 666) & (area < 900) & (group != 0) & (serial != 0)

    return _on_digits(value, test)


def sin_ok(value: Column) -> Column:
    return _on_digits(value, lambda d: d.rlike("^[^08]") & (F.length(d) == 9) & luhn_ok(d))


# The published check-digit weights.
INN10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_FIRST = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_SECOND = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
SNILS = (9, 8, 7, 6, 5, 4, 3, 2, 1)
PESEL = (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)
CPF_FIRST = (10, 9, 8, 7, 6, 5, 4, 3, 2)
CPF_SECOND = (11, 10, 9, 8, 7, 6, 5, 4, 3, 2)


def inn_ok(value: Column) -> Column:
    def check(d: Column, weights: Sequence[int]) -> Column:
        return weighted_sum(d, weights) % 11 % 10 == _digit(d, len(weights) + 1)

    return _on_digits(
        value,
        lambda d: ((F.length(d) == 10) & check(d, INN10))
        | ((F.length(d) == 12) & check(d, INN12_FIRST) & check(d, INN12_SECOND)),
    )


def snils_ok(value: Column) -> Column:
    def test(d: Column) -> Column:
        # totals of 100 and 101, and remainders of 100, all give 00
        wanted = weighted_sum(d, SNILS) % 101 % 100
        numbered = F.substring(d, 1, 9).try_cast("int") > 1001998
        return (F.length(d) == 11) & numbered & (wanted == F.substring(d, 10, 2).try_cast("int"))

    return _on_digits(value, test)


def pesel_ok(value: Column) -> Column:
    return _on_digits(
        value,
        lambda d: (F.length(d) == 11) & ((10 - weighted_sum(d, PESEL) % 10) % 10 == _digit(d, 11)),
    )


def cpf_ok(value: Column) -> Column:
    def test(d: Column) -> Column:
        mixed = ~d.rlike(r"^(.)\1*+$")
        first = weighted_sum(d, CPF_FIRST) * 10 % 11 % 10 == _digit(d, 10)
        second = weighted_sum(d, CPF_SECOND) * 10 % 11 % 10 == _digit(d, 11)
        return (F.length(d) == 11) & mixed & first & second

    return _on_digits(value, test)


#: Checks that a custom identifier pattern may name.
VALIDATORS: dict[str, Callable[[Column], Column]] = {
    "us_ssn": ssn_ok,
    "ca_sin": sin_ok,
    "ru_inn": inn_ok,
    "ru_snils": snils_ok,
    "pl_pesel": pesel_ok,
    "br_cpf": cpf_ok,
    "luhn": luhn_ok,
}


def entropy(value: Column) -> Column:
    """Shannon entropy in bits per character, 0.0 for an empty string (A1)."""

    def bits(acc: Column, c: Column) -> Column:
        share = (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / F.length(value)
        return acc - share * F.log2(share)

    chars = F.array_distinct(F.split(value, ""))
    total = F.aggregate(chars, F.lit(0.0), bits)
    return F.when(F.length(value) > 0, total).otherwise(F.lit(0.0))
