"""E-mail addresses with a known top-level domain."""

from __future__ import annotations

import os
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.masks import mask_email
from ..functions.spans import find_spans, let, no_spans, span
from .detector import Detector

NAME = "email"

# Labels are bounded for the JVM's regex engine: 254 characters hold at most 127.
_CANDIDATE = (
    r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@"
    r"(?:[A-Za-z0-9\-]{1,63}\.){1,127}[A-Za-z0-9\-]{2,63}"
)
_LABEL = r"^[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\z"
# labels of at most 63 characters that neither start nor end with a dash
_LABELS = r"^(?:(?!-)[A-Za-z0-9\-]{1,63}+(?<!-)(?:\.|\z)){1,128}+\z"
_LONGEST = 254

_TLD_FILE = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "data", "tlds.txt")


def read_tlds(path: str) -> frozenset[str]:
    """A published list, one domain per line, ``#`` for comments."""
    with open(path, encoding="utf-8") as lines:
        return frozenset(t.strip().lower() for t in lines if t.strip() and not t.startswith("#"))


@lru_cache(maxsize=1)
def default_tlds() -> frozenset[str]:
    """The dated list in ``data/tlds.txt``, in punycode (D19): the same with or without a session.

    Pass your own set (``read_tlds``) to pin another snapshot.
    """
    return read_tlds(_TLD_FILE)


def _known_tld(label: Column, tlds: Iterable[str]) -> Column:
    """Is a label in the list?  One literal per initial keeps the plan small and the
    search short; the plan holds no node per domain."""
    by_initial: dict[str, list[str]] = {}
    for tld in sorted({t.lower() for t in tlds}):
        if tld.replace("-", "").isalnum():
            by_initial.setdefault(tld[0], []).append(tld)
    lists = ", ".join(f"'{first}', ' {' '.join(names)} '" for first, names in by_initial.items()) or "'', ''"
    return let(
        F.lower(label),
        f"tld -> contains(coalesce(try_element_at(map({lists}), left(tld, 1)), ''), ' ' || tld || ' ')",
    )


def is_email(address: Column, tlds: Iterable[str] | None = None) -> Column:
    """Structure, lengths and top-level domain of a whole address."""
    known = default_tlds() if tlds is None else tlds
    local = F.regexp_extract(address, "^(.*)@[^@]*$", 1)
    labels = F.split(F.regexp_extract(address, "@([^@]*)$", 1), r"\.")
    return (
        (F.length(local) > 0)
        & (F.length(address) <= _LONGEST)
        & _local_ok(local)
        & (F.size(labels) >= 2)
        & F.forall(labels, _label_ok)
        & F.coalesce(_known_tld(F.element_at(labels, -1), known), F.lit(False))
    )


def _local_ok(local: Column) -> Column:
    return ~(F.startswith(local, F.lit(".")) | F.endswith(local, F.lit(".")) | F.contains(local, F.lit("..")))


def _label_ok(label: Column) -> Column:
    return (F.length(label) <= 63) & label.rlike(_LABEL)


def email_detector(ignore_domains: Iterable[str] = (), tlds: Iterable[str] | None = None) -> Detector:
    known = frozenset(default_tlds() if tlds is None else tlds)
    ignored = sorted({d.lower().lstrip("@") for d in ignore_domains})

    def longest_valid(candidate: Column) -> Column:
        """The candidate cut after the last label that makes it a valid address;
        null if there is none.  The scan itself goes on after the whole candidate."""
        local = F.substring_index(candidate["value"], "@", 1)

        def cut(labels: Column) -> Column:
            def ends_at(n: Column) -> Column:
                return (
                    _known_tld(F.get(labels, n - 1), known)
                    & F.array_join(F.slice(labels, F.lit(1), n), ".").rlike(_LABELS)
                    & (F.length(local) + 1 + F.length(F.array_join(F.slice(labels, F.lit(1), n), ".")) <= _LONGEST)
                )

            sizes = F.filter(F.sequence(F.size(labels), F.lit(2)), ends_at)
            return F.concat_ws("@", local, F.array_join(F.slice(labels, F.lit(1), F.get(sizes, F.lit(0))), "."))

        domain = F.substring_index(candidate["value"], "@", -1)
        # an address without a valid ending collapses to the bare local part
        valid = let(
            let(F.split(domain, r"\."), cut),
            lambda address: F.when(
                F.contains(address, F.lit("@")),
                span(NAME, candidate["start"], candidate["start"] + F.length(address), address),
            ),
        )
        return F.when(_local_ok(local), valid)

    def spans(text: Column) -> Column:
        found = F.filter(F.transform(find_spans(text, _CANDIDATE, NAME), longest_valid), lambda s: s.isNotNull())
        if ignored:
            found = F.filter(
                found, lambda s: ~F.lower(F.substring_index(s["value"], "@", -1)).isin(ignored)
            )
        return F.when(F.contains(text, F.lit("@")), found).otherwise(no_spans())

    return Detector(
        NAME,
        40,
        spans,
        lambda value, subtype: mask_email(value),
        hint=lambda text: F.contains(text, F.lit("@")) & text.rlike(_CANDIDATE),
        cuttable=True,
    )
