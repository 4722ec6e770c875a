"""Which detectors run: one record of options per built-in detector.

A record is a frozen dataclass whose fields are the detector's options; its
``detector()`` is the detector with these options.  ``CATALOGUE`` lists the records by
priority, so settings given as plain mappings (from a file, say) become typed values
before anything is built.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import lru_cache
from typing import Any, ClassVar

from .api_keys import api_key_detector
from .cards import card_detector
from .detector import Detector
from .emails import email_detector
from .ips import ip_detector
from .national_ids import national_id_detector
from .phones import phone_detector

Options = Mapping[str, Any]


@dataclass(frozen=True)
class CardOptions:
    name: ClassVar[str] = "credit_card"
    enabled: bool = True

    def detector(self) -> Detector:
        return card_detector()


@dataclass(frozen=True)
class NationalIdOptions:
    name: ClassVar[str] = "national_id"
    enabled: bool = True
    profiles: tuple = ("us_ssn",)
    custom_patterns: tuple = ()

    def detector(self) -> Detector:
        return national_id_detector(self.profiles, self.custom_patterns)


@dataclass(frozen=True)
class ApiKeyOptions:
    name: ClassVar[str] = "api_key"
    enabled: bool = True
    entropy_threshold: float = 4.0
    min_length: int = 20
    detect_generic: bool = True

    def detector(self) -> Detector:
        return api_key_detector(self.entropy_threshold, self.min_length, self.detect_generic)


@dataclass(frozen=True)
class EmailOptions:
    name: ClassVar[str] = "email"
    enabled: bool = True
    ignore_domains: tuple = ()
    tlds: frozenset | None = None

    def detector(self) -> Detector:
        return email_detector(self.ignore_domains, self.tlds)


@dataclass(frozen=True)
class PhoneOptions:
    name: ClassVar[str] = "phone"
    enabled: bool = False  # loose digits are too common for a default

    def detector(self) -> Detector:
        return phone_detector()


@dataclass(frozen=True)
class IpOptions:
    name: ClassVar[str] = "ip_address"
    enabled: bool = False
    ignore_private: bool = False

    def detector(self) -> Detector:
        return ip_detector(self.ignore_private)


#: The record of every built-in detector, by priority.
CATALOGUE = {r.name: r for r in (CardOptions, NationalIdOptions, ApiKeyOptions, EmailOptions, PhoneOptions, IpOptions)}
DETECTOR_NAMES = tuple(CATALOGUE)
_CASTS = {"bool": bool, "int": int, "float": float, "tuple": lambda v: tuple(v or ())}


def _typed(record: type, options: Options | None) -> Any:
    """The record with the options that it knows, each as its field's type."""
    given = options or {}
    values = {
        f.name: _CASTS.get(str(f.type), lambda v: v)(given[f.name]) for f in dataclasses.fields(record) if f.name in given
    }
    return record(**values)


@lru_cache(maxsize=256)
def _made(record: Any) -> Detector:
    """Equal options share one detector, and with it the expressions that are kept for it."""
    return record.detector()


def _detector(record: Any) -> Detector:
    try:
        return _made(record)
    except TypeError:  # options of a user's own that cannot be compared
        return record.detector()


def in_order(detectors: Iterable[Detector]) -> tuple[Detector, ...]:
    """Detectors by priority; a name may occur once."""
    by_name: dict[str, Detector] = {}
    for detector in detectors:
        if by_name.setdefault(detector.name, detector) is not detector:
            raise ValueError(f"two detectors are named {detector.name!r}")
    return tuple(sorted(by_name.values(), key=lambda d: d.priority))


def build_detectors(
    settings: Mapping[str, Options] | None = None,
    only: Iterable[str] | None = None,
    extra: Iterable[Detector] = (),
) -> tuple[Detector, ...]:
    """Detectors from ``{name: options}``; ``enabled`` switches one on or off.

    ``only`` runs exactly the named ones whatever ``enabled`` says; ``extra`` adds
    detectors of your own.
    """
    settings = settings or {}
    asked = None if only is None else frozenset(only)
    for name in (*settings, *(asked or ())):
        if name not in CATALOGUE:
            raise ValueError(f"no detector is named {name!r}; there are {' '.join(CATALOGUE)}")
    records = [_typed(record, settings.get(name)) for name, record in CATALOGUE.items()]
    return in_order([*(_detector(r) for r in records if (r.enabled if asked is None else r.name in asked)), *extra])


def all_detectors(**settings: Options) -> tuple[Detector, ...]:
    """All six built-in detectors."""
    return build_detectors(settings, only=DETECTOR_NAMES)


#: What scrubs source names and log lines, whatever a scan has enabled (M7).
_REDACTING = (CardOptions(), NationalIdOptions(), ApiKeyOptions(detect_generic=False), EmailOptions(), PhoneOptions())
_redacting: list[tuple[Detector, ...]] = []


def redaction_detectors() -> tuple[Detector, ...]:
    """The detectors of ``_REDACTING``, made at first use."""
    if not _redacting:
        _redacting.append(in_order(_detector(r) for r in _REDACTING))
    return _redacting[0]
