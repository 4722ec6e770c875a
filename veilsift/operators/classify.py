"""Risk level and category of a finding."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Level -> rank, and data type -> (risk, category).
RISK_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}
DEFAULTS = {
    "credit_card": ("HIGH", "PCI"),
    "national_id": ("HIGH", "PII"),
    "api_key": ("HIGH", "Credentials"),
    "email": ("MEDIUM", "PII"),
    "phone": ("MEDIUM", "PII"),
    "ip_address": ("LOW", "Network"),
}
OTHER = ("MEDIUM", "Unclassified")


def parse_level(level: str) -> str:
    """A level whatever its case and outer spaces; anything else is an error."""
    name = str(level).strip().upper()
    if name not in RISK_RANK:
        raise ValueError(f"a risk is one of {' '.join(RISK_RANK)}, not {level!r}")
    return name


def _lookup(key: Column, table: Mapping[str, str]) -> Column:
    """A literal map as CASE WHEN: constant-folded, no join."""
    found = F.lit(None).cast("string")
    for name, value in reversed(list(table.items())):
        found = F.when(key == name, F.lit(value)).otherwise(found)
    return found


def category_of(data_type: Column) -> Column:
    return F.coalesce(_lookup(data_type, {k: c for k, (_, c) in DEFAULTS.items()}), F.lit(OTHER[1]))


def risk_of(data_type: Column, subtype: Column, overrides: Mapping[str, str] | None = None) -> Column:
    """``type.subtype`` override, then ``type`` override, then the default."""
    levels = {key: parse_level(level) for key, level in (overrides or {}).items()}
    return F.coalesce(
        _lookup(F.concat(data_type, F.lit("."), F.nullif(subtype, F.lit(""))), levels),
        _lookup(data_type, levels),
        _lookup(data_type, {k: r for k, (r, _) in DEFAULTS.items()}),
        F.lit(OTHER[0]),
    )


def risk_rank(risk: Column) -> Column:
    rank = F.lit(0)
    for name, value in RISK_RANK.items():
        rank = F.when(risk == name, F.lit(value)).otherwise(rank)
    return rank.cast("tinyint")


def at_least(risk: Column, level: str) -> Column:
    return risk_rank(risk) >= RISK_RANK[parse_level(level)]
