"""API keys and secrets: provider formats and high-entropy strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.checks import entropy
from ..functions.masks import mask_key
from ..functions.spans import find_spans, keep, let, no_spans, overlaps
from .detector import Detector

NAME = "api_key"
GENERIC = "high_entropy_string"

# The provider formats, in order.
PROVIDERS = {
    "aws_access_key_id": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "github_token": r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,255}(?![A-Za-z0-9])",
    "github_fine_grained_token": r"(?<![A-Za-z0-9])github_pat_[A-Za-z0-9_]{22,255}(?![A-Za-z0-9_])",
    "slack_token": r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}",
    "stripe_key": r"(?<![A-Za-z0-9])[sr]k_live_[A-Za-z0-9]{16,}",
    "google_api_key": r"(?<![A-Za-z0-9])AIza[0-9A-Za-z_\-]{35}(?![0-9A-Za-z_\-])",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    # any number of capital words, one space apart: no repeated group, which would recurse in the JVM
    "private_key": r"-----BEGIN (?! )(?![A-Z ]*?  )[A-Z ]*+(?<= PRIVATE KEY)-----",
}
_MARKERS = ("AKIA", "ASIA", "xox", "AIza", "eyJ", "-----BEGIN")
_UNDERSCORED = r"gh[pousr]_|github_pat_|[sr]k_live_"
# What a token is, and the shapes that are names of things.
_TOKEN = r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{20,}={0,2}(?![A-Za-z0-9+/_\-])"
_HEX_OR_UUID = r"^(?:[0-9a-fA-F]+|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})\z"
_WORD_PART = r"^(?:\d+|[a-z]+|[A-Z]+|[A-Z][a-z]*)\z"
_LONGEST = 200


def is_slug(token: Column) -> Column:
    """Three or more parts on ``-`` or ``_``, at least 60% of them words or numbers."""
    return let(
        F.split(token, "[-_]"),
        lambda parts: (F.size(parts) >= 3)
        & (F.size(F.filter(parts, lambda p: p.rlike(_WORD_PART))) * 5 >= F.size(parts) * 3),
    )


def is_camel_case(token: Column) -> Column:
    """Two or more capitals, at least 80% of them before a lower-case letter."""
    capitals = F.regexp_count(token, F.lit("[A-Z]"))
    humps = F.regexp_count(token, F.lit("[A-Z][a-z]"))
    return (capitals >= 2) & (humps * 5 >= capitals * 4)


def looks_secret(token: Column, threshold: float = 4.0, min_length: int = 20) -> Column:
    """Does a token look random rather than like a name, a hash or a path?"""
    separators = F.length(token) - F.length(F.translate(token, "-_", ""))
    return (
        F.length(token).between(min_length, _LONGEST)
        & ~token.rlike(_HEX_OR_UUID)
        & token.rlike("[0-9]")
        & token.rlike("[A-Za-z]")
        & (separators <= F.floor(F.length(token) / 3))
        & ~is_slug(token)
        & ~is_camel_case(token)
        & (entropy(token) >= threshold)
    )


def provider_hint(text: Column) -> Column:
    """Does the text hold a marker of any provider format?  Byte searches are far
    cheaper than one regex with as many branches."""
    hit = F.contains(text, F.lit("_")) & text.rlike(_UNDERSCORED)
    for marker in _MARKERS:
        hit = F.contains(text, F.lit(marker)) | hit
    return hit


def provider_spans(text: Column) -> Column:
    found = F.concat(*[find_spans(text, rule, NAME, name) for name, rule in PROVIDERS.items()])
    return F.when(provider_hint(text), found).otherwise(no_spans())


def api_key_detector(
    entropy_threshold: float = 4.0, min_length: int = 20, detect_generic: bool = True
) -> Detector:
    def generic_spans(text: Column, taken: Column) -> Column:
        tokens = keep(
            find_spans(text, _TOKEN, NAME, GENERIC),
            lambda token: looks_secret(token, entropy_threshold, min_length),
        )
        free = F.filter(tokens, lambda t: ~F.exists(taken, lambda p: overlaps(p, t)))
        return F.when(F.length(text) >= min_length, free).otherwise(no_spans())

    def spans(text: Column) -> Column:
        if not detect_generic:
            return provider_spans(text)
        return let(provider_spans(text), lambda taken: F.concat(taken, generic_spans(text, taken)))

    return Detector(
        NAME,
        30,
        spans,
        lambda value, subtype: mask_key(value, subtype, GENERIC),
        hint=provider_hint,
        digit_hint=(lambda text: text.rlike(_TOKEN)) if detect_generic else None,
        cuttable=True,
    )
