"""Allowlist patterns: turned into regexes on the driver, applied by ``rlike``."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# One glob token at a time, longest form first.
_TOKEN = re.compile(r"(?P<tree>\*\*/)|(?P<any>\*\*)|(?P<star>\*)|(?P<one>\?)|\[(?P<set>[^\]]*)\]|(?P<char>.)", re.S)
_SIMPLE = {"tree": "(?:.*/)?", "any": ".*", "star": "[^/]*", "one": "[^/]"}


def normalise_glob(pattern: str) -> str:
    """Forward slashes, no leading ``./``, no trailing slash."""
    flat = re.sub(r"^(?:\./)+", "", pattern.replace("\\", "/"))
    return flat.rstrip("/") or "/"


def normalise_path(path: Column) -> Column:
    """The same rule for a column of paths."""
    flat = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:\./)++", "")
    return F.coalesce(F.nullif(F.regexp_replace(flat, "/++$", ""), F.lit("")), F.lit("/"))


def _class_body(body: str) -> str:
    negated = body.startswith("!")
    inner = body[1:] if negated else body
    # Java gives '[' and '&&' inside a class a meaning of their own
    inner = inner.replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
    return ("[^" if negated else "[") + inner + "]"


def glob_regex(pattern: str) -> str:
    """``*`` and ``?`` stay in a segment, ``**`` crosses, a final ``/**`` includes
    the directory itself (A5).  The result is a Java regex for the whole path."""
    stem, tail = (pattern[:-3], "(?:/.*)?") if pattern.endswith("/**") else (pattern, "")
    out = []
    for token in _TOKEN.finditer(stem):
        kind = token.lastgroup
        if kind == "set" and token["set"]:
            out.append(_class_body(token["set"]))
        elif kind in ("set", "char"):
            out.append(re.sub(r"([^\w\s]|_)", r"\\\1", token.group()))
        else:
            out.append(_SIMPLE[kind])
    return f"(?s)^{''.join(out)}{tail}\\z"


def _any(column: Column, regexes: list[str]) -> Column:
    # one alternation instead of one scan of the path per pattern
    return column.rlike("|".join(f"(?:{r})" for r in regexes))


def path_matches(patterns: Iterable[str], relative: Column, absolute: Column | None = None) -> Column:
    """Is a path allowlisted? (N1)  A pattern with ``/`` looks at the whole relative
    or absolute path, one without looks at every segment of the relative path."""
    globs = [normalise_glob(str(p)) for p in patterns]
    full = [glob_regex(g) for g in globs if "/" in g]
    segment = [glob_regex(g) for g in globs if "/" not in g]
    rel = normalise_path(relative)
    hit = F.lit(False)
    if full:
        hit = hit | _any(rel, full)
        if absolute is not None:
            hit = hit | _any(normalise_path(absolute), full)
    if segment:
        hit = hit | F.exists(F.split(rel, "/"), lambda s: (s != "") & _any(s, segment))
    return F.coalesce(hit, F.lit(False))


def name_matches(patterns: Iterable[str], *names: str) -> bool:
    """Case-insensitive name globs over table and column metadata."""
    globs = [str(p).lower() for p in patterns]
    return any(fnmatch.fnmatchcase(name.lower(), g) for g in globs for name in names)
