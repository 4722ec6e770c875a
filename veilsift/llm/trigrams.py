"""Boolean trigram queries from regular expressions.

A query is an OR of clauses, each an AND of trigrams of the lower-cased text; ``None`` is
"any text".  A subexpression is either a small set of exact strings or, failing that, a
query; neighbouring exact parts are multiplied out, so that their trigrams span both.
"""

from __future__ import annotations

from dataclasses import dataclass

_MOST = 64  # exact strings or clauses kept; beyond that a part constrains nothing

Query = frozenset | None  # of frozensets of trigrams


@dataclass(frozen=True)
class _Part:
    exact: frozenset | None
    query: Query = None


def _of_strings(strings: frozenset) -> Query:
    if not strings or any(len(s) < 3 for s in strings):
        return None
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return a if b is None else b
    clauses = frozenset(x | y for x in a for y in b)
    return clauses if len(clauses) <= _MOST else a


def _query(part: _Part) -> Query:
    return _of_strings(part.exact) if part.exact is not None else part.query


def _sequence(parts: list[_Part]) -> _Part:
    query, run, whole = None, frozenset([""]), True
    for part in parts:
        if part.exact is not None and len(part.exact) * len(run) <= _MOST:
            run = frozenset(a + b for a in run for b in part.exact)
            continue
        whole, query = False, _both(query, _of_strings(run))
        run = part.exact if part.exact is not None else frozenset([""])
        if part.exact is None:
            query = _both(query, part.query)
    return _Part(run) if whole else _Part(None, _both(query, _of_strings(run)))


def _choice(parts: list[_Part]) -> _Part:
    if all(p.exact is not None for p in parts):
        strings = frozenset().union(*(p.exact for p in parts))
        return _Part(strings) if len(strings) <= _MOST else _Part(None, _of_strings(strings))
    queries = [_query(p) for p in parts]
    return _Part(None, None if None in queries else frozenset().union(*queries))


class _Reader:
    """Literals, escapes, classes, groups, ``|`` and quantifiers of one pattern."""

    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def peek(self) -> str:
        return self.pattern[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.pattern[self.at - 1]

    def choice(self) -> _Part:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return _choice(parts) if len(parts) > 1 else parts[0]

    def sequence(self) -> _Part:
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.atom()))
        return _sequence(parts)

    def atom(self) -> _Part:
        c = self.take()
        if c == "(":
            if self.pattern.startswith("?:", self.at):
                self.at += 2
            elif self.peek() == "?":
                raise ValueError("only plain and non-capturing groups are read")
            inner = self.choice()
            self.take()
            return inner
        if c == "[":
            return self.char_class()
        if c == "\\":
            c = self.take()
            if c == "x":
                c, self.at = chr(int(self.pattern[self.at : self.at + 2], 16)), self.at + 2
            return _Part(None) if c.isalnum() else _Part(frozenset([c]))
        return _Part(None) if c in ".^$" else _Part(frozenset([c.lower()]))

    def char_class(self) -> _Part:
        chars, negated = set(), self.peek() == "^"
        while (c := self.take()) != "]" or not (chars or negated):
            if c == "\\":
                c = self.take()
            if self.peek() == "-" and self.pattern[self.at + 1 : self.at + 2] != "]":
                self.take()
                chars |= {chr(k).lower() for k in range(ord(c), ord(self.take()) + 1)}
            else:
                chars.add(c.lower())
        return _Part(None) if negated or len(chars) > 8 else _Part(frozenset(chars))

    def repeated(self, part: _Part) -> _Part:
        c = self.peek()
        if c not in ("?", "*", "+", "{"):
            return part
        self.take()
        low = {"?": 0, "*": 0, "+": 1}.get(c)
        if c == "{":
            end = self.pattern.index("}", self.at)
            low, self.at = int(self.pattern[self.at : end].split(",")[0]), end + 1
        if self.peek() in ("+", "?"):
            self.take()
        if c == "?" and part.exact is not None:
            return _Part(part.exact | {""})
        return _Part(None, _query(part) if low else None)


def trigram_query(pattern: str) -> Query:
    """The clauses of a pattern, or None if a match need not hold any trigram."""
    query = _query(_Reader(pattern).choice())
    if query is None:
        return None
    return frozenset(c for c in query if not any(other < c for other in query))
