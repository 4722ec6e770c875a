"""Python regexes with repeated groups, rewritten so that the JVM runs them without recursion.

The JVM's engine recurses once an iteration for ``(?:...)+``, unless the loop is possessive.  A possessive
loop gives nothing back, so it may stand for a greedy one only where giving back could never help:

* the body is a run of single characters, the same number in each iteration, and
* what follows the loop fails wherever an iteration was given back, for the next character would then be one
  that begins a body: nothing follows at all (a greedy loop that is followed by nothing never gives back), or
  a character class without such characters, or ``\\b`` when bodies begin and end with word characters,
  or a negative lookahead at a class that covers them, or the end of the text.

A group repeated a fixed small number of times is written out.  Whatever the rules do not cover is left alone:
such a pattern keeps running on Python's engine.
"""

from __future__ import annotations

import re
import sys
from functools import lru_cache

try:
    import re._constants as constants
    import re._parser as parser
except ImportError:  # another Python: every pattern with a repeated group stays in Python
    constants = parser = None

#: Characters that a body written out may have in all.
_MOST_WRITTEN = 256
_CATEGORIES = {"CATEGORY_DIGIT": r"\d", "CATEGORY_NOT_DIGIT": r"\D", "CATEGORY_SPACE": r"\s", "CATEGORY_NOT_SPACE": r"\S",
               "CATEGORY_WORD": r"\w", "CATEGORY_NOT_WORD": r"\W"}
_PLACES = {"AT_BEGINNING": "^", "AT_END": "$", "AT_BOUNDARY": r"\b", "AT_NON_BOUNDARY": r"\B", "AT_BEGINNING_STRING": r"\A"}


class _Unsupported(Exception):
    pass


def _char(code: int) -> str:
    return f"\\x{{{code:x}}}"


def _class(items: list) -> str:
    out = []
    for op, value in items:
        name = str(op)
        if name == "NEGATE":
            out.append("^")
        elif name == "LITERAL":
            out.append(_char(value))
        elif name == "RANGE":
            out.append(f"{_char(value[0])}-{_char(value[1])}")
        elif name == "CATEGORY" and str(value) in _CATEGORIES:
            out.append(_CATEGORIES[str(value)])
        else:
            raise _Unsupported(name)
    return "[" + "".join(out) + "]"


def _single(node: tuple) -> str | None:
    """The node as a pattern of exactly one character, or None."""
    op, value = node
    name = str(op)
    if name == "LITERAL":
        return _char(value)
    if name == "NOT_LITERAL":
        return f"[^{_char(value)}]"
    if name == "IN":
        return _class(value)
    if name == "ANY":
        return r"[^\n]"
    return None


def _body(nodes: list) -> list[str] | None:
    """The single characters of a fixed run of them, or None."""
    out: list[str] = []
    for node in nodes:
        op, value = node
        one = _single(node)
        if one is not None:
            out.append(one)
        elif str(op) == "MAX_REPEAT" and value[0] == value[1] and (inner := _body(list(value[2]))) is not None:
            if len(inner) * value[0] > _MOST_WRITTEN:
                return None
            out += inner * value[0]
        elif str(op) == "SUBPATTERN" and not value[1] and not value[2]:
            inner = _body(list(value[3]))
            if inner is None:
                return None
            out += inner
        else:
            return None
        if len(out) > _MOST_WRITTEN:
            return None
    return out


@lru_cache(maxsize=256)
def _members(one: str) -> frozenset[int]:
    """Code points that a single-character pattern takes, of all that Python has."""
    python = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), one)
    return frozenset(map(ord, re.findall(python, _alphabet())))


@lru_cache(maxsize=1)
def _alphabet() -> str:
    return "".join(map(chr, (c for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF)))


def _never_gives_back(body: list[str], rest: list) -> bool:
    """Does what follows a loop fail wherever an iteration was given back?"""
    if not rest:
        return True
    first, last = _members(body[0]), _members(body[-1])
    op, value = rest[0]
    name = str(op)
    one = _single(rest[0])
    if one is not None:
        return not first & _members(one)
    if name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0 and len(value[2]) == 1 and (one := _single(value[2][0])):
        return not first & _members(one)
    if name == "AT" and str(value) == "AT_BOUNDARY":
        words = _members(r"\w")
        return first <= words and last <= words
    if name == "AT" and str(value) in ("AT_END", "AT_END_STRING"):
        return ord("\n") not in first
    if name == "ASSERT_NOT" and value[0] == 1 and len(value[1]) == 1 and (one := _single(value[1][0])):
        return first <= _members(one)
    return False


def _times(low: int, high: int, lazy: bool) -> str:
    most = "" if high == constants.MAXREPEAT else str(high)
    return ("{%d}" % low if low == high else "{%d,%s}" % (low, most)) + ("?" if lazy else "")


def _written(nodes: list, whole_rest: list) -> str:
    out = []
    for i, (op, value) in enumerate(nodes):
        name = str(op)
        rest = list(nodes[i + 1 :]) + whole_rest
        one = _single((op, value))
        if one is not None:
            out.append(one)
        elif name == "AT" and str(value) in _PLACES:
            out.append(_PLACES[str(value)])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out.append(_repeat(value, name == "MIN_REPEAT", rest))
        elif name == "SUBPATTERN" and not value[1] and not value[2]:
            out.append("(?:" + _written(list(value[3]), rest) + ")")
        elif name == "BRANCH":
            out.append("(?:" + "|".join(_written(list(b), rest) for b in value[1]) + ")")
        elif name in ("ASSERT", "ASSERT_NOT"):
            mark = {(1, "ASSERT"): "?=", (1, "ASSERT_NOT"): "?!", (-1, "ASSERT"): "?<=", (-1, "ASSERT_NOT"): "?<!"}
            out.append(f"({mark[value[0], name]}{_written(list(value[1]), [])})")
        else:
            raise _Unsupported(name)
    return "".join(out)


def _repeat(value: tuple, lazy: bool, rest: list) -> str:
    low, high, inner = value[0], value[1], list(value[2])
    if len(inner) == 1 and (one := _single(inner[0])):
        return one + _times(low, high, lazy)
    body = _body(inner)
    if body is None or not body:
        raise _Unsupported("a body of changing length")
    if low == high:
        if len(body) * low > _MOST_WRITTEN:
            raise _Unsupported("a long repetition")
        return "".join(body) * low
    if lazy or not _never_gives_back(body, rest):
        raise _Unsupported("a loop that may give back")
    return "(?:" + "".join(body) + ")" + _times(low, high, False) + "+"


def without_recursion(pattern: str) -> str | None:
    """A Java regex with the matches of a Python one, whatever the text; None where that is not proven.

    Numbered groups become plain ones: only whole matches are read.
    """
    if parser is None:
        return None
    try:
        tree = parser.parse(pattern)
        if tree.state.flags != re.UNICODE.value or tree.getwidth()[0] == 0:
            return None
        return _written(list(tree), [])
    except (re.error, _Unsupported, RecursionError, KeyError):
        return None
