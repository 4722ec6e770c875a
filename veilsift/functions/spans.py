"""Span algebra on string columns.

A *span* is ``struct<start, end, value, subtype, data_type>`` with 0-based half-open
code-point offsets.  Everything here is a Catalyst expression:
no Python runs per row and nothing shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string,subtype:string,data_type:string>"
PIECE = "struct<base:int,lead:int,body_len:int,text:string>"

# Two Unicode noncharacters: never word, digit or space, so swapping one for the
# other changes neither what a pattern matches nor any offset.
_MARK = "\ufdd0"
_STAND_IN = "\ufdd1"

#: Units longer than this are detected piece by piece.
PIECE_CHARS = 32768
# Characters no built-in pattern can consume and which every built-in lookaround
# treats like the end of the text: a unit may be cut right after one of them.
_BARRIER = "\",;<>|{}&!*'"
_PIECE = rf"(?s).{{1,{PIECE_CHARS}}}[^{_BARRIER}]*+(?:[{_BARRIER}]|\z)"


def let(value: Column, body: Callable[[Column], Column] | str) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, a function or a SQL lambda."""
    if isinstance(body, str):
        return F.call_function("transform", F.array(value), F.expr(body))[0]
    return F.transform(F.array(value), body)[0]


def no_spans() -> Column:
    return F.expr(f"cast(array() as array<{SPAN}>)")


def record(**fields: Column) -> Column:
    """A struct whose names survive inside nested lambdas, where the analyzer may
    drop aliases before ``struct`` is resolved."""
    return F.named_struct(*[part for name, value in fields.items() for part in (F.lit(name), value)])


def span(
    data_type: str, start: Column, end: Column, value: Column, subtype: Column | None = None
) -> Column:
    return record(
        start=start.cast("int"),
        end=end.cast("int"),
        value=value,
        subtype=(F.lit(None) if subtype is None else subtype).cast("string"),
        data_type=F.lit(data_type),
    )


def _at(start: str, part: str) -> str:
    return (
        f"named_struct('start', {start}, 'end', {start} + length({part}), 'value', {part}, "
        "'subtype', cast(%(subtype)s as string), 'data_type', %(data_type)s)"
    )


_INTS = "cast(array() as array<int>)"


def _running(values: str, first: str) -> str:
    """SQL: ``first`` plus the sums of all ``values`` before each, one fold.  A fold copies
    its array at each step, so ``values`` should be few."""
    return f"""aggregate({values}, named_struct('at', {first}, 'out', {_INTS}),
        (acc, x) -> named_struct('at', acc.at + x, 'out', concat(acc.out, array(acc.at))), acc -> acc.out)"""


def starts_sql(lengths: str) -> str:
    """SQL: the sum of all ``lengths`` (array of int) before each, in blocks of the root of
    their number: n values cost n * sqrt(n) copies instead of n * n."""
    blocks = "transform(sequence(0, (size(own) - 1) div width), j -> slice(own, j * width + 1, width))"
    sums = "transform(parts, x -> aggregate(x, 0, (s, v) -> s + v))"
    whole = f"flatten(zip_with(parts, bases, (x, base) -> {_running('x', 'base')}))"
    with_bases = f"transform(array({_running(sums, '0')}), bases -> {whole})[0]"
    with_parts = f"transform(array({blocks}), parts -> {with_bases})[0]"
    in_blocks = f"transform(array(cast(ceil(sqrt(size(own))) as int)), width -> {with_parts})[0]"
    return f"transform(array({lengths}), own -> if(size(own) = 0, {_INTS}, {in_blocks}))[0]"


def starts_of(lengths: Column) -> Column:
    """The sum of all lengths before each."""
    return let(lengths, f"given -> {starts_sql('given')}")


# one match is the common case and needs no sums
_PLACE = f"""m -> if(not contains(m, '{_MARK}'), cast(array() as array<{SPAN}>), transform(array(split(m, '{_MARK}', -1)),
    parts -> if(size(parts) = 3, array({_at("length(parts[0])", "parts[1]")}), transform(
        array({starts_sql("transform(parts, p -> length(p))")}),
        starts -> transform(
            sequence(0, size(parts) div 2 - 1),
            i -> {_at("starts[2 * i + 1]", "parts[2 * i + 1]")}))[0]))[0])"""


def _quoted(text: str | None) -> str:
    return "null" if text is None else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def find_spans(text: Column, pattern: str, data_type: str, subtype: str | None = None) -> Column:
    """All leftmost non-overlapping matches of a Java regex, with offsets.

    One ``regexp_replace`` brackets each match with a marker and one literal
    ``split`` yields gap, match, gap, ... ; a fold adds up the lengths.  A
    rejected match still consumes its text, as with any regex iterator.
    The text must be :func:`unmarked`.
    """
    names = {"subtype": _quoted(subtype), "data_type": _quoted(data_type)}
    marked = F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}")
    return F.coalesce(let(marked, _PLACE % names), no_spans())


def unmarked(text: Column) -> Column:
    """A text in which the marker stands for nothing else; same length, same matches."""
    return F.replace(text, F.lit(_MARK), F.lit(_STAND_IN))


def keep(spans: Column, test: Callable[[Column], Column]) -> Column:
    """Spans whose *value* passes ``test``."""
    return F.filter(spans, lambda s: test(s["value"]))


def near_keyword(text: Column, s: Column, keywords: tuple[str, ...], window: int) -> Column:
    """Does any lower-cased keyword occur within ``window`` characters of the span?"""
    left_len = F.least(s["start"], F.lit(window))
    around = F.lower(
        F.concat(
            F.substring(text, s["start"] - left_len + 1, left_len),
            F.lit(" "),
            F.substring(text, s["end"] + 1, F.lit(window)),
        )
    )

    def any_keyword(area: Column) -> Column:
        hit = F.lit(False)
        for word in keywords:
            hit = hit | F.contains(area, F.lit(word))
        return hit

    return let(around, any_keyword)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def resolve(found: Column) -> Column:
    """First accepted wins, in the order given; output ordered by start.

    ``found`` should be a plain column.  Most units hold no or one candidate, or some
    that do not touch: those are passed on or only sorted.
    """
    several = F.call_function(
        "transform",
        F.array(found),
        F.expr(
            f"""found -> transform(array(array_sort(found)), placed ->
            if(aggregate(placed, 0, (last, m) -> if(m.start < last, {1 << 30}, m.end)) < {1 << 30}, placed,
               array_sort(aggregate(
                   found,
                   cast(array() as array<{SPAN}>),
                   (kept, m) -> if(exists(kept, k -> k.start < m.end and m.start < k.end), kept,
                                   concat(kept, array(m)))))))[0]"""
        ),
    )[0]
    return F.when(F.size(found) < 2, found).otherwise(several)


def pieces(text: Column, margin: int) -> Column:
    """Cut a text after barrier characters into pieces of about ``PIECE_CHARS``.

    Each piece is ``struct<base, lead, body_len, text>``: ``text`` carries up to
    ``margin`` characters of its neighbours so that context windows see the same
    characters as in the whole text, ``lead`` says how many of them come first and
    ``base`` where the text of the piece starts in the unit.  No match of a
    built-in detector can cross a cut, so keeping the matches inside the body gives
    the matches of the whole text.
    """

    whole = F.array(record(base=F.lit(0), lead=F.lit(0), body_len=F.length(text), text=text))
    cut = let(
        F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)),
        f"""parts -> aggregate(
            sequence(0, size(parts) - 1),
            named_struct('pos', 0, 'out', cast(array() as array<{PIECE}>)),
            (acc, i) -> named_struct(
                'pos', acc.pos + length(parts[i]),
                'out', concat(acc.out, array(transform(
                    array(if(i > 0, right(parts[i - 1], {margin}), '')),
                    before -> named_struct(
                        'base', acc.pos - length(before),
                        'lead', length(before),
                        'body_len', length(parts[i]),
                        'text', before || parts[i] || coalesce(left(get(parts, i + 1), {margin}), ''))
                )[0]))),
            acc -> acc.out)""",
    )
    return F.when(F.length(text) > PIECE_CHARS, cut).otherwise(whole)


def inside(piece: Column, found: Column) -> Column:
    """Matches in the body of a piece, with offsets relative to the whole unit.

    Both arguments should be plain columns: the expression refers to them twice.
    """
    whole = (piece["base"] == 0) & (piece["lead"] == 0) & (piece["body_len"] == F.length(piece["text"]))
    shifted = let(
        record(p=piece, found=found),
        """b -> transform(
            filter(b.found, m -> m.start >= b.p.lead and m.end <= b.p.lead + b.p.body_len),
            m -> named_struct('start', m.start + b.p.base, 'end', m.end + b.p.base,
                              'value', m.value, 'subtype', m.subtype, 'data_type', m.data_type))""",
    )
    return F.when(whole, found).otherwise(shifted)


def splice(text: Column, found: Column) -> Column:
    """Replace every ``struct<start, end, masked>`` of ``text`` by its mask (M6)."""
    return let(
        record(t=text, found=found),
        """s -> aggregate(
            s.found,
            named_struct('out', '', 'at', 0),
            (acc, m) -> named_struct(
                'out', acc.out || substring(s.t, acc.at + 1, m.start - acc.at) || m.masked,
                'at', m.end),
            acc -> acc.out || substring(s.t, acc.at + 1))""",
    )
