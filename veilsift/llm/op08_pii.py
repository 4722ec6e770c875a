"""PII (8): bootstrapped contextual extraction.

E-mail addresses, IP addresses, card and phone numbers found by their own rules are the
seeds.  Words before and after an identifier-like token, with ends of lines and other tokens
as placeholders, are its *patterns*, the token is an *instance*; both form a graph over the
whole corpus.  Rounds of joins score it: a pattern
is as good for a kind as the mean confidence of its instances, an instance without a kind
of its own as good as its best pattern.  Patterns that many different instances support,
seeds or instances accepted in earlier rounds, and that score high then discover instances
that no rule finds, as spans ``found_<kind>``.
All of it is DataFrame operations; texts are read once, the graph holds no texts.

Null text is empty.  Rows that share id and text get the same spans.  Extra columns pass
through, an input column named ``spans`` is replaced, an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilsift.functions.spans import _MARK, let, record, starts_of, unmarked

from .common import written
from .native_spans import FOUND, count_of, joined, kind_spans

KINDS = ("email", "ip", "card", "phone")

#: The patterns of the four kinds, for the JVM: each run of characters is tried once, at its start or
#: where the last match ended, and nothing is given back, so texts of any kind take linear time and no
#: stack.  A card starts where no longer run of digits with single separators goes on.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: An identifier-like token: a digit or an at sign between white space.  A number goes on over groups of
#: digits after single blanks, up to a group that other characters follow, or an IP address.
_NO_IP = r"(?![0-9]+(?:\.[0-9]+){3}(?![0-9.]))"
_GROUP = rf"{_NO_IP}[0-9]++(?:\)?[-./]?\(?[0-9]++)*+\)?+"
_ENDS = r"(?=[.,;:!?)\]}>\"'|]*+(?!\S))"
TOKEN = (
    rf"(?<!\S)[^\s0-9@]*+(?:(?<!\p{{L}}){_GROUP}(?:[\x20\xa0]\(?{_GROUP}{_ENDS})++|[0-9@]\S*+)"
)

#: An opening mark that is no part of a token; ``(017) 555`` keeps its own.
_OPENS = r"^(?:(?!\(\+?[0-9]+\).*[0-9])[(\[{<\"'|])+"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _ip_ok(value: Column) -> Column:
    return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")


def _card_ok(value: Column) -> Column:
    digits = _digits(value)
    return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)


def _phone_ok(value: Column) -> Column:
    return F.length(_digits(value)).between(10, 15)


def base_spans(text: Column) -> Column:
    """Sorted spans of the four kinds."""
    some = text.rlike("[0-9]")
    found = F.concat(
        kind_spans(text, "email", 0, EMAIL, F.contains(text, F.lit("@"))),
        kind_spans(text, "ip", 1, IP, some, _ip_ok),
        kind_spans(text, "card", 2, CARD, some, _card_ok),
        kind_spans(text, "phone", 3, PHONE, F.contains(text, F.lit("+")), _phone_ok),
    )
    return F.array_sort(found)


def _words(gap: Column) -> Column:
    """Lower-cased words of the text between two tokens, without marks at their ends."""
    plain = F.regexp_replace(F.lower(gap), r"[^\p{L}\p{M}\s]+", "-")
    return F.filter(F.transform(F.split(plain, r"\s+"), lambda w: F.regexp_replace(w, "^-|-$", "")), lambda w: w != "")


def _gap(gap: Column) -> Column:
    lines = [_words(F.substring_index(gap, "\n", side)) for side in (1, -1)]
    return record(words=_words(gap), first=lines[0], last=lines[1], broken=F.contains(gap, F.lit("\n")))


def _contexts(before: Column, after: Column, first: Column, last: Column) -> Column:
    """Patterns of a token (``_``) between two gaps: one and two words before, as many after, the same
    within its line, and the neighbours on both sides.

    ``^`` and ``$`` stand for the ends of the text or line, ``#`` for another token.
    """
    head, tail = F.when(first, "^").otherwise("#"), F.when(last, "$").otherwise("#")
    left, right = F.concat(F.array(head), before["words"]), F.concat(after["words"], F.array(tail))
    left_line = F.concat(F.array(F.when(before["broken"], "^").otherwise(head)), before["last"])
    right_line = F.concat(after["first"], F.array(F.when(after["broken"], "$").otherwise(tail)))

    def ends(words: Column, n: int) -> Column:
        return F.array_join(F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), F.lit(n)), " ")

    def begins(words: Column, n: int) -> Column:
        return F.array_join(F.slice(words, 1, n), " ")

    token = F.lit("_")
    told = [F.concat_ws(" ", ends(w, n), token) for w, n in ((left, 1), (left, 2), (left_line, 2))]
    told += [F.concat_ws(" ", token, begins(w, n)) for w, n in ((right, 1), (right, 2), (right_line, 2))]
    told.append(F.concat_ws(" ", ends(left_line, 1), token, begins(right_line, 1)))
    # a pattern holds a word, or the token is a line of its own
    return F.array_distinct(F.filter(F.array(*told), lambda p: p.rlike(r"\p{L}") | (p == "^ _ $")))


def occurrences(text: Column) -> Column:
    """Identifier-like tokens with their contexts: ``patterns, token, start, end``.

    Marks at both ends of a token are not part of it; letter case and marks of words are dropped.
    """
    marked = F.split(F.regexp_replace(text, TOKEN, f"{_MARK}$0{_MARK}"), _MARK, -1)  # gap, token, gap, ...
    parts = F.when(text.rlike("[0-9@]"), marked).otherwise(F.array(F.lit("")))

    def count(b: Column) -> Column:
        return F.floor(F.size(b["parts"]) / 2).cast("int")

    def one(i: Column, b: Column) -> Column:
        raw = F.get(b["parts"], 2 * i + 1)
        bare = F.regexp_replace(raw, r"[.,;:!?)\]}>\"'|]+$", "")
        token = F.regexp_replace(bare, _OPENS, "")
        end = F.get(b["starts"], 2 * i + 1) + F.length(bare)
        patterns = _contexts(F.get(b["gaps"], i), F.get(b["gaps"], i + 1), i == 0, i == count(b) - 1)
        return record(patterns=patterns, token=token, start=end - F.length(token), end=end)

    def every(p: Column) -> Column:
        gaps = F.filter(p, lambda _, i: i % 2 == 0)
        both = record(parts=p, gaps=F.transform(gaps, _gap), starts=starts_of(F.transform(p, F.length)))
        return let(both, lambda b: F.transform(F.slice(F.sequence(F.lit(0), count(b)), F.lit(1), count(b)), lambda i: one(i, b)))

    return let(parts, every)


def _fits(token: Column, kind: Column, how: Bootstrap) -> Column:
    """May ``token`` be a discovery of ``kind``?"""
    return F.when(kind == "email", token.rlike("[^@]@[^@]")).otherwise(F.length(_digits(token)) >= how.digits)


@dataclass(frozen=True)
class Bootstrap:
    """How patterns are trusted: support in seeds, confidence, rounds, least digits of a value (e-mail: an at sign)."""

    seeds: int = 3
    confidence: float = 0.8
    rounds: int = 3
    smoothing: float = 1.0
    digits: int = 4


def score_patterns(edges: DataFrame, how: Bootstrap) -> DataFrame:
    """``pattern, kind, confidence, support`` from the graph ``pattern, token, kind, fits`` (kind null: none
    known; ``fits``: the kinds that the token may be).

    Edges are distinct before they shuffle; each round joins tables of patterns and of tokens.  What trusted
    patterns accept in one round supports all its patterns in the next, by its confidence.
    """
    graph = edges.groupBy("pattern", "token").agg(F.max("kind").alias("kind"), F.first("fits").alias("fits"))
    graph = written(graph, "pii-graph")
    seeds = graph.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
    seeds = written(seeds, "pii-seeds")
    size = written(graph.groupBy("pattern").agg(F.count("*").alias("size")), "pii-sizes")
    conf = seeds.join(size, "pattern").select(
        "pattern", "kind", (F.col("seeds") / (F.col("size") + how.smoothing)).alias("confidence"),
        F.col("seeds").cast("double").alias("support"),
    )
    unknown = graph.where("kind is null").select("pattern", "token", "fits")
    zero = F.lit(0.0)
    for _ in range(how.rounds):
        sure = F.when(_trusted(how) & F.array_contains("fits", F.col("kind")), F.col("confidence"))
        best = unknown.join(conf, "pattern").groupBy("token", "kind").agg(
            F.max("confidence").alias("c"), F.max(sure).alias("accepted")
        )
        gained = unknown.join(best, "token").groupBy("pattern", "kind").agg(
            F.sum("c").alias("gain"), F.sum("accepted").alias("backed")
        )
        total = seeds.join(gained, ["pattern", "kind"], "full").join(size, "pattern")
        own = F.coalesce("seeds", zero)
        mean = (own + F.coalesce("gain", zero)) / (F.col("size") + how.smoothing)
        support = own + F.coalesce("backed", zero)
        conf = written(total.select("pattern", "kind", mean.alias("confidence"), support.alias("support")), "pii-round")
    return conf


def _trusted(how: Bootstrap) -> Column:
    return (F.col("confidence") >= how.confidence) & (F.col("support") >= how.seeds)


#: Texts of more spans than this look for the span of a token by place, not one by one.
_FEW = 64


def _with_seeds(rows: DataFrame, block: int = 1024) -> DataFrame:
    """``id, tid, patterns, token, start, end, seed``: a row for each token and base span that touch, or for a
    token alone (seed null).  A token of several groups may touch several seeds.

    Where a text has many spans, tokens and spans meet in blocks of offsets.
    """
    seen = rows.select("id", "tid", "base", F.posexplode("seen").alias("n", "o")).select("id", "tid", "base", "n", "o.*")
    token = ("id", "tid", "patterns", "token", "start", "end")
    over = F.filter("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))
    few = seen.where(F.size("base") <= _FEW).select(*token, F.explode_outer(over).alias("seed"))

    def blocks(start: Column, end: Column) -> Column:
        return F.explode(F.sequence(F.floor(start / block), F.floor((end - 1) / block)))

    crowded = rows.where(F.size("base") > _FEW)
    spans = crowded.select("id", "tid", F.explode("base").alias("seed")).distinct()
    spans = spans.select(F.col("id").alias("i"), F.col("tid").alias("t"), "seed", blocks(F.col("seed.start"), F.col("seed.end")).alias("b"))
    many = seen.where(F.size("base") > _FEW)
    at = many.select("id", "tid", "n", "start", "end").distinct()
    at = at.select("*", blocks(F.col("start"), F.col("end")).alias("block"))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("tid") == F.col("t")) & (F.col("block") == F.col("b"))
    touch = same & (F.col("seed.start") < F.col("end")) & (F.col("start") < F.col("seed.end"))
    # a pair that shares several blocks counts in the first
    first = F.col("b") == F.floor(F.greatest("start", "seed.start") / block)
    met = at.join(spans, touch & first).select("i", "t", F.col("n").alias("m"), "seed")
    own = F.col("id").eqNullSafe(F.col("i")) & (F.col("tid") == F.col("t")) & (F.col("n") == F.col("m"))
    return few.unionByName(many.join(met, own, "left").select(*token, "seed"))


def find_personal_data(docs: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """``docs`` without ``text``, with ``spans``: base spans and those that patterns discover, sorted."""
    names = [c for c in docs.columns if c not in ("spans", "text")]
    text = unmarked(F.coalesce("text", F.lit("")))
    rows = docs.select(  # other columns travel as one, so that no name can clash
        F.struct(*[docs[c] for c in names]).alias("row"), docs["doc_id"].alias("id"), text.alias("text")
    )
    rows = rows.select(
        "row", "id", F.xxhash64("text").alias("tid"), base_spans(F.col("text")).alias("base"), occurrences(F.col("text")).alias("seen")
    )
    rows = written(rows, "pii-rows")

    seen = _with_seeds(rows)
    # a seed counts as the whole value that its rule found, of which the token may be the first part
    instance = F.lower(F.coalesce("seed.value", "token")).alias("token")
    seen = seen.withColumn("kind", F.col("seed.kind"))
    fits = F.filter(F.array(*map(F.lit, KINDS)), lambda k: _fits(F.col("token"), k, how))
    edges = seen.select("patterns", instance, "kind", fits.alias("fits"))
    # long lists of numbers are one token: the graph knows them by a digest
    key = F.when(F.length("token") > 64, F.sha2("token", 256)).otherwise(F.col("token")).alias("token")
    edges = edges.select(F.explode("patterns").alias("pattern"), key, "kind", "fits")
    trusted = score_patterns(edges, how).where(_trusted(how))

    new = seen.where("kind is null").select("id", "tid", "token", "start", "end", F.explode("patterns").alias("pattern"))
    new = new.join(trusted, "pattern").where(_fits(F.col("token"), F.col("kind"), how))
    # the best of the patterns that hold an occurrence decides
    new = new.groupBy("id", "tid", "token", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("guess"))
    ranks = F.create_map(*[F.lit(v) for i, k in enumerate(KINDS) for v in (k, len(KINDS) + i)])
    span = F.struct(
        "start", ranks[F.col("guess")].alias("rank"), F.concat(F.lit("found_"), "guess").alias("kind"), "end",
        F.col("token").alias("value"),
    ).cast(FOUND)
    new = new.groupBy(F.col("id").alias("id2"), F.col("tid").alias("tid2")).agg(F.collect_set(span).alias("new"))
    out = rows.join(new, F.col("id").eqNullSafe(F.col("id2")) & (F.col("tid") == F.col("tid2")), "left")
    spans = F.array_sort(F.concat("base", F.coalesce("new", F.expr(f"cast(array() as array<{FOUND}>)"))))
    return out.select("row.*", spans.alias("spans"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["rank"] < len(KINDS))
    return find_personal_data(docs).select(
        "doc_id",
        *[count_of(spans, k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )
