"""Secret scans (1): a trigram inverted index picks the texts in which a rule can match.

Each rule's regex gives a Boolean query of trigrams (``trigrams.py``).  One pass over the
lower-cased texts builds posting lists of the trigrams that any rule asks for, per trigram
and bucket of 32,768 ids (so a list is bounded); intersecting and uniting them gives the
candidate documents of each rule, whose whole texts are then searched.  Rules without
mandatory trigrams search every text.  All of it is Catalyst expressions.

Null text is empty.  Rows that share an id are each searched when one of them is a
candidate; rows without an id are searched by every rule.  Extra columns pass through, an
input column named ``spans`` is replaced, an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilsift.functions.spans import unmarked

from .common import small_side, written
from .native_spans import count_of, joined, kind_spans
from .trigrams import trigram_query

_BUCKET = 1 << 15


@dataclass(frozen=True)
class Rule:
    """``pattern`` without case if ``fold``; ``test`` on the matched value.

    ``safe`` finds the same matches in time linear in the text and without recursion, where
    ``pattern`` does not; it may have a lead, the match then begins at the first ``opening``.
    """

    kind: str
    pattern: str
    fold: bool = False
    test: Callable[[Column], Column] | None = None
    safe: str | None = None
    opening: str | None = None

    @property
    def plain(self) -> str:
        return f"(?i){self.pattern}" if self.fold else self.pattern

    @property
    def java(self) -> str:
        return self.safe or self.plain


_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def _long_value(match: Column) -> Column:
    return F.length(F.regexp_extract(match, f"(?i){_ASSIGN}", 2)) >= 6


#: The three base kinds, in the order that breaks ties, then formats that name their issuer.
BASE = (
    Rule("assign", _ASSIGN, True, _long_value),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ISSUED = (
    Rule(
        "pem",
        r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----",
        # words one space apart, without a repeated group
        safe=r"-----BEGIN (?! )(?![A-Z0-9 ]*?  )[A-Z0-9 ]*+(?<= PRIVATE KEY)-----",
    ),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule(
        "bearer",
        r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
        # tried once for each run of its characters, not at each eyJ of it
        safe=r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8})"
        r"[A-Za-z0-9_-]*?eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
        opening="eyJ",
    ),
)


def build_index(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """Postings ``trigram, bucket, offsets`` (sorted) of the wanted trigrams of lower-cased texts."""
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(wanted)]))
    rows = own.select("doc_id", F.explode(held).alias("trigram"))
    return rows.groupBy("trigram", F.floor(F.col("doc_id") / _BUCKET).alias("bucket")).agg(
        F.sort_array(F.collect_set(F.pmod("doc_id", F.lit(_BUCKET)).cast("int"))).alias("offsets")
    )


def candidates(index: DataFrame, wanted: list[str], queries: list) -> DataFrame:
    """``doc_id, mask``: bit r of the mask says that rule r's query holds in the document."""
    number = {t: i for i, t in enumerate(wanted)}
    lists = index.groupBy("bucket").agg(
        F.map_from_entries(F.collect_list(F.struct("trigram", "offsets"))).alias("lists")
    )
    none = F.expr("cast(array() as array<int>)")

    def holding(clause) -> Column:
        postings = [F.coalesce(F.try_element_at("lists", F.lit(number[t])), none) for t in sorted(clause)]
        return reduce(F.array_intersect, postings)

    def marked(bit: int) -> Callable[[Column], Column]:
        return lambda at: F.named_struct(F.lit("at"), at, F.lit("bit"), F.lit(bit).cast("long"))

    found = [
        F.transform(reduce(F.array_union, [holding(c) for c in sorted(q, key=sorted)]), marked(1 << r))
        for r, q in enumerate(queries)
        if q is not None
    ]
    rows = lists.select("bucket", F.explode(F.concat(*found)).alias("c"))
    return rows.groupBy((F.col("bucket") * _BUCKET + F.col("c.at")).alias("doc_id")).agg(F.bit_or("c.bit").alias("mask"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ISSUED, most_broadcast: int = 1_000_000) -> DataFrame:
    """``docs`` with ``spans``: start, rank of the rule, kind, end and value of every match, sorted.

    Candidates are broadcast while at most ``most_broadcast``; more are joined by id.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted({t for q in queries if q for clause in q for t in clause})
    names = [c for c in docs.columns if c != "spans"]
    rows = docs.select(  # other columns travel as one, so that no name can clash
        F.struct(*[docs[c] for c in names]).alias("row"), docs["doc_id"].cast("long").alias("id"), docs["text"].alias("text")
    )
    mask = F.lit(0).cast("long")
    if wanted:
        picked = written(candidates(build_index(docs, wanted), wanted, queries), "secret-candidates")
        picked = picked.withColumnRenamed("doc_id", "id")
        rows = rows.join(small_side(picked, picked.count(), most_broadcast), "id", "left")
        mask = F.when(F.col("id").isNull(), F.lit(-1)).otherwise(F.coalesce("mask", F.lit(0)))
    rows = rows.select("row", mask.alias("mask"), unmarked(F.coalesce("text", F.lit(""))).alias("text"))
    found = [
        kind_spans(
            F.col("text"), rule.kind, rank, rule.java,
            F.lit(True) if query is None else F.col("mask").bitwiseAND(F.lit(1 << rank)) != 0, rule.test, rule.opening,
        )
        for rank, (rule, query) in enumerate(zip(rules, queries))
    ]
    return rows.select("row.*", F.array_sort(F.concat(*found)).alias("spans"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["rank"] < len(BASE))
    return find_secrets(docs).select(
        "doc_id",
        *[count_of(spans, r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def _sql() -> str:
    parts = []
    for rank, rule in enumerate(BASE + ISSUED):
        pattern = rule.plain.replace("'", "''")
        test = f"length(regexp_extract(m[i], '{pattern}', 2)) >= 6" if rule.kind == "assign" else "true"
        parts.append(f"""
  SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, m[i] AS value,
         list_sum(list_transform(g[1:i], lambda x: length(x)))
         + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g
    FROM documents WHERE text IS NOT NULL)) WHERE {test}""")
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in BASE)
    each = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(value) AS BIGINT)"
    return f"""
WITH found AS ({" UNION ALL ".join(parts)})
SELECT d.doc_id, {counts},
       sha256(coalesce(string_agg({each}, ',' ORDER BY s, rank) FILTER (rank < {len(BASE)}), '')) AS base_sha256,
       coalesce(string_agg({each}, ',' ORDER BY s, rank), '') AS spans
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id GROUP BY d.doc_id"""


SQL = _sql()
