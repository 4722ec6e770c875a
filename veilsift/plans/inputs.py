"""Inputs of the registered queries: the given tables, and texts derived from them.

A derived text is a chain of SELECT lists in the SQL that Spark and DuckDB share,
so that both sides of a check read the same characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.lines import lines_of
from ..sources.spread import spread, spread_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_GROUPED = (
    "substr(n, 1, 4) || {sep} || substr(n, 5, 4) || {sep} || substr(n, 9, 4) || {sep} || substr(n, 13)"
)


def _padded(expression: str, width: int) -> str:
    return f"lpad(cast({expression} as string), {width}, '0')"


def _parts(value: str, *cuts: tuple[int, int, str]) -> str:
    return " || ".join(f"substr({value}, {start}, {size}) || '{after}'" for start, size, after in cuts)


#: name -> (table, SELECT lists applied one after the other)
DERIVED: dict[str, tuple[str, list[list[str]]]] = {
    # cards of six schemes, plain, spaced or dashed, some glued to a letter
    "card_texts": (
        "orders",
        [
            [
                "o_orderkey as k",
                "case o_orderkey % 6 "
                f"when 0 then '4' || {_padded('o_orderkey * 7919 + 13', 15)} "
                f"when 1 then '51' || {_padded('o_orderkey * 104729', 14)} "
                f"when 2 then '37' || {_padded('o_orderkey * 7907', 13)} "
                f"when 3 then '6011' || {_padded('o_orderkey * 6007', 12)} "
                f"when 4 then '62' || {_padded('o_orderkey * 9973', 15)} "
                f"else '6759' || {_padded('o_orderkey * 1237', 9)} end as n",
            ],
            [
                "k",
                "case (k + 1) % 4 when 0 then n when 1 then "
                + _GROUPED.format(sep="' '")
                + " when 2 then "
                + _GROUPED.format(sep="'-'")
                + " else n || ' ' || n end as shown",
            ],
            ["k", "'paid by ' || shown || case when k % 5 = 0 then 'x' else '.' end as text"],
        ],
    ),
    "ssn_texts": (
        "orders",
        [
            ["o_orderkey as k", f"{_padded('o_orderkey * 48271 % 1000000000', 9)} as n"],
            [
                "k",
                "'member ' || case when k % 9 = 0 then '1' else '' end || "
                + _parts("n", (1, 3, "-"), (4, 2, "-"), (6, 4, ""))
                + " || case when k % 7 = 0 then '-2' else ' ok' end as text",
            ],
        ],
    ),
    # the same numbers in Arabic-Indic digits
    "ssn_other_texts": (
        "orders",
        [
            ["o_orderkey as k", f"{_padded('o_orderkey * 48271 % 1000000000', 9)} as n"],
            ["k", "n", "'member ' || translate(" + _parts("n", (1, 3, "-"), (4, 2, "-"), (6, 4, "")) + ", '0123456789', '٠١٢٣٤٥٦٧٨٩') as text"],
        ],
    ),
    "pem_texts": (
        "customer",
        [
            [
                "c_custkey as k",
                "'-----BEGIN ' || repeat('WORD ', c_custkey % 90) || case when c_custkey % 7 = 0 then ' ' else '' end"
                " || 'PRIVATE ' || 'KEY-----' as text",
            ]
        ],
    ),
    # of three tokens one follows a letter, one is too short
    "pat_texts": (
        "customer",
        [
            [
                "c_custkey as k",
                "case when c_custkey % 3 = 0 then 'keyx' else 'key ' end || 'github_' || 'pat_' || "
                "case when c_custkey % 3 = 1 then substr(md5(c_name), 1, 21) else md5(c_name) || '_' || md5(c_name) end || ' end' as text",
            ]
        ],
    ),
    "tld_texts": (
        "customer",
        [
            [
                "c_custkey as k",
                "'to u' || cast(c_custkey as string) || '@host.' || case c_custkey % 6 when 0 then 'com' when 1 then 'de' "
                "when 2 then 'io' when 3 then 'app' when 4 then 'nosuchzone' else 'zzzz' end as text",
            ]
        ],
    ),
    "sin_texts": (
        "orders",
        [
            ["o_orderkey as k", f"{_padded('o_orderkey * 48271 % 1000000000', 9)} as n"],
            [
                "k",
                "'SIN ' || "
                + _parts("n", (1, 3, ""))
                + " || case when k % 2 = 0 then '-' else ' ' end || substr(n, 4, 3)"
                + " || case when k % 4 < 2 then '-' else ' ' end || substr(n, 7, 3) || ';' as text",
            ],
        ],
    ),
    "nino_texts": (
        "customer",
        [
            ["c_custkey as k", f"{_padded('c_custkey * 7919 % 1000000', 6)} as n"],
            [
                "k",
                "'NI ' || substr('ABCEGHJKLMNOPRSTWXYZDFQU', 1 + cast(k % 24 as int), 1)"
                " || substr('ABGCKNTYZXHEDO', 1 + cast(k % 14 as int), 1)"
                " || case when k % 3 = 0 then ' ' else '' end || "
                "case when k % 3 = 0 then substr(n, 1, 2) || ' ' || substr(n, 3, 2) || ' ' || substr(n, 5, 2) || ' ' "
                "else n end || substr('ABCDE', 1 + cast(k % 5 as int), 1) || '.' as text",
            ],
        ],
    ),
    "inn_texts": (
        "orders",
        [
            [
                "o_orderkey as k",
                f"case when o_orderkey % 2 = 0 then {_padded('o_orderkey * 700001', 10)} "
                f"else {_padded('o_orderkey * 50000003', 12)} end as n",
            ],
            [
                "k",
                "case k % 4 when 0 then 'ИНН ' when 1 then 'tax ID: ' when 2 then 'No ' else 'inn ' || repeat('x', 60) || ' ' end"
                " || n || ' end' as text",
            ],
        ],
    ),
    "snils_texts": (
        "orders",
        [
            ["o_orderkey as k", f"{_padded('o_orderkey * 7919033 % 100000000000', 11)} as n"],
            [
                "k",
                "case k % 3 when 0 then 'n ' || "
                + _parts("n", (1, 3, "-"), (4, 3, "-"), (7, 3, " "), (10, 2, ""))
                + " when 1 then 'СНИЛС ' || n else 'no ' || n end as text",
            ],
        ],
    ),
    "pesel_texts": (
        "orders",
        [
            ["o_orderkey as k", f"{_padded('o_orderkey * 7919033 % 100000000000', 11)} as n"],
            ["k", "n || case when k % 3 = 0 then ' (none)' else ' is the Pesel' end as text"],
        ],
    ),
    "cpf_texts": (
        "orders",
        [
            ["o_orderkey as k", f"{_padded('o_orderkey * 7919033 % 100000000000', 11)} as n"],
            [
                "k",
                "case k % 3 when 0 then 'x ' || "
                + _parts("n", (1, 3, "."), (4, 3, "."), (7, 3, "-"), (10, 2, ""))
                + " when 1 then 'CPF ' || n else 'no ' || n end as text",
            ],
        ],
    ),
    "part_texts": (
        "part",
        [
            ["p_partkey as k", "p_name", f"{_padded('p_partkey * 7919 % 1000000', 6)} as n"],
            ["k", "p_name || case when k % 2 = 0 then ' part-id ' else ' ref ' end || 'PX-' || n || '!' as text"],
        ],
    ),
    # log lines of an application: one address and one client per line
    "log_lines": (
        "events",
        [
            ["event_id as k", "user_id as u", "event_type", "event_id % 7 as s"],
            [
                "k",
                "s",
                "event_type",
                "'user' || cast(u as string) || '@mail' || cast(k % 9 as string) || '.example.' || "
                "case when k % 11 = 0 then 'invalidtld' else 'com' end as mail",
                "cast(u * 37 % 300 as string) || '.' || cast(k % 256 as string) || '.' || "
                "cast(u % 100 as string) || '.' || cast(k * 7 % 256 as string) as ip",
            ],
            [
                "k",
                "s",
                "mail",
                "ip",
                "'event ' || event_type || ' signed in ' || mail || ' from ' || ip as text",
            ],
        ],
    ),
    # a log in which about one line in fifteen holds something
    "shipment_log": (
        "lineitem",
        [
            [
                "l_orderkey * 10 + l_linenumber as k",
                "'2024-05-01 10:20:30 INFO  worker handled order=' || cast(l_orderkey as string) || ' part=' || cast(l_partkey as string)"
                " || ' supplier=' || cast(l_suppkey as string) || ' flag=' || l_returnflag || "
                "case when l_orderkey % 15 = 0 then ' mail=ops' || cast(l_suppkey as string) || '@example.com' else ' status=completed' end as text",
            ],
        ],
    ),
    "ipv6_texts": (
        "events",
        [
            ["event_id as k", "hex(user_id + 1) as a", "hex(event_id % 65536 + 1) as b"],
            [
                "k",
                "a",
                "b",
                "case k % 6 when 0 then '2001:db8:' || a || '::' || b "
                "when 1 then 'fe80::' || a || ':' || b "
                "when 2 then '1:2:3:4:5:6:' || a || ':' || b "
                "when 3 then '1:2:3:4:5:6:7:' || a || ':' || b "
                "when 4 then '2a00:' || a || '::' || b || '::1' "
                "else '::' || a end as ip",
            ],
            ["k", "a", "b", "ip", "'peer [' || ip || '] up' as text"],
        ],
    ),
    "key_texts": (
        "customer",
        [
            ["c_custkey as k", "upper(md5(c_name)) as h", "md5(c_name || 'x') as l"],
            ["k", "h", "l", "replace(replace(h, '0', 'G'), '1', 'H') || l as long"],
            [
                "k",
                "case k % 6 when 0 then 'AKIA' || substr(h, 1, 16) when 1 then 'ghp_' || substr(long, 1, 36) "
                "when 2 then 'xoxb-' || substr(l, 1, 12) || '-' || substr(h, 1, 10) when 3 then 'sk_' || 'live_' || substr(long, 1, 24) "
                "when 4 then 'AIza' || substr(long, 1, 35) else 'eyJ' || h || '.eyJ' || l || '.' || long end as secret",
            ],
            ["k", "secret", "'key: ' || secret || ' end' as text"],
        ],
    ),
    # tokens around the limits of the entropy rule
    "token_texts": (
        "customer",
        [
            ["c_custkey as k", "upper(md5(c_name)) as h", "md5(c_name || 'x') as l"],
            [
                "k",
                "case k % 7 when 0 then l when 1 then 'Zz' || substr(h, 1, 20) || 'pqrstuvwxyz' || substr(l, 1, 8) "
                "when 2 then 'my-long-name-' || substr(l, 1, 2) || '-2024' when 3 then 'getUserAccountDetails' || cast(k as string) "
                "when 4 then 'aaaaaaaaaaaaaaaaaaaa' || cast(k as string) "
                "when 5 then substr(h, 1, 10) || 'qrstuvwxyz/' || substr(l, 1, 10) || 'KLMNOPRS+' || '==' "
                "else 'q' || h || 'mnopqrstuvw_' || l end as token",
            ],
            ["k", "token", "'secret=\"' || token || '\"' as text"],
        ],
    ),
    # fifteen digits that read as a phone number, and now and then as a card too
    "overlap_texts": (
        "orders",
        [
            ["o_orderkey as k", f"'37' || {_padded('o_orderkey * 7907', 13)} as n"],
            ["k", "n", "'user u' || cast(k as string) || '@example.com call +' || n || ' or 10.0.0.' || cast(k % 400 as string) as text"],
        ],
    ),
    # people with an address, a card and an SSN in one sentence
    "profile_texts": (
        "customer",
        [
            [
                "c_custkey as k",
                "'u' || cast(c_custkey as string) || '.x@example.com' as mail",
                f"'123-45-' || {_padded('c_custkey % 9999 + 1', 4)} as ssn",
            ],
            [
                "k",
                "mail",
                "ssn",
                "'user ' || mail || ' paid with 4111 1111 1111 1111 (ssn ' || ssn || ')' as text",
            ],
        ],
    ),
    # urls as object keys with an extension and a size
    "key_listing": (
        "pages",
        [
            [
                "page_id",
                "replace(replace(url, 'https://', ''), 'http://', '') as path",
                "page_id % 7 as s",
                "length(html) as size",
            ],
            [
                "path || '/p' || cast(page_id as string) || case s when 0 then '.txt' when 1 then '.CSV' when 2 then '.min.json' "
                "when 3 then '.png' when 4 then '' when 5 then '.log' else '/index.sql' end as relative",
                "cast(size as bigint) as size",
            ],
        ],
    ),
}


def derived(spark: SparkSession, sf_dir: str, name: str, dealt: bool = False) -> DataFrame:
    """The rows of a derived text; ``dealt`` ones come in tasks of bounded size."""
    base, stages = DERIVED[name]
    if base in DERIVED:
        rows = derived(spark, sf_dir, base, dealt)
    else:
        rows = table(spark, sf_dir, base)
        rows = spread_rows(rows) if dealt else rows  # before the texts are made, which are longer
    for stage in stages:
        rows = rows.selectExpr(*stage)
    return rows


def derived_sql(name: str) -> str:
    base, stages = DERIVED[name]
    query = f"({derived_sql(base)})" if base in DERIVED else base
    for stage in stages:
        query = f"(select {', '.join(stage)} from {query})"
    return query[1:-1]


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ``documents``, one source per document."""
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lines_of(rows, "text", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")))


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "pages").select("page_id", "html"))
    return lines_of(rows, "html", F.concat(F.lit("page/"), F.col("page_id").cast("string")))


def derived_units(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived text per row as units; the row key is the source."""
    rows = derived(spark, sf_dir, name, dealt=True).select("k", "text")
    return lines_of(rows, "text", F.col("k").cast("string"), name)
