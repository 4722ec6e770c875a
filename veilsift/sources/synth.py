"""Synthetic people and logs for trials of any size.

Every value is an expression over an integer key: the same key gives the same
person on any cluster, and nothing passes through the driver.  Addresses use
reserved domains, phone numbers the fictional 555-01xx range, IP addresses the
private 10/8 block, and cards and SSNs only satisfy the format rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import let

# The parts names and cards are made of.
FIRST = "Ada Ben Cleo Dan Eva Finn Gus Hana Ivo June".split()
LAST = "Archer Baker Cooper Dyer Fisher Mason Porter Smith Turner Weaver".split()
DOMAINS = "example.com example.net example.org".split()
PREFIXES = ("4", "51", "34", "6011", "36", "62")
LENGTHS = (16, 16, 15, 16, 14, 17)


def _mixed(key: Column, salt: int, size: int) -> Column:
    """A number below ``size`` that looks unrelated to the key, from plain arithmetic
    that any engine repeats."""
    scrambled = (key % 1000003) * (7919 + 104 * salt) + (key % 9973) * (salt + 31) * 17 + salt * 101
    return (scrambled % size).cast("bigint")


def _pick(key: Column, salt: int, values) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), _mixed(key, salt, len(values)).cast("int"))


def _digits(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def with_check_digit(body: Column) -> Column:
    """A number completed by its Luhn check digit."""
    return let(
        body,
        """body -> concat(body, cast((10 - aggregate(sequence(1, length(body)), 0, (total, i) -> total +
            if((length(body) - i) % 2 = 0,
               int(int(substr(body, i, 1)) * 2 div 10) + int(substr(body, i, 1)) * 2 % 10,
               int(substr(body, i, 1)))) % 10) % 10 as string))""",
    )


def people(keys: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """id, full_name, email, phone, ssn, card_number, ip per key."""
    k = F.col("id") + F.lit(seed).cast("bigint") * 1000
    first, last = _pick(k, 1, FIRST), _pick(k, 2, LAST)
    kind = _mixed(k, 5, len(PREFIXES)).cast("int")
    prefix = F.get(F.array(*[F.lit(p) for p in PREFIXES]), kind)
    length = F.get(F.array(*[F.lit(n) for n in LENGTHS]), kind)
    filler = F.concat(_digits(_mixed(k, 6, 10000000), 7), _digits(_mixed(k, 7, 10000000), 7))
    body = F.concat(prefix, F.substring(filler, F.lit(1), length - 1 - F.length(prefix)))
    ssn = F.concat_ws(
        "-",
        _digits(_mixed(k, 8, 600) + 1, 3),
        _digits(_mixed(k, 9, 99) + 1, 2),
        _digits(_mixed(k, 10, 9999) + 1, 4),
    )
    octets = [_mixed(k, 11 + i, 250) + 1 for i in range(3)]
    return keys.select(F.col(key).cast("bigint").alias("id")).select(
        "id",
        F.concat_ws(" ", first, last).alias("full_name"),
        F.concat(
            F.lower(first), F.lit("."), F.lower(last), F.col("id").cast("string"), F.lit("@"), _pick(k, 3, DOMAINS)
        ).alias("email"),
        F.concat(
            F.lit("+1 ("), _digits(_mixed(k, 4, 789) + 200, 3), F.lit(") 555-"), _digits(_mixed(k, 14, 100) + 100, 4)
        ).alias("phone"),
        ssn.alias("ssn"),
        with_check_digit(body).alias("card_number"),
        F.concat_ws(".", F.lit("10"), *[o.cast("string") for o in octets]).alias("ip"),
    )


def written_card(number: Column, style: Column) -> Column:
    """A 16-digit card plain, spaced or dashed."""
    blocks = [F.substring(number, at, 4) for at in (1, 5, 9, 13)]
    grouped = F.when(style == 1, F.concat_ws(" ", *blocks)).when(style == 2, F.concat_ws("-", *blocks))
    return F.when(F.length(number) == 16, F.coalesce(grouped, number)).otherwise(number)


def log_lines(rows: DataFrame) -> DataFrame:
    """An event log: sessions, and on every fourth and fifth person a charge or a parcel
    whose tracking number is no card."""
    stamp = F.concat(F.lit("["), _digits(F.col("id") % 100000, 5), F.lit("] "))
    text = (
        F.when(F.col("id") % 4 == 0, F.concat(stamp, F.lit("till accepted "), F.col("card_number")))
        .when(F.col("id") % 5 == 0, F.concat(stamp, F.lit("parcel 9"), _digits(_mixed(F.col("id"), 20, 10**7), 15), F.lit(" left")))
        .otherwise(F.concat(stamp, F.lit("session of "), F.col("email"), F.lit(" at "), F.col("ip")))
    )
    return rows.select("id", text.alias("text"))


def csv_rows(rows: DataFrame) -> DataFrame:
    """Columns of a customer export, cards written in three ways."""
    return rows.select(
        "id",
        "full_name",
        "email",
        "phone",
        "ssn",
        written_card(F.col("card_number"), F.col("id") % 3).alias("card_number"),
        F.col("ip").alias("last_ip"),
    )


def notes(rows: DataFrame) -> DataFrame:
    """Reception notes: two lines per person."""
    visit = F.concat(
        F.col("full_name"), F.lit(" rang from "), F.col("phone"), F.lit(", writes as "), F.col("email"),
        F.lit(", pays with "), written_card(F.col("card_number"), F.lit(1)),
    )
    badge = F.concat(F.lit("Badge printed against number "), "ssn")
    return rows.select("id", F.explode(F.array(visit, badge)).alias("text"))


#: Lines whose numbers and signs satisfy no detector.
CLEAN = (
    "Pallet 4000000000000000 is one short of a checksum\n"
    "Sensor 20310704112233 sent 1999999999999 ticks\n"
    "Sprite hero@3x.gif, account root@box.nosuchzone\n"
    "Firmware 7.8.9 built from 0f1e2d3c4b5a69788796a5b4c3d2e1f00f1e2d3c\n"
    "Locker 000-45-6789 beside locker 666-12-3456\n"
)


def documents_of(rows: DataFrame) -> DataFrame:
    """A nested JSON document per person."""
    contact = F.struct("email", "phone", F.struct(F.col("ip").alias("last")).alias("seen"))
    payment = F.struct(F.col("card_number").alias("number"), F.array("ssn").alias("papers"))
    return rows.select("id", F.to_json(F.struct("id", contact.alias("contact"), payment.alias("payment"))).alias("text"))


def dump_lines(rows: DataFrame) -> DataFrame:
    """A SQL dump: an insert statement per person."""
    values = F.concat_ws("', '", "full_name", "email", "ssn", "card_number")
    return rows.select("id", F.concat(F.lit("INSERT INTO visitors VALUES ('"), values, F.lit("');")).alias("text"))


def key_lines(rows: DataFrame) -> DataFrame:
    """A settings file with a provider key or a random token per person."""
    noise = F.translate(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256))), "+/=", "xyz")
    cloud = F.concat(F.lit("AK"), F.lit("IA"), F.upper(F.substring(F.md5(F.col("id").cast("string")), 1, 16)))
    forge = F.concat(F.lit("gh"), F.lit("p_"), F.substring(noise, 1, 36))
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("cloud = "), cloud)).otherwise(F.concat(F.lit("forge = "), forge))
    return rows.select("id", text.alias("text"))


def write_corpus(spark: SparkSession, path: str, rows: int, parts: int = 8, seed: int = 0) -> None:
    """A small data lake below ``path``: logs, notes, JSON, a SQL dump, keys, a CSV export and four tables."""
    persons = people(spark.range(0, rows, 1, parts), "id", seed)
    log_lines(persons).select("text").write.mode("overwrite").text(f"{path}/logs")
    notes(persons).select("text").write.mode("overwrite").text(f"{path}/notes")
    documents_of(persons).select("text").write.mode("overwrite").text(f"{path}/documents")
    dump_lines(persons).select("text").write.mode("overwrite").text(f"{path}/dump")
    key_lines(persons).select("text").write.mode("overwrite").text(f"{path}/keys")
    csv_rows(persons).write.mode("overwrite").option("header", True).csv(f"{path}/customers")
    clean = spark.createDataFrame([(line,) for line in CLEAN.splitlines()], "text string")
    clean.coalesce(1).write.mode("overwrite").text(f"{path}/clean")
    for name, frame in corpus_tables(persons).items():
        frame.write.mode("overwrite").parquet(f"{path}/tables/{name}")


def corpus_tables(persons: DataFrame) -> dict[str, DataFrame]:
    """users, orders, support_tickets and audit_log of the synthetic people."""
    h = F.md5(F.col("id").cast("string"))
    ticket = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    ship = F.concat("full_name", F.lit(" waits for the van, "), "phone")
    return {
        "users": persons.select("id", "full_name", "email", "phone", "ssn", "card_number"),
        "orders": persons.select(
            "id", F.col("id").alias("user_id"), ship.alias("notes"), F.col("ip").alias("shipping_ip")
        ),
        "support_tickets": persons.select(
            ticket.alias("ticket_id"),
            F.concat(F.lit("bank refused "), "card_number").alias("body"),
            F.to_json(F.struct(F.col("email").alias("contact"))).alias("metadata"),
        ),
        "audit_log": persons.select("id", F.concat(F.lit("opened by "), "email").alias("action"), F.col("ip").alias("actor_ip")),
    }
