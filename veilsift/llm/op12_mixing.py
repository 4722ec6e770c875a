"""Mixing sources to target weights (12): pivotal dependent rounding over a reduction tree.

A source's target over its size is the expected number of copies of each of its documents, at most 3.
The whole part of that number is taken, the fraction is a probability that is rounded dependently:
documents meet in pairs, the mass (probability times words) of one moves to the other at random, without
change of either mean, until one of the two is 0 or 1 and settled; the other goes on to the next pair.

Pairs form a tree: documents of a source are dealt by hash into groups of about ``fan``, a fold pairs
off each group and leaves one residual, residuals meet in groups of the next level, until one is left.
Settled documents never move again.  No sum of words changes on the way.

The last residual of a source has no partner of its size.  So long documents go first, in tiers: the
residual of a tier is rounded by its probability and its mass moves to or from all shorter documents at
once, whose probabilities shift alike.  What the shortest tier leaves is the only error of a source,
some words, where a source has enough shorter documents (no probability leaves 0 to 1).

All of it is DataFrame operations; chance is a hash of ``seed`` and the pair, so reruns and other
partitionings agree.  Rows that are alike in id, source and size are one unit of that many documents, so
they are counted before they move, and its copies are spread over them.  Null text has no words; documents
without words are not taken.  Null sources are one source, the last.  Extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilsift.functions.spans import let, record
from veilsift.plans.ordinals import numbered

from .common import small_side, written

WORD = r"[^\x20\x09-\x0D]+"
_NEAR = 1e-9  # a probability as near as this to 0 or 1 is settled


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources in order; ``most`` copies of a document; ``tiers``: least words of
    each tier but the last; ``fan``: documents of a group; ``seed`` of chance; ``spread``: identical documents
    listed by one row at most; sources broadcast while at most ``most_broadcast``."""

    weights: tuple[int, ...] = (1, 2, 3)
    most: int = 3
    tiers: tuple[int, ...] = (8192, 2048, 512, 128, 32)
    fan: int = 64
    seed: int = 12
    spread: int = 4096
    most_broadcast: int = 1_000_000


# ---------------------------------------------------------------- the targets


def targets(sizes: DataFrame, how: Mix = Mix()) -> DataFrame:
    """``source, source_size, target`` from ``sizes (source, source_size)``, one row a source.

    Targets are least(most * size, weight * level); the level that shares all words is found by
    passes over the sources, each of which settles those above their limit.
    """
    ranked = numbered(sizes, F.col("source").asc_nulls_last(), number="rank")
    weights = F.array(*map(F.lit, how.weights))
    weight = F.get(weights, F.pmod(F.col("rank") - 1, F.lit(len(how.weights))).cast("int"))
    limit = F.col("source_size") * how.most
    rows = written(ranked.select("source", "source_size", weight.alias("weight"), limit.alias("limit")), "mix-sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, settled = 0.0, -1
    while True:
        above = F.col("limit") <= F.col("weight") * F.lit(level)
        row = rows.agg(
            F.sum(F.when(above, F.col("limit"))), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, 1))
        ).first()
        if not row[1] or row[2] == settled:
            break
        settled = row[2]
        level = (total - (row[0] or 0)) / row[1]
    target = F.least(F.col("limit").cast("double"), F.col("weight") * F.lit(level))
    return rows.select("source", "source_size", target.alias("target"))


# ----------------------------------------------------------- one step of chance


def _chance(how: Mix, *parts: Column) -> Column:
    """A number from 0 to 1 that depends on ``parts`` alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(how.seed), *parts), 11) / float(1 << 53)


def _paired(a: Column, b: Column, luck: Column) -> Column:
    """``a`` and ``b`` (with size w and probability p) after mass moved: struct<settled, open>.

    Up: a gains until it is 1 or b is 0; down: a loses until it is 0 or b is 1.
    """

    def step(m: Column) -> Column:
        w = m["a"]["w"] / m["b"]["w"]
        up = F.least(1 - m["a"]["p"], m["b"]["p"] / w)
        down = F.least(m["a"]["p"], (1 - m["b"]["p"]) / w)
        rises = m["luck"] * (up + down) < down
        first = F.when(rises, 1 - m["a"]["p"] <= m["b"]["p"] / w).otherwise(m["a"]["p"] <= (1 - m["b"]["p"]) / w)
        a_to = F.when(first, F.when(rises, 1.0).otherwise(0.0)).otherwise(F.when(rises, m["a"]["p"] + up).otherwise(m["a"]["p"] - down))
        b_to = F.when(first, F.when(rises, m["b"]["p"] - up * w).otherwise(m["b"]["p"] + down * w)).otherwise(
            F.when(rises, 0.0).otherwise(1.0)
        )
        a_now, b_now = _with(m["a"], a_to), _with(m["b"], b_to)
        return record(settled=F.when(first, a_now).otherwise(b_now), open=F.when(first, b_now).otherwise(a_now))

    return let(record(a=a, b=b, luck=luck), step)


_UNIT = ("at", "doc_id", "w", "n", "base", "p")


def _with(unit: Column, p: Column) -> Column:
    return record(**{f: p if f == "p" else unit[f] for f in _UNIT})


def _folded(units: Column, how: Mix) -> Column:
    """struct<settled: array, open> of the units of a group, paired off in their order."""
    first = record(settled=F.slice(units, 1, 0), open=units[0])

    def step(acc: Column, b: Column) -> Column:
        luck = _chance(how, acc["open"]["at"], acc["open"]["w"], b["at"], b["w"])
        pair = _paired(acc["open"], b, luck)
        return let(pair, lambda x: record(settled=F.concat(acc["settled"], F.array(x["settled"])), open=x["open"]))

    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))), first, step)


# --------------------------------------------------------------------- the tree


def _tree(units: DataFrame, groups: int, how: Mix) -> tuple[list[DataFrame], DataFrame]:
    """Settled units of every level, and the last residual of each source.

    ``units``: source, grp and a struct ``u`` of ``_UNIT``; ``groups``: most groups of a source.
    """
    settled = []
    while True:
        rows = units.groupBy("source", "grp").agg(F.array_sort(F.collect_list("u")).alias("us"))
        rows = written(rows.select("source", "grp", _folded(F.col("us"), how).alias("f")), "mix-level")
        settled.append(rows.select("source", F.explode("f.settled").alias("u")))
        units = rows.select("source", F.floor(F.col("grp") / how.fan).cast("long").alias("grp"), F.col("f.open").alias("u"))
        if groups <= 1:
            return settled, units.select("source", "u")
        groups = -(-groups // how.fan)


def _sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, n``: rows that are alike, counted."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))


def mix(docs: DataFrame, how: Mix = Mix()) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies``: one row for each row of ``docs``."""
    units = written(_sized(docs), "mix-units")
    wanted = written(targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), how), "mix-targets")
    sources = wanted.count()

    def of_source(rows: DataFrame, side: DataFrame) -> DataFrame:
        side = side.withColumnRenamed("source", "of")
        return rows.join(small_side(side, sources, how.most_broadcast), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")

    rate = F.when(F.col("size") > 0, F.col("n") * F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = of_source(units, wanted.select("source", "source_size", "target")).withColumn("rate", rate)
    base = F.floor(F.col("rate") + _NEAR)
    rows = rows.select("source", "doc_id", "size", "n", base.alias("base"), (F.col("rate") - base).alias("p"))
    fraction = F.col("p") > _NEAR
    tier = reduce(lambda c, i: F.when(F.col("size") >= how.tiers[i], i).otherwise(c), reversed(range(len(how.tiers))), F.lit(len(how.tiers)))
    tier = F.when(fraction, tier).otherwise(-1)
    at = F.xxhash64(F.lit(how.seed), "doc_id", "size")
    unit = record(
        at=at, doc_id=F.col("doc_id"), w=F.col("size").cast("double"), n=F.col("n"), base=F.col("base"),
        p=F.when(fraction, F.col("p")).otherwise(0.0),
    )
    rows = written(rows.select("source", tier.alias("tier"), unit.alias("u")), "mix-fractions")
    # what each source has in each tier, and in all shorter ones
    held = rows.where("tier >= 0").groupBy("source", "tier").agg(F.count("*").alias("units"), F.sum("u.w").alias("words"))
    held = written(held, "mix-tiers")
    most_units = {r["tier"]: r["m"] for r in held.groupBy("tier").agg(F.max("units").alias("m")).collect()}

    out = [rows.where("tier < 0").select("source", "u")]
    shifts: DataFrame | None = None  # source, shift: what shorter documents gain in probability
    for k in sorted(most_units):
        groups = F.col("units") / how.fan
        own = of_source(rows.where(F.col("tier") == k), held.where(F.col("tier") == k).select("source", "units"))
        grp = F.pmod(F.shiftrightunsigned("u.at", 1), F.ceil(groups)).cast("long")
        own = own.select("source", grp.alias("grp"), "u")
        if shifts is not None:
            own = of_source(own, shifts)
            p = F.least(F.greatest(F.col("u.p") + F.coalesce("shift", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
            p = F.when(p < _NEAR, 0.0).when(p > 1 - _NEAR, 1.0).otherwise(p)
            own = written(own.select("source", "grp", _with(F.col("u"), p).alias("u")), "mix-shifted")
            out.append(own.where("u.p = 0 or u.p = 1").select("source", "u"))
            own = own.where("u.p > 0 and u.p < 1")
        settled, last = _tree(own, -(-most_units[k] // how.fan), how)
        taken = F.when(_chance(how, F.lit(k), F.col("u.at"), F.col("u.w")) < F.col("u.p"), 1.0).otherwise(0.0)
        last = written(last.select("source", "u", taken.alias("x")), "mix-last")
        out += [*settled, last.select("source", _with(F.col("u"), F.col("x")).alias("u"))]
        shorter = held.where(F.col("tier") > k).groupBy("source").agg(F.sum("words").alias("words"))
        change = last.select("source", ((F.col("u.p") - F.col("x")) * F.col("u.w")).alias("mass"))
        step = of_source(change, shorter).select("source", (F.col("mass") / F.col("words")).alias("shift"))
        step = step.where("shift is not null")
        before = shifts if shifts is not None else step.where("false")
        shifts = written(before.unionByName(step).groupBy("source").agg(F.sum("shift").alias("shift")), "mix-shifts")

    every = reduce(DataFrame.unionByName, out)
    return of_source(_spread(every, how), wanted.select("source", "source_size", "target")).select(
        "doc_id", "source", "size", "source_size", "target", "copies"
    )


def _spread(every: DataFrame, how: Mix) -> DataFrame:
    """One row for each document of a unit; its copies are dealt evenly."""
    total = (F.col("u.base") + F.col("u.p")).cast("long").alias("total")
    rows = every.select("source", "u.doc_id", F.col("u.w").cast("long").alias("size"), F.col("u.n").alias("n"), total)
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / how.spread))).alias("chunk")
    rows = rows.select("source", "doc_id", "size", "n", "total", chunk)
    first = F.col("chunk") * how.spread
    each = F.explode(F.sequence(first, F.least(first + how.spread, F.col("n")) - 1)).alias("i")
    rows = rows.select("source", "doc_id", "size", "n", "total", each)
    copies = F.expr("total div n") + F.when(F.col("i") < F.col("total") % F.col("n"), 1).otherwise(0)
    return rows.select("source", "doc_id", "size", copies.cast("long").alias("copies"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
