"""N-gram Jaccard join (6): multiple-global-order filtering.

1. Each text becomes its set of distinct word shingles (64-bit hashes).  Equal sets are one
   *node* (a 64-bit hash of the set), so copies are never joined with each other.  The same
   pass counts shingles in a sketch of bounded size.
2. Two sets of the wanted similarity share a token among the first ``n - ceil(t n) + 1`` of
   each under any global order.  Order A, rare shingles first by the sketch, gives the
   postings that are joined.  Orders B and C, ascending and descending hash, must agree
   before a pair is verified on whole sets.
3. Pairs are never listed within a group that is already one component: two rounds compare
   the members of a posting list with a few hubs each, a last round compares what is still in
   different components.  Components are then exact.

Null or blank texts have an empty set and are linked with nothing.  Rows without an id get
the component of rows with an equal set, or null.  Rows that share an id are judged each
for itself.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, rolled, sliced, small_side, split_words, texts_of, unused, written
from .components import components

_SLICE = 16  # log2 of the counters in one slice of the sketch


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Per text the sorted hashes of its distinct shingles (ASCII lower case, ASCII white space)."""
    starts, codes, vocabulary = split_words(pc.ascii_lower(texts))
    known = np.fromiter(
        map(xxhash.xxh3_64_intdigest, vocabulary.cast(pa.binary()).to_pylist()), np.uint64, len(vocabulary)
    )
    words = known[codes]
    runs = rolled(words, width)
    out = []
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if hi - lo >= width:
            out.append(np.unique(runs[lo : hi - width + 1]))
        elif hi > lo:
            out.append(rolled(words[lo:hi], hi - lo))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _node(tokens: np.ndarray) -> int:
    value = xxhash.xxh3_64_intdigest(tokens.tobytes())
    return value - (1 << 64) if value >> 63 else value


def _prefix(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _profiles(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """A row per document (id, node, set size), and rows with each task's counters."""
    names = ["doc_id", "node", "n", "slice", "counts"]

    def run(batches):
        counters = np.zeros(1 << bits, np.uint32)
        for batch in sliced(batches, 1 << 22):
            sets = shingle_sets(texts_of(batch), width)
            if sets:
                np.add.at(counters, (np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), 1)
            empty = pa.nulls(len(sets))
            yield pa.record_batch(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([_node(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    empty.cast(pa.int32()),
                    empty.cast(pa.binary()),
                ],
                names,
            )
        none = pa.nulls(1, pa.int64())
        for k, part in enumerate(np.split(counters, 1 << (bits - _SLICE))):
            if part.any():
                packed = np.minimum(part, 65535).astype("<u2").tobytes()
                yield pa.record_batch([none, none, none, pa.array([k], pa.int32()), pa.array([packed], pa.binary())], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, node long, n long, slice int, counts binary"
    )


def _sketch(profiles: DataFrame, bits: int) -> np.ndarray:
    """Per counter a 16-bit logarithm of its sum over all tasks; its size never depends on the rows."""

    def fold(batches):
        current, total = None, None
        row = lambda: pa.record_batch(
            [pa.array([current], pa.int32()), pa.array([(np.log2(total + 1.0) * 1000).astype("<u2").tobytes()], pa.binary())],
            ["slice", "ranks"],
        )
        for batch in batches:
            for at, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                if at != current:
                    if current is not None:
                        yield row()
                    current, total = at, np.zeros(1 << _SLICE, np.int64)
                total += np.frombuffer(counts, "<u2")
        if current is not None:
            yield row()

    counts = profiles.where("slice is not null").select("slice", "counts")
    ranks = np.zeros((1 << (bits - _SLICE), 1 << _SLICE), np.uint16)
    folded = counts.repartition("slice").sortWithinPartitions("slice").mapInArrow(fold, "slice int, ranks binary")
    for r in folded.toLocalIterator():
        ranks[r["slice"]] = np.frombuffer(r["ranks"], "<u2")
    return ranks.reshape(-1)


def _sets(docs: DataFrame, width: int, make, schema: str) -> DataFrame:
    """``make(sets)``, record batches from the shingle sets of the rows."""

    def run(batches):
        for batch in sliced(batches, 1 << 22):
            yield make([s for s in shingle_sets(texts_of(batch), width) if len(s)])

    return docs.select("text").mapInArrow(run, schema)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    values = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))


def _postings(docs: DataFrame, width: int, percent: int, ranks, bits: int) -> DataFrame:
    """``token, node, n, pos`` of every prefix token under order A."""

    def make(sets):
        heads = []
        for tokens in sets:
            rank = ranks.value[(tokens >> np.uint64(64 - bits)).astype(np.int64)]
            heads.append(tokens[np.lexsort((mixed(tokens), rank))[: _prefix(len(tokens), percent)]])
        columns = [pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), _lists(heads)]
        return pa.record_batch(columns, ["node", "n", "head"])

    rows = _sets(docs, width, make, "node long, n int, head array<long>")
    return rows.select("node", "n", F.posexplode("head").alias("pos", "token")).select("token", "node", "n", "pos")


def _whole_sets(docs: DataFrame, width: int) -> DataFrame:
    """``node, tokens``, the tokens in ascending order."""

    def make(sets):
        ordered = [np.sort(s.view(np.int64)) for s in sets]
        return pa.record_batch([pa.array([_node(s) for s in sets], pa.int64()), _lists(ordered)], ["node", "tokens"])

    return _sets(docs, width, make, "node long, tokens array<long>")


def _possible(percent: int) -> str:
    """Length and position filters of two postings x and y: the first token that a pair of the
    wanted similarity shares leaves room for the overlap it needs."""
    return (
        f"least(x.n, y.n) * 100 >= {percent} * greatest(x.n, y.n) and "
        f"{100 + percent} * least(x.n - x.pos, y.n - y.pos) >= {percent} * (x.n + y.n)"
    )


def _pairs(x: DataFrame, y: DataFrame, percent: int, more: str) -> DataFrame:
    found = x.alias("x").join(y.alias("y"), F.expr(f"x.token = y.token and {more} and {_possible(percent)}"))
    return found.select(F.expr("least(x.node, y.node) as a"), F.expr("greatest(x.node, y.node) as b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that share prefix tokens under orders B and C, and whose whole sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("s"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("t"))
    head = lambda c: f"size({c}) - ({percent} * size({c}) + 99) div 100 + 1"
    both = pairs.join(left, "a").join(right, "b")
    both = both.where(
        f"arrays_overlap(slice(s, 1, int({head('s')})), slice(t, 1, int({head('t')})))"
        f" and arrays_overlap(slice(s, -int({head('s')}), int({head('s')})), slice(t, -int({head('t')}), int({head('t')})))"
    )
    shared = both.select("a", "b", F.expr("size(s) + size(t) as total"), F.size(F.array_intersect("s", "t")).alias("both"))
    return shared.where(f"both * {100 + percent} >= {percent} * total").select("a", "b")


def jaccard_components(
    docs: DataFrame, width: int = 5, percent: int = 80, hub_rounds: int = 2, hubs: int = 4, most_broadcast: int = 2_000_000
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``: sets of ``width`` words
    linked when ``100 * intersection >= percent * union``; the component is named by its least id.

    Ids of the rows to read again are broadcast while at most ``most_broadcast``, else joined.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(26, max(_SLICE, math.ceil(math.log2(1 + chars / 256))))
    profiles = written(_profiles(docs, width, bits), "jaccard-profiles")
    rows = profiles.where("slice is null").select("doc_id", "node", "n")
    ranks = spark.sparkContext.broadcast(_sketch(profiles, bits))

    classes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"))
    classes = written(classes, "jaccard-classes")

    def texts_with(ids: DataFrame, name: str) -> DataFrame:
        ids = written(ids.select(F.col("first_id").alias("_id")).distinct(), name)
        own = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
        return own.join(small_side(ids, ids.count(), most_broadcast), "_id", "left_semi")

    first = texts_with(classes.where("first_id is not null"), "jaccard-ids")
    postings = written(_postings(first, width, percent, ranks, bits), "jaccard-heads")  # else made for each side
    ends = postings.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    shared = postings.join(ends.where("lo <> hi").select("token"), "token", "left_semi")
    shared = written(shared, "jaccard-postings")

    def sets_of(pairs: DataFrame) -> DataFrame:
        """Whole sets of the nodes of ``pairs`` alone, read again from the texts."""
        nodes = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "jaccard-nodes")
        ids = classes.join(small_side(nodes, nodes.count(), most_broadcast), "node", "left_semi")
        sets = written(_whole_sets(texts_with(ids, "jaccard-ids"), width), "jaccard-sets")
        # rows that share an id may give a set twice
        return sets if sets.count() == nodes.count() else sets.dropDuplicates(["node"])

    links, comp = None, None
    for step in range(hub_rounds + 1):
        now = shared.withColumn("comp", F.col("node"))
        if comp is not None:
            known = comp.withColumnRenamed("comp", "known")
            now = shared.join(known, "node", "left").withColumn("comp", F.coalesce("known", "node")).drop("known")
        if step:
            now = written(now, "jaccard-round")
        ends = F.min("comp").alias("lo"), F.max("comp").alias("hi")
        if step < hub_rounds:
            # the member with the fewest rarer tokens is the likeliest centre; others go by lot
            member = F.struct("node", "n", "pos", "comp")
            turns = [F.struct("pos", F.xxhash64("node", F.lit(step)))]
            turns += [F.struct(F.lit(0), F.xxhash64("node", F.lit(step), F.lit(k))) for k in range(1, hubs)]
            chosen = F.array_distinct(F.array(*[F.min(F.struct(t.alias("turn"), member.alias("m")))["m"] for t in turns]))
            lists = now.groupBy("token").agg(*ends, chosen.alias("hubs")).where("lo <> hi")
            centres = lists.select("token", F.explode("hubs").alias("h")).select("token", "h.*")
            pairs = _pairs(now, centres, percent, "x.comp <> y.comp")
        else:
            rest = now.join(now.groupBy("token").agg(*ends).where("lo <> hi").select("token"), "token", "left_semi")
            pairs = _pairs(rest, rest, percent, "x.node < y.node and x.comp <> y.comp")
        pairs = written(pairs, "jaccard-pairs")
        found = written(_verified(pairs, sets_of(pairs), percent), "jaccard-links")
        links = found if links is None else links.union(found)
        comp = components(links)

    named = classes.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = written(named, "jaccard-named")
    least = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    of_node = named.join(least, "comp").select("node", "component_id")
    out = rows.join(of_node, "node", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, most_broadcast: int = 2_000_000) -> DataFrame:
    """``docs`` with one document, the least id, of each component.

    Rows that share an id are one document, which goes if none of its rows is to stay; equal
    rows of it (id and text) become one.  Rows without an id stay.
    """
    found = jaccard_components(docs, width, percent)
    stays = F.max((F.col("component_id") == F.col("doc_id")) | (F.col("n_shingles") == 0))
    name = unused(docs, "id")
    per = found.where("doc_id is not null").groupBy(F.col("doc_id").alias(name)).agg(F.count("*").alias("rows"), stays.alias("stays"))
    per = written(per.where("not stays or rows > 1"), "jaccard-decided")
    gone, again = per.where("not stays").select(name), per.where("stays").select(name)
    own = F.col("doc_id").cast("long") == F.col(name)
    kept = docs.join(small_side(gone, gone.count(), most_broadcast), own, "left_anti")
    repeated = again.count()
    if not repeated:
        return kept
    again = small_side(again, repeated, most_broadcast)
    return kept.join(again, own, "left_anti").union(kept.join(again, own, "left_semi").dropDuplicates(["doc_id", "text"]))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose 4-word shingle sets are at least 85 % alike."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=85)


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words
), tokens AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM tokens x JOIN tokens y ON x.t = y.t AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id FROM sets s JOIN least l ON s.doc_id = l.a
"""
