"""Vector code compression (13): product codes, their nearest entries found by equal-average search.

A vector's components become integers floor(256 x), the vector is cut into 16 parts, each part
position has a codebook of up to 64 entries.  Codebooks start as the parts of the first kept rows and
are improved by rounds of assignment and componentwise floor(mean).

Nearest entries are found among entries sorted by component sum: from the place of a part's own sum the
search goes outwards, the closer sum first, until the squared gap of sums over the dimension strictly
exceeds the best distance.  By Cauchy-Schwarz no entry beyond can be as near; ties go to the lower index.

Codebooks (64 x dimension integers) travel with the tasks; tasks add up their parts per entry, and only
these sums shuffle, so no row moves and no group is gathered.

A row takes part unless its vector is null or holds a null or non-finite component.  Rows are ordered by
``vec_id`` (null last), then by vector; repeated rows count each.  Vectors shorter than the longest, and a
length that 16 does not divide, are filled with zeros at the end; an empty vector is all zeros.  Integers
beyond ``most(dimension)`` (2^24 for 64 components) are set to that bound, so that every distance fits
a long.  Extra columns are ignored, an empty table gives no rows and empty codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, small_side, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256


def most(dimension: int) -> int:
    """Largest integer of a component: squared sums over a vector of it stay within 2^62."""
    return (1 << 30) // max(dimension, 1)


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, embedding`` of the rows that take part."""
    inf = F.lit(float("inf"))

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != inf)

    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("embedding").isNotNull() & F.coalesce(F.forall("embedding", finite), F.lit(False)))


def integers(lists: pa.Array, dimension: int) -> np.ndarray:
    """Rows of ``dimension`` integers from lists of doubles."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    bound = most(dimension)
    whole = np.clip(np.floor(flat * float(SCALE)), -bound, bound).astype(np.int64)
    if (lengths == dimension).all():
        return whole.reshape(-1, dimension)
    out = np.zeros((len(lists), dimension), np.int64)
    out[np.arange(dimension) < lengths[:, None]] = whole
    return out


@dataclass(frozen=True)
class Book:
    """Entries of one part position, sorted by component sum."""

    sums: np.ndarray
    entries: np.ndarray
    index: np.ndarray

    @staticmethod
    def of(entries: np.ndarray) -> Book:
        order = np.argsort(entries.sum(axis=1), kind="stable")
        return Book(entries.sum(axis=1)[order], entries[order], order)


def nearest_entries(parts: np.ndarray, book: Book) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of the nearest entry of every part, and how many entries were compared."""
    rows, width = parts.shape
    count = len(book.sums)
    own = parts.sum(axis=1)
    high = np.searchsorted(book.sums, own)
    low = high - 1
    best = np.full(rows, (1 << 62) // max(width, 1), np.int64)
    found = np.full(rows, count, np.int64)
    going = np.arange(rows)
    compared = 0
    while len(going):
        lo, hi, s = low[going], high[going], own[going]
        below = np.where(lo >= 0, s - book.sums[np.maximum(lo, 0)], -1)
        above = np.where(hi < count, book.sums[np.minimum(hi, count - 1)] - s, -1)
        down = (below >= 0) & ((above < 0) | (below <= above))
        gap = np.where(down, below, above)
        on = (gap >= 0) & (gap * gap <= best[going] * width)
        going, down, at = going[on], down[on], np.where(down, lo, hi)[on]
        off = parts[going] - book.entries[at]
        distance, entry = (off * off).sum(axis=1), book.index[at]
        nearer = (distance < best[going]) | ((distance == best[going]) & (entry < found[going]))
        best[going[nearer]], found[going[nearer]] = distance[nearer], entry[nearer]
        low[going[down]] -= 1
        high[going[~down]] += 1
        compared += len(going)
    return found, best, compared


def assigned(vectors: np.ndarray, books: list[Book]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a row per vector, a column per part) and summed squared distances."""
    codes = np.zeros((len(vectors), len(books)), np.int64)
    error = np.zeros(len(vectors), np.int64)
    width = vectors.shape[1] // len(books)
    for k, book in enumerate(books):
        codes[:, k], distance, _ = nearest_entries(vectors[:, k * width : (k + 1) * width], book)
        error += distance
    return codes, error


def _first_books(rows: DataFrame, dimension: int, parts: int, entries: int) -> np.ndarray:
    """Integer codebooks (part, entry, component) of the first rows: at most ``entries`` rows are fetched."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    whole = integers(pa.array([r["embedding"] for r in first], pa.list_(pa.float64())), dimension)
    return whole.reshape(len(first), parts, dimension // parts).transpose(1, 0, 2)


def _improved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: parts go to their nearest entries, entries to floor(sum / count) of their parts."""
    parts, entries, width = books.shape
    sorted_books = [Book.of(b) for b in books]
    dimension = parts * width

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)  # the last column counts
        for batch in sliced(batches):
            vectors = integers(batch.column("embedding"), dimension)
            codes, _ = assigned(vectors, sorted_books)
            for k in range(parts):
                own = np.ones((len(vectors), width + 1), np.int64)
                own[:, :width] = vectors[:, k * width : (k + 1) * width]
                np.add.at(total[k], codes[:, k], own)
        used = np.nonzero(total[:, :, width])
        for k in np.unique(used[0]):
            of = used[1][used[0] == k]
            cells = total[k][of].ravel()
            places = np.tile(np.arange(width + 1), len(of))
            part = np.full(len(cells), k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(np.repeat(of, width + 1), pa.int32()), pa.array(places, pa.int32()), pa.array(cells)],
                ["part", "entry", "place", "total"],
            )

    partial = rows.select("embedding").mapInArrow(sums, "part int, entry int, place int, total long")
    # one row for each number of the codebooks
    added = partial.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect()
    total = np.zeros((parts, entries, width + 1), np.int64)
    for r in added:
        total[r["part"], r["entry"], r["place"]] = r["total"]
    count = total[:, :, width:]
    return np.where(count > 0, total[:, :, :width] // np.maximum(count, 1), books)


@dataclass(frozen=True)
class Compressed:
    """``rows``: vec_id, label, codes (array of indexes), error; ``books``: part, entry, component."""

    rows: DataFrame
    books: np.ndarray


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Compressed:
    """Codebooks of ``vectors (vec_id, label, embedding)`` and the codes of every kept row."""
    rows = written(kept_vectors(vectors), "code-vectors")
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    dimension = max(parts, -(-longest // parts) * parts)
    books = _first_books(rows, dimension, parts, entries)
    for _ in range(rounds if books.shape[1] else 0):
        books = _improved(rows, books)
    final = [Book.of(b) for b in books]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            codes, error = assigned(integers(batch.column("embedding"), dimension), final)
            starts = pa.array(np.arange(0, codes.size + 1, parts), pa.int32())
            lists = pa.ListArray.from_arrays(starts, pa.array(codes.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), lists, pa.array(error)], ["vec_id", "label", "codes", "error"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = rows.mapInArrow(encode, f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long")
    return Compressed(written(coded, "codes"), books)


def op13_vector_codes(spark: SparkSession, sf_dir: str, most_broadcast: int = 1_000_000) -> DataFrame:
    """Codes of all embeddings; sums by label are broadcast while at most ``most_broadcast`` labels."""
    done = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))
    # rows of a hot label meet one of several copies of its sum
    salts = 1
    sums = written(done.rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    labels = sums.count()
    if labels > most_broadcast:
        salts = 64
    sums = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    digest = hashlib.sha256(",".join(map(str, done.books.ravel().tolist())).encode()).hexdigest()
    rows = done.rows.withColumn("own_salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int"))
    same = F.col("label").eqNullSafe(F.col("of")) & (F.col("own_salt") == F.col("salt"))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return rows.join(small_side(sums, labels, most_broadcast), same).select(
        "vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def _sql() -> str:
    nearest = """
  SELECT vec_id, p, any_value(x) AS x, arg_min(e, {{'d': d, 'e': e}}) AS e, min(d) AS d FROM (
    SELECT vec_id, p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM parts JOIN {books} USING (p)) GROUP BY vec_id, p"""
    better = """
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM {books} b LEFT JOIN (
    SELECT p, e, list(CAST(floor(t / n) AS BIGINT) ORDER BY k) AS c FROM (
      SELECT p, e, k, sum(x[k]) AS t, count(*) AS n FROM {assigned}, (SELECT unnest(range(1, len(x) + 1)) AS k FROM parts LIMIT (SELECT max(len(x)) FROM parts))
      GROUP BY p, e, k) GROUP BY p, e) m ON b.p = m.p AND b.e = m.e"""
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] AS x
  FROM kept, (SELECT unnest(range({PARTS})) AS p)),
b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})),
a0 AS MATERIALIZED ({nearest.format(books="b0")}),
b1 AS MATERIALIZED ({better.format(books="b0", assigned="a0")}),
a1 AS MATERIALIZED ({nearest.format(books="b1")}),
b2 AS MATERIALIZED ({better.format(books="b1", assigned="a1")}),
a2 AS MATERIALIZED ({nearest.format(books="b2")}),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM b2),
rows AS (
  SELECT vec_id, string_agg(lpad(lower(hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a2 GROUP BY vec_id)
SELECT r.vec_id, r.code, r.error, CAST(sum(r.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM rows r JOIN kept k USING (vec_id), digest"""


SQL = _sql()
