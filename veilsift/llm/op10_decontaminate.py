"""Benchmark decontamination (10): greedy string tiling.

Texts and test items become sequences of normalised words (lower case, marks at both ends
removed).  Runs of ``least`` words that a text shares with an item are seeds; only those
pairs are tiled: the longest common run of unmarked words, found by running Karp-Rabin
hashes of falling length, is marked on both sides again and again until no run of
``least`` words is left.  The share of the item's words in tiles is its coverage, whatever
the order of its parts in the text.

Items go to all tasks in blocks of bounded size, one pass over the documents a block.
Null or empty texts and items without words match nothing; items shorter than ``least``
words must occur as a whole.  Repeated rows are judged each for itself; extra columns pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rolled, sliced, split_words, texts_of

#: Marks removed from both ends of a word.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’…–—¿¡"

MATCHES = "doc_id long, item_id long, item_words long, tiles long, matched_words long, coverage double"


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text starts, and a 64-bit hash of each normalised word (0 words dropped)."""
    starts, codes, vocabulary = split_words(texts)
    bare = pc.utf8_trim(pc.utf8_lower(vocabulary), characters=_MARKS).cast(pa.binary()).to_pylist()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) if w else 0 for w in bare), np.uint64, len(bare))
    hashes = known[codes]
    kept = hashes != 0
    return np.concatenate(([0], np.cumsum(kept)))[starts], hashes[kept]


def _runs(hashes: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and Karp-Rabin hashes of the runs of ``size`` words that are all free."""
    if len(hashes) < size:
        return np.zeros(0, int), np.zeros(0, np.uint64)
    taken = np.concatenate(([0], np.cumsum(~free)))
    at = np.flatnonzero(taken[size:] == taken[:-size])
    return at, rolled(hashes, size)[at]


def tile(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in text, length), longest first.

    Ties go to the first place in the item, then in the text.
    """
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    size = max(least, len(item))
    while True:
        at_item, in_item = _runs(item, free_item, size)
        at_text, in_text = _runs(text, free_text, size)
        found = []
        shared = np.isin(in_text, in_item)
        for j, h in zip(at_text[shared], in_text[shared]):
            for i in at_item[in_item == h]:
                if i and j and free_item[i - 1] and free_text[j - 1] and item[i - 1] == text[j - 1]:
                    continue  # part of a longer run
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and free_item[i + n] and free_text[j + n]:
                    n += 1
                if n >= size:
                    found.append((-n, int(i), int(j)))
        again = False
        for n, i, j in sorted(found):
            if free_item[i : i - n].all() and free_text[j : j - n].all():
                free_item[i : i - n] = False
                free_text[j : j - n] = False
                tiles.append((i, j, -n))
            else:
                again = True  # what is left of it may still be a run
        if again:
            continue
        if size <= least:
            return tiles
        size = max(least, size // 2)


class Items:
    """A block of test items with the hashes of their seeds."""

    def __init__(self, ids: list, texts: list, least: int):
        starts, hashes = word_hashes(pa.array([t or "" for t in texts], pa.string()))
        self.least = least
        self.words = [hashes[a:b] for a, b in zip(starts, starts[1:])]
        self.ids = ids
        self.by_size: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k, words in enumerate(self.words):
            size = min(least, len(words))
            if size:
                for at, h in enumerate(rolled(words, size).tolist()):
                    self.by_size.setdefault(size, {}).setdefault(h, []).append((k, at))
        self.seeds = {s: np.sort(np.array(list(d), np.uint64)) for s, d in self.by_size.items()}
        self.likely = {}
        for s, seeds in self.seeds.items():
            table = np.zeros(1 << 20, bool)
            table[seeds >> np.uint64(44)] = True
            self.likely[s] = table

    def matches(self, texts: pa.Array, share: float):
        """(row, item number, tiles) of every pair whose coverage is at least ``share``."""
        starts, hashes = word_hashes(texts)
        pairs: dict[tuple[int, int], tuple[set, set]] = {}
        for size, seeds in self.seeds.items():
            runs = rolled(hashes, size)
            at = np.flatnonzero(self.likely[size][runs >> np.uint64(44)])
            at = at[np.isin(runs[at], seeds)]
            row = np.searchsorted(starts, at, side="right") - 1
            inside = at + size <= starts[row + 1]
            for p, r in zip(at[inside].tolist(), row[inside].tolist()):
                for item, place in self.by_size[size][int(runs[p])]:
                    of_item, of_text = pairs.setdefault((r, item), (set(), set()))
                    of_item.update(range(place, place + size))
                    of_text.update(range(p, p + size))
        for (row, item), (of_item, of_text) in sorted(pairs.items()):
            words = self.words[item]
            if len(of_item) < share * len(words):
                continue  # no tiling can cover more than the seeds do
            places = np.array(sorted(of_text))
            gaps = np.flatnonzero(np.diff(places) > 1)
            # tiles lie within seeds: the rest of the text is one word that nothing equals
            text = np.insert(hashes[places], gaps + 1, np.uint64(0))
            found = tile(words, text, min(self.least, len(words)))
            if sum(n for _, _, n in found) >= share * len(words):
                yield row, item, found


def blocks(bench: DataFrame, least: int, most_items: int = 50_000, most_chars: int = 1 << 26):
    """The items in blocks small enough for every task, by a hash of each item."""
    size = bench.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    count = max(1, -(-size["n"] // most_items), -(-(size["chars"] or 0) // most_chars))
    rows = bench.select(F.col("item_id").cast("long"), "text")
    for k in range(count):
        part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        found = part.collect()
        yield Items([r["item_id"] for r in found], [r["text"] for r in found], least)


def find_contamination(docs: DataFrame, bench: DataFrame, least: int = 5, share: float = 0.5) -> DataFrame:
    """One row per document and item (``MATCHES``) with a coverage of at least ``share``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    found = None
    for items in blocks(bench, least):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for batch in sliced(batches, 1 << 21):
                ids, own = batch.column("doc_id").to_pylist(), shared.value
                out = [
                    (ids[r], own.ids[i], len(own.words[i]), len(t), sum(n for _, _, n in t), sum(n for _, _, n in t) / len(own.words[i]))
                    for r, i, t in own.matches(texts_of(batch), share)
                ]
                kinds = [pa.int64()] * 5 + [pa.float64()]
                columns = list(zip(*out)) or [()] * 6
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in MATCHES.split(", ")])

        part = rows.mapInArrow(run, MATCHES)
        found = part if found is None else found.union(part)
    return found


def decontaminate(docs: DataFrame, bench: DataFrame, least: int = 5, share: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text covers less than ``share`` of every item."""
    for items in blocks(bench, least):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for batch in sliced(batches, 1 << 21):
                keep = np.ones(batch.num_rows, bool)
                for row, _, _ in shared.value.matches(texts_of(batch), share):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item or more, in any order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
