"""Token counts (5): edit-aware counting with one segment tree per document.

A text is cut before white space into segments of about ``width`` characters; the token
counts of the segments are the leaves of a binary tree of sums, kept as a flat heap
(``tree[1]`` is the document's count, ``tree[i] = tree[2 i] + tree[2 i + 1]``).  An edit
touches the segments it overlaps, plus the one that ends where it starts, because its last
word may grow: only their new text is encoded again, the change goes up the sums.  The
tokenizer drops white space and never merges across it, so sums equal a full count.

Null text counts as empty (0 tokens).  Edits are ``(start, end, replacement)`` in code points
of the old text; they are applied in order of start, then end; one that starts before the
last one ended, lies outside the text or has a null place is ignored, and a null replacement
deletes.  Repeated rows are counted each for itself, an empty table stays empty, extra
columns pass through unless they bear the names of added ones.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced, texts_of, unused
from .word_ids import WordIds, tokenizer_json

EDIT = "struct<start:int,end:int,replacement:string>"
_ADDED = ("bounds", "tree", "edits", "n_tokens", "n_edits", "encoded_chars", "n_tokens_after")

#: What ``mark_numbers`` edits: runs of five digits or more, and marks repeated three times or more.
NUMBERS = re.compile(r"[0-9]{5,}|([#$%&*!=_-])\1{2,}")


def mark_numbers(text: str) -> list[tuple[int, int, str]]:
    """Edits that name long numbers and shorten runs of one mark."""
    return [(m.start(), m.end(), m.group(1) or "<number>") for m in NUMBERS.finditer(text)]


def segments(text: str, width: int) -> list[int]:
    """Where segments of about ``width`` characters start; all but the first at white space."""
    at = [0]
    for m in re.finditer(rf"(?s).{{1,{width}}}[^ \t-\r]*", text):
        if m.end() < len(text):
            at.append(m.end())
    return at


def heap(leaves) -> np.ndarray:
    """The flat tree of sums over ``leaves``."""
    size = 1 << max(len(leaves) - 1, 0).bit_length()
    tree = np.zeros(2 * size, np.int64)
    tree[size : size + len(leaves)] = leaves
    for i in range(size - 1, 0, -1):
        tree[i] = tree[2 * i] + tree[2 * i + 1]
    return tree


def heaps(starts: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """``heap`` for every run of ``counts`` between ``starts``."""
    out = []
    for lo, hi in zip(starts, starts[1:]):
        level = counts[lo:hi]
        size = 1 << max(int(hi - lo) - 1, 0).bit_length()
        levels = [np.concatenate((level, np.zeros(size - len(level), np.int64)))]
        while len(levels[-1]) > 1:
            levels.append(levels[-1][0::2] + levels[-1][1::2])
        out.append(np.concatenate([np.zeros(1, np.int64), *levels[::-1]]))
    return out


def valid_edits(edits, length: int) -> list[tuple[int, int, str]]:
    """The edits that count, in order; see the module's text."""
    kept, last = [], 0
    given = [e for e in edits or () if e is not None and e[0] is not None and e[1] is not None]
    for start, end, new in sorted(given, key=lambda e: (e[0], e[1], e[2] or "")):
        if last <= start <= end <= length:
            kept.append((start, end, new or ""))
            last = end
    return kept


def regions(bounds: np.ndarray, edits: list[tuple[int, int, str]], text: str):
    """(first leaf, last leaf, new text) of each run of leaves that edits touch."""
    ends = np.append(bounds[1:], len(text))
    touched: list[list] = []
    for edit in edits:
        first = max(int(np.searchsorted(bounds, max(edit[0] - 1, 0), side="right")) - 1, 0)
        last = max(int(np.searchsorted(bounds, max(edit[1] - 1, edit[0], 0), side="right")) - 1, first)
        if touched and first <= touched[-1][1]:
            touched[-1][1] = max(last, touched[-1][1])
            touched[-1][2].append(edit)
        else:
            touched.append([first, last, [edit]])
    for first, last, own in touched:
        parts, at = [], int(bounds[first])
        for start, end, new in own:
            parts += [text[at:start], new]
            at = end
        yield first, last, "".join([*parts, text[at : int(ends[last])]])


def _kept(df: DataFrame, added) -> list[str]:
    return [c for c in df.columns if c not in added]


_EDIT_TYPE = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("replacement", T.StringType())
_BUILT = (
    T.StructType()
    .add("bounds", T.ArrayType(T.IntegerType()))
    .add("tree", T.ArrayType(T.IntegerType()))
    .add("n_tokens", T.LongType())
    .add("edits", T.ArrayType(_EDIT_TYPE))
)
_APPLIED = T.StructType().add("n_edits", T.LongType()).add("encoded_chars", T.LongType()).add("n_tokens_after", T.LongType())
_INTS = pa.list_(pa.int32())
_EDITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("replacement", pa.string())]))


def _with_trees(words: WordIds, batch: pa.RecordBatch, names: list[str], width: int, edits) -> pa.RecordBatch:
    texts = texts_of(batch).to_pylist()
    bounds = [segments(t, width) for t in texts]
    leaves = [t[a:b] for t, own in zip(texts, bounds) for a, b in zip(own, [*own[1:], len(t)])]
    starts = np.concatenate(([0], np.cumsum([len(b) for b in bounds])))
    trees = heaps(starts, words.counts(pa.array(leaves, pa.string())))
    found = [[{"start": a, "end": b, "replacement": r} for a, b, r in edits(t)] if edits else None for t in texts]
    columns = [batch.column(c) for c in names]
    columns += [pa.array(bounds, _INTS), pa.array([t.tolist() for t in trees], _INTS)]
    columns += [pa.array([int(t[1]) for t in trees], pa.int64()), pa.array(found, _EDITS)]
    return pa.record_batch(columns, [*names, *_BUILT.names])


def _with_edits(words: WordIds, batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    texts, given, bounds = texts_of(batch).to_pylist(), batch.column("edits").to_pylist(), batch.column("bounds").to_pylist()
    trees, jobs, sizes, changed = batch.column("tree").to_pylist(), [], [], []
    for row, text in enumerate(texts):
        edits = valid_edits([(e["start"], e["end"], e["replacement"]) for e in given[row] or () if e is not None], len(text))
        sizes.append(len(edits))
        jobs.append(list(regions(np.array(bounds[row], np.int64), edits, text)) if edits else [])
        changed += [new for _, _, new in jobs[-1]]
    counts, k, encoded = words.counts(pa.array(changed, pa.string())).tolist(), 0, []
    for row, text in enumerate(texts):
        encoded.append(sum(len(new) for _, _, new in jobs[row]))
        if not jobs[row]:
            continue
        tree, own = trees[row], bounds[row]
        ends = [*own[1:], len(text)]
        lengths = [b - a for a, b in zip(own, ends)]
        parts, at = [], 0
        for first, last, new in jobs[row]:
            parts += [text[at : own[first]], new]
            at = ends[last]
            for leaf in range(first, last + 1):
                lengths[leaf] = len(new) if leaf == first else 0
                node = len(tree) // 2 + leaf
                change = (counts[k] if leaf == first else 0) - tree[node]
                while node and change:
                    tree[node] += change
                    node >>= 1
            k += 1
        texts[row] = "".join([*parts, text[at:]])
        bounds[row] = [0, *np.cumsum(lengths)[:-1].tolist()]
    new = {"text": pa.array(texts, pa.string()), "bounds": pa.array(bounds, _INTS), "tree": pa.array(trees, _INTS)}
    columns = [new[c] if c in new else batch.column(c) for c in names]
    columns += [pa.array(v, pa.int64()) for v in (sizes, encoded, [t[1] for t in trees])]
    return pa.record_batch(columns, [*names, *_APPLIED.names])


def _mapped(df: DataFrame, tokenizer: str | None, names: list[str], added, work) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer))

    def run(batches):
        words = WordIds(shared.value, most=200_000)
        for batch in sliced(batches, 1 << 23):
            yield work(words, batch)

    schema = T.StructType([*(f for f in df.schema if f.name in names), *added])
    return df.select(*[df[c] for c in names]).mapInArrow(run, schema)


def build_trees(docs: DataFrame, tokenizer: str | None = None, width: int = 512, edits=None) -> DataFrame:
    """``docs`` with ``bounds`` (segment starts), ``tree`` (heap of counts) and ``n_tokens``; if a
    function ``edits`` of the text is given, with its ``edits`` too."""
    names = _kept(docs, _ADDED)
    return _mapped(docs, tokenizer, names, _BUILT, lambda words, batch: _with_trees(words, batch, names, width, edits))


def attach_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """``trees`` with the rows ``(doc_id, start, end, replacement)`` of another table as ``edits``."""
    of = unused(trees, "of")
    own = edits.groupBy(F.col("doc_id").alias(of)).agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "replacement").cast(EDIT))).alias("edits")
    )
    return trees.drop("edits").join(own, F.col("doc_id") == F.col(of), "left").drop(of)


def apply_edits(trees: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Rows of ``build_trees`` with ``edits`` applied: new ``text``, ``bounds``, ``tree``, and
    ``n_edits``, ``encoded_chars`` (what had to be encoded again), ``n_tokens_after``."""
    names = _kept(trees, _APPLIED.names)
    return _mapped(trees, tokenizer, names, _APPLIED, lambda words, batch: _with_edits(words, batch, names))


def recount(docs: DataFrame, edits, tokenizer: str | None = None, width: int = 512) -> DataFrame:
    """``build_trees`` and ``apply_edits`` in one pass, for edits that follow from each text."""
    names = _kept(docs, _ADDED)

    def work(words, batch):
        return _with_edits(words, _with_trees(words, batch, names, width, edits), [*names, *_BUILT.names])

    return _mapped(docs, tokenizer, names, [*_BUILT, *_APPLIED], work)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, before and after long numbers and runs of marks are edited."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    edited = recount(docs, mark_numbers)
    return edited.select(
        "doc_id", "n_tokens", "n_edits", "n_tokens_after", "encoded_chars", F.length("text").cast("long").alias("chars_after")
    )
