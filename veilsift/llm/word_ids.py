"""Token ids of words between white space, by the ``tokenizers`` library.

A tokenizer that drops white space never merges across it, so the ids of a text are
the ids of its words in order.  Each distinct word of a batch is looked up once.
"""

from __future__ import annotations

import json
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from .common import split_words

#: The split pattern for which a word may be cut further before its ids are looked up.
_KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenizer_json(path: str | None = None) -> str:
    """The vocabulary file, read on the driver and sent to the tasks (a few MB)."""
    with open(path or default_path(), encoding="utf-8") as file:
        return file.read()


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def _cut_marks(texts: pa.Array) -> pa.Array:
    """Lower-case ASCII letters, and put a space wherever one meets an ASCII mark.

    A known split pattern cuts there anyway (after an apostrophe it may not: no space
    there), so ids stay the same and far fewer distinct words are left to look up.
    """
    texts = pc.ascii_lower(texts)
    if not len(texts) or texts.buffers()[2] is None:
        return texts
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    if len(data) < 2:
        return texts
    ends -= ends[0]
    letter, mark = _LETTER[data], _MARK[data]
    cut = letter[:-1] & mark[1:] | (mark & (data != 39))[:-1] & letter[1:]
    inner = ends[1:-1]
    cut[inner[(inner > 0) & (inner < len(data))] - 1] = False  # between two texts nothing is put
    at = np.flatnonzero(cut) + 1
    out = np.insert(data, at, 32)
    shifted = (ends + np.searchsorted(at, ends, side="right")).astype(np.int32)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(shifted), pa.py_buffer(out))


_LETTER = np.isin(np.arange(256), np.arange(97, 123))
_MARK = np.isin(np.arange(256), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])


class WordIds:
    """Ids of words, with a cache of bounded size (two generations of ``most`` entries)."""

    def __init__(self, source: str, most: int = 250_000):
        self.tokenizer = Tokenizer.from_str(source)
        rules = json.loads(source)
        self.specials = [t["content"] for t in rules.get("added_tokens") or []]
        steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.cuts = steps[0].get("pattern", {}).get("Regex") == _KNOWN and [
            n["type"] for n in (rules.get("normalizer") or {}).get("normalizers", [])
        ] == ["NFC", "Replace", "Lowercase"]
        if not self.cuts and " " in "".join(self.tokenizer.encode("a b", add_special_tokens=False).tokens):
            raise ValueError("the tokenizer must drop white space")
        self.pattern = regex.compile(_KNOWN)
        self.letters = _byte_letters()
        #: A word of ASCII letters holds no special token and is one piece.
        self.plain = self.cuts and not any(s.isalpha() for s in self.specials)
        self.most, self.young, self.old = most, {}, {}

    def _put(self, key: str, value: bytes) -> bytes:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value
        return value

    def _piece(self, piece: str) -> bytes:
        found = self.young.get(piece)
        if found is None:
            found = self.old.get(piece)
            if found is None:
                spelled = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
                ids = [t.id for t in self.tokenizer.model.tokenize(spelled)]
                found = struct.pack(f"<{len(ids)}I", *ids)
            self._put(piece, found)
        return found

    def of(self, word: str) -> bytes:
        """Little-endian unsigned 32-bit ids of one word."""
        found = self.young.get(word)
        if found is not None:
            return found
        found = self.old.get(word)
        if found is not None:
            return self._put(word, found)
        if self.plain and word.isascii() and word.isalpha():
            return self._piece(word.lower())
        odd = "<|" in word or any(s in word for s in self.specials) or not word.isprintable()
        if not self.cuts or odd or (not word.isascii() and ("Σ" in word or not unicodedata.is_normalized("NFC", word))):
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self._piece, self.pattern.findall(word.lower())))

    def _split(self, texts: pa.Array):
        if self.cuts and not any(pc.any(pc.match_substring(texts, s)).as_py() for s in ("<|", *self.specials)):
            texts = _cut_marks(texts)
        return split_words(texts)

    def _of_all(self, vocabulary: pa.Array) -> list[bytes]:
        """The ids of each word; most are in the young cache and need no call of their own."""
        words = vocabulary.to_numpy(zero_copy_only=False).tolist()
        parts = list(map(self.young.get, words))
        for at, found in enumerate(parts):
            if found is None:
                parts[at] = self.of(words[at])
        return parts

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each text start, and all ids."""
        starts, codes, vocabulary = self._split(texts)
        if not len(codes):
            return starts, np.zeros(0, "<u4")
        ids = pa.array(self._of_all(vocabulary), pa.large_binary()).take(pa.array(codes))
        ends = np.frombuffer(ids.buffers()[1], np.int64)[: len(codes) + 1] >> 2
        return ends[starts], np.frombuffer(ids.buffers()[2], "<u4")[: ends[-1]]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        starts, codes, vocabulary = self._split(texts)
        sizes = np.fromiter((len(p) >> 2 for p in self._of_all(vocabulary)), np.int64, len(vocabulary))
        ends = np.concatenate(([0], np.cumsum(sizes[codes])))
        return np.diff(ends[starts])
