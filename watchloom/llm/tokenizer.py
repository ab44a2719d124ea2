"""Encoding whole Arrow columns with a tokenizers file, each distinct word once per worker.

The vocabularies used here drop white space and never join text across it, so the ids of a text are the
ids of its words in order. Words are encoded by the library; a bounded table of words already seen
(by 64-bit hash) spares the rest.
"""

from __future__ import annotations

import os

import numpy as np

from watchloom.llm import kernel

MAX_WORDS = 2_000_000  # entries of the table of seen words; it starts anew beyond
_ENCODERS: dict[str, "WordEncoder"] = {}


def load(path: str):
    """The library's tokenizer; truncation and padding off."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encoder(path: str) -> "WordEncoder":
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``pool[start : start + size]`` one after the other."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return pool[:0]
    return pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])]


class WordEncoder:
    def __init__(self, path: str):
        self.tokenizer = load(path)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.starts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.sizes, self.pool, self.used = np.zeros(0, np.int64), np.zeros(1 << 16, np.int32), 0

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def runs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word, where its ids begin in ``self.pool`` and how many there are."""
        known, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(known) > MAX_WORDS and len(self.keys):
            self._forget()
        place = np.searchsorted(self.keys, known)
        found = np.zeros(len(known), bool)
        inside = place < len(self.keys)
        found[inside] = self.keys[place[inside]] == known[inside]
        new = np.flatnonzero(~found)
        if len(new):
            raw, first = data.tobytes(), at[new]
            texts = [raw[s:e].decode() for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            coded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            total = int(sizes.sum())
            if self.used + total > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(total, self.used), np.int32)])
            self.pool[self.used : self.used + total] = np.fromiter((i for ids in coded for i in ids), np.int32, total)
            begin = self.used + np.cumsum(sizes) - sizes
            self.used += total
            self.keys, self.starts, self.sizes = (
                np.insert(old, place[new], add) for old, add in ((self.keys, known[new]), (self.starts, begin), (self.sizes, sizes))
            )
            place = np.searchsorted(self.keys, known)
        return self.starts[place][back], self.sizes[place][back]

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and for each row the number of ids before it (with the total at the end)."""
        data, offsets = kernel.texts(column)
        starts, ends, counts = kernel.words(data, offsets)
        begin, sizes = self.runs(data, starts, ends, kernel.word_hashes(data, starts, ends))
        before = np.concatenate([[0], np.cumsum(sizes)])
        return gather(self.pool, begin, sizes), before[counts]
