"""Ids of whole texts from the ids of their words.

The pre-token pattern of byte-level BPE lets at most one space join the word
after it, so a text may be cut before a single space unless white space stands
on both sides of it.  The words between such cuts repeat; a worker keeps their
ids, and those of the pre-tokens of which they consist, in flat arrays.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space amid white space, where a cut could part one run of white space, and what any such place has, found faster.
_NO_CUT, _MAY_NOT_CUT = re.compile(r"\s \s").search, re.compile(r" \s").search

#: Entries at which a store starts anew, and the longest text that stays in it.  Only speed depends on them.
KEPT, LONGEST_KEPT = 600_000, 64

Ids = tuple[np.ndarray, np.ndarray]


def can_cut(text: str) -> bool:
    """Whether every space of a text is a place to cut."""
    return "  " not in text and not (_MAY_NOT_CUT(text) and _NO_CUT(text))


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of flat that begin at starts, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Store:
    """Ids by text, in flat arrays; long texts have slots that are not found again."""

    def __init__(self):
        self.slots: dict[str, int] = {}
        self.flat, self.starts, self.sizes, self.used, self.count = np.empty(1 << 16, "<i4"), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0, 0

    def find(self, texts: list[str], encode: Callable[[list[str]], Ids]) -> np.ndarray:
        """Slots of texts; those not here yet are encoded first."""
        found = np.fromiter(map(self.slots.get, texts, repeat(-1)), np.int64, len(texts))
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            new = dict(zip(dict.fromkeys([texts[i] for i in missing]), count(self.count), strict=False))
            self._append(len(new), encode(list(new)))
            self.slots.update(x for x in new.items() if len(x[0]) <= LONGEST_KEPT)
            found[missing] = [new[texts[i]] for i in missing]
        return found

    def _append(self, n: int, ids: Ids) -> None:
        flat, sizes = ids
        for name, more, used in (("flat", len(flat), self.used), ("starts", n, self.count), ("sizes", n, self.count)):
            own = getattr(self, name)
            if used + more > len(own):
                setattr(self, name, np.concatenate([own[:used], np.empty(max(used, more) + 1, own.dtype)]))
        self.flat[self.used : self.used + len(flat)] = flat
        self.sizes[self.count : self.count + n] = sizes
        self.starts[self.count : self.count + n] = self.used + np.cumsum(sizes) - sizes
        self.used, self.count = self.used + len(flat), self.count + n

    def get(self, slots: np.ndarray) -> Ids:
        return gather(self.flat, self.starts[slots], self.sizes[slots]), self.sizes[slots]


class WordIds:
    """Ids of texts by a function that cuts a word into pre-tokens and one that gives the ids of each pre-token."""

    def __init__(self, split: Callable[[str], list[str]], merge: Callable[[list[str]], Ids], kept: int = KEPT):
        self.split, self.merge, self.kept = split, merge, kept
        self.words, self.pieces = Store(), Store()

    def encode(self, texts: list[str]) -> Ids:
        """Ids of texts that are cut no further, without the store of words."""
        parts = list(map(self.split, texts))
        flat, sizes = self.pieces.get(self.pieces.find(list(chain.from_iterable(parts)), self.merge))
        of_text = np.cumsum([0, *map(len, parts)])
        return flat, np.diff(np.concatenate([[0], np.cumsum(sizes)])[of_text])

    def lookup(self, texts: pa.Array) -> Ids:
        """Ids of texts, none of which is null, in one array, and how many each has."""
        for name in ("words", "pieces"):
            store = getattr(self, name)
            if store.count > self.kept or store.used > 16 * self.kept:
                setattr(self, name, Store())
        own = texts.to_pylist()
        whole = {i: t for i, t in enumerate(own) if not can_cut(t)}
        if whole:
            texts = pa.array(["" if i in whole else t for i, t in enumerate(own)], pa.string())
        parts = pc.split_pattern(texts, " ")
        coded = parts.flatten().dictionary_encode()
        words, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        heads = parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py()
        store = self.words
        slots = store.find(words, lambda new: self.encode([" " + w for w in new]))[at]
        # The start of a text has no space before it; a text that can't be cut is all start.
        first = [whole.get(i, words[w]) for i, w in enumerate(at[heads].tolist())]
        flat, sizes = self.encode(first)
        starts, counts = store.starts[slots], store.sizes[slots]
        starts[heads], counts[heads] = store.used + np.cumsum(sizes) - sizes, sizes
        ids = gather(np.concatenate([store.flat[: store.used], flat]), starts, counts)
        return ids, np.add.reduceat(counts, heads) if len(heads) else np.zeros(0, np.int64)
