"""Benchmark passages in documents, by SimHash of item-sized windows.

A window has as many words as the benchmark item it is held against.  Its
SimHash (64 bits, shingles of five words weighted by how often they occur) is
looked up in a multi-index of the items' fingerprints: eight blocks of eight
bits, each probed with up to two flipped bits, which guarantees every
fingerprint within distance 23.  Candidates are verified with the exact
weighted similarity, sum of minima over sum of maxima of shingle counts.

Windows are taken at every word.  One that shares too few shingles with all
items together to reach the similarity is passed over before hashing, which
loses nothing.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrain.llm.common import need, small_batches, stored

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS, FLIPS = 8, 2
#: Any fingerprint at most so far away shares a block with at most FLIPS flipped bits.
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Characters of benchmark text that one pass broadcasts; a larger benchmark takes more passes.  An index takes about 50
#: bytes for each in every worker (measured: 80 MB for 1.6 million), so a pass stays near 100 MB.
PASS_CHARS = 2_000_000

_TOKEN = re.compile(r"[^\W_]+")
MATCHES = "doc_id long, item_id long, similarity double, start long, n_words long"


def tokens(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _TOKEN.findall(text.lower())


def shingles(words: list[str]) -> list[str]:
    """Five-word shingles in order; a shorter sequence is one shingle, none has none."""
    k = min(SHINGLE, len(words))
    return [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if k else []


def fingerprint(counts: Counter) -> int:
    """SimHash: of each bit, the sign of the weighted sum over shingles."""
    h = np.array([xxhash.xxh64_intdigest(s) for s in counts], np.uint64)
    bits = (h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    total = (bits.astype(np.int64) * 2 - 1).T @ np.array(list(counts.values()))
    return int((total >= 0).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of shingle counts."""
    low = sum(min(n, b[s]) for s, n in a.items())
    return low / (sum(a.values()) + sum(b.values()) - low) if low else 0.0


class Index:
    """Items by size, their shingles, and the multi-index of their fingerprints."""

    def __init__(self, items: list[tuple[int, str]], least: float = SIMILARITY):
        self.least = least
        rows = [(i, tokens(t)) for i, t in items]
        self.items = [(i, len(w), Counter(shingles(w))) for i, w in rows if w]
        self.prints = [fingerprint(c) for _, _, c in self.items]
        self.by_size, self.blocks = defaultdict(set), [defaultdict(list) for _ in range(BLOCKS)]
        for j, (_, size, _) in enumerate(self.items):
            self.by_size[size].add(j)
        masks = [sum(1 << b for b in flips) for f in range(FLIPS + 1) for flips in combinations(range(8), f)]
        for j, p in enumerate(self.prints):
            for b in range(BLOCKS):
                for m in masks:
                    self.blocks[b][(p >> 8 * b & 255) ^ m].append(j)
        self.sized = {size: {s for j in own for s in self.items[j][2]} for size, own in self.by_size.items()}
        self.known = [set() for _ in range(SHINGLE + 1)]
        for _, size, c in self.items:
            self.known[min(SHINGLE, size)].update(c)
        self.words = {w for k in self.known for s in k for w in s.split(" ")}
        self.smallest = min(self.by_size, default=0)

    def near(self, print_: int, size: int) -> list[int]:
        """Items of that size whose fingerprint is within the radius."""
        seen = set()
        for b in range(BLOCKS):
            seen.update(self.blocks[b].get(print_ >> 8 * b & 255, ()))
        return [j for j in seen & self.by_size[size] if (self.prints[j] ^ print_).bit_count() <= RADIUS]

    def _hits(self, words: list[str], k: int) -> list[tuple[int, str]]:
        """Places where a shingle of some item begins."""
        known = np.frombuffer(bytes(map(self.words.__contains__, words)), bool)
        run = known[: len(words) - k + 1].copy()
        for d in range(1, k):
            run &= known[d : len(words) - k + 1 + d]
        found = ((i, " ".join(words[i : i + k])) for i in np.flatnonzero(run).tolist())
        return [(i, s) for i, s in found if s in self.known[k]]

    def matches(self, text: str) -> list[tuple[int, float, int, int]]:
        """item_id, similarity, first word and words of the best window, for each item found."""
        words = tokens(text)
        if not words or not self.items:
            return []
        best: dict[int, tuple[float, int, int]] = {}
        hits = {}
        for size in self.by_size:
            own = min(size, len(words))
            k = min(SHINGLE, size)
            if own < k or (own - k + 1) < self.least * (size - k + 1):
                continue
            if k not in hits:
                hits[k] = self._hits(words, k)
            n_own, n_item = own - k + 1, size - k + 1
            enough = ceil(self.least / (1 + self.least) * (n_own + n_item) - 1e-9)
            places = [i for i, s in hits[k] if s in self.sized[size]] if len(hits[k]) >= enough else []
            if len(places) < enough:
                continue
            there = np.zeros(len(words) - k + 2, np.int32)
            there[np.array(places) + 1] = 1
            sums = np.cumsum(there)
            inside = sums[n_own:] - sums[: len(sums) - n_own]
            for start in np.flatnonzero(inside >= enough).tolist():
                window = Counter(shingles(words[start : start + own]))
                for j in self.near(fingerprint(window), size):
                    s = similarity(window, self.items[j][2])
                    if s >= self.least and (j not in best or (-s, start) < (-best[j][0], best[j][1])):
                        best[j] = (s, start, own)
        return [(self.items[j][0], *best[j]) for j in sorted(best)]


def find(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, pass_chars: int = PASS_CHARS) -> DataFrame:
    """doc_id, item_id, similarity, start and n_words (words) of the best window of each item found.

    Ties in similarity go to the first window.  Null, empty and wordless texts
    and items match nothing; an item longer than a document is held against
    the whole document.  Repeated rows of docs are searched each; items that
    share an id are items each, whose best windows are rows each, in whichever
    pass they are; an item without id is searched as well and found as null.  Empty tables
    give an empty result; other columns are not read.
    """
    need(docs, "doc_id", "text")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    found = None
    for index, last in _indexes(benchmark, least, pass_chars):

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = [(d, *m) for d, t in zip(b["doc_id"], b["text"], strict=True) for m in _index(index, least).matches(t)]
                made = pd.DataFrame(out, columns=["doc_id", "item_id", "similarity", "start", "n_words"])
                # With a null among them, plain numbers would become floats.
                yield made.assign(item_id=pd.array([x[1] for x in out], dtype="Int64"))

        own = rows.mapInPandas(run, MATCHES)
        if not last:
            own = stored(own)
            index.destroy()
        found = own if found is None else found.unionByName(own)
    return found


def remove(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, pass_chars: int = PASS_CHARS) -> DataFrame:
    """The rows and columns of docs in whose text no item is found, with or without an id; null texts stay.

    Rows that repeat are judged each; an empty benchmark leaves all rows, an
    empty table gives an empty one.
    """
    need(docs, "text")
    small_batches(docs.sparkSession)
    for index, last in _indexes(benchmark, least, pass_chars):
        docs = docs.filter(~_leaks(index, least)("text"))
        if not last:
            docs = stored(docs)
            index.destroy()
    return docs


def _leaks(items, least: float):
    """Whether a text has one of the broadcast items, as a function of columns."""

    @F.pandas_udf("boolean")
    def leaks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bool(t) and bool(_index(items, least).matches(t))).astype(bool)

    return leaks


_built: dict[str, Index] = {}


def _index(items, least: float) -> Index:
    """The index of broadcast items; a worker builds it once and keeps the one it used last."""
    key, rows = items.value
    if key not in _built:
        _built.clear()
        _built[key] = Index(rows, least)
    return _built[key]


def _indexes(benchmark: DataFrame, least: float, pass_chars: int) -> Iterator[tuple]:
    """Broadcast parts of the benchmark, each of about pass_chars characters at most, and whether it is the last.

    One part at a time is in the driver.
    """
    need(benchmark, "item_id", "text")
    items = benchmark.filter("text is not null").select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    passes = max(1, ceil(total / pass_chars))
    part = lambda p: [(r["item_id"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).orderBy("item_id", "text").collect()]
    for p in range(passes):
        yield benchmark.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, part(p))), p == passes - 1
