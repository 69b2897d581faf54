"""Substring dedup by super-k-mers.

A window is WINDOW consecutive words.  Consecutive windows that share a
minimiser (the smallest hash of the runs of MINIMISER words inside) travel as
one packed string to the minimiser's bucket; equal windows share it, so they
meet there.  In a bucket, windows are sorted and counted exactly.

A minimiser that heads more packed bytes than one bucket should have would be
an unbounded group.  Bytes are therefore counted first, by slots of minimisers:
windows of a hot slot go by the minimiser of longer runs as well, and where
that is hot too, each by its own hash.  All of these are functions of the
window's words, so equal windows still meet.

A task packs many strings at a time: one compressed blob for each bucket, in
which a string that the task saw several times stands once.  All windows of
such a string are known to repeat, so its places are marked at once and do not
travel; a bucket gets a hot passage once from each task's portion, not once
from each document.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from math import ceil

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrain.llm.common import need, small_batches

WINDOW = 35
MINIMISER = 4
#: Words of the runs whose smallest hash parts windows of a hot minimiser.
LONGER = 16
#: Slots, at least, in which bytes are counted by minimiser, and slots for each bucket.
SLOTS, SLOTS_PER_BUCKET = 1 << 16, 8
#: Slots with their bytes that a worker holds before it sends them, however many slots there are.
KEPT_SLOTS = 1 << 20
#: Bytes of text after which a task sends its blobs, and packed bytes aimed at for a bucket.
PORTION = 8 << 20
BUCKET_BYTES = 12 << 20

PACKED = "bucket int, payload binary, doc_key long, text_key long, spans binary"
COUNTED = "longer boolean, slot long, bytes long"
MARKED = "doc_key long, text_key long, spans binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size values, by doubling."""
    out, have = None, 0
    power, span, at = h, 1, size
    while at:
        if at & 1:
            n = len(h) - have - span + 1
            out = power[:n] if out is None else _mix(out[:n], power[have : have + n])
            have += span
        at >>= 1
        if at:
            power = _mix(power[: len(power) - span], power[span:])
            span *= 2
    return out


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    span = 1
    while span * 2 <= size:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    rest = size - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _minima(h: np.ndarray, run: int, window: int) -> np.ndarray:
    """Smallest hash of the runs of so many words in each window."""
    run = min(run, window)
    return _sliding_min(run_hashes(h, run), window - run + 1)


def _pieces(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each run of equal keys."""
    starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    return starts, np.append(starts[1:], len(keys))


Hot = tuple[np.ndarray, np.ndarray, int]


def _among(slots: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Whether the slots of keys are among sorted ones."""
    if not len(slots):
        return np.zeros(len(keys), bool)
    mine = (keys & np.uint64(n - 1)).astype(np.int64)
    return slots[np.minimum(np.searchsorted(slots, mine), len(slots) - 1)] == mine


def super_kmers(words: list[bytes], window: int, hot: Hot | None = None) -> list[tuple[int, int, int]]:
    """(key, first window, windows) of each super-k-mer; windows are numbered by their first word.

    The key is the minimiser unless its slot is hot (hot: sorted slots of
    minimisers, of minimisers with those of longer runs, and how many there are).
    """
    h = _hashes(words)
    keys = _minima(h, MINIMISER, window)
    if hot is not None:
        warm = _among(hot[0], keys, hot[2])
        if warm.any():
            longer = _mix(keys, _minima(h, LONGER, window))
            own = warm & _among(hot[1], longer, hot[2])
            keys = np.where(own, run_hashes(h, window), np.where(warm, longer, keys))
    starts, ends = _pieces(keys)
    return list(zip(keys[starts].tolist(), starts.tolist(), (ends - starts).tolist(), strict=True))


class _Sums:
    """Bytes by slot: a plain array if there are few slots, else those that occur, sorted when more than kept have come in."""

    def __init__(self, slots: int, kept: int = KEPT_SLOTS):
        self.dense = np.zeros(slots, np.int64) if slots <= kept else None
        self.parts, self.size, self.kept, self.full = [], 0, kept, False

    def add(self, slots: np.ndarray, n: np.ndarray) -> None:
        if self.dense is not None:
            # Sums of whole numbers below 2 ** 53 are exact.
            self.dense += np.bincount(slots, n, len(self.dense)).astype(np.int64)
            return
        self.parts.append((slots, n))
        self.size += len(slots)
        if self.size > self.kept:
            self._sort()
            self.full = self.size > self.kept // 2

    def _sort(self) -> tuple[np.ndarray, np.ndarray]:
        slots, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(slots)
        slots, n = slots[order], n[order]
        first = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
        slots, n = slots[first], np.add.reduceat(n, first)
        self.parts, self.size = [(slots, n)], len(slots)
        return slots, n

    def sent(self, longer: bool) -> Iterator[pd.DataFrame]:
        if self.dense is not None:
            slots = np.flatnonzero(self.dense)
            n = self.dense[slots]
        elif self.size:
            slots, n = self._sort()
        else:
            return
        for i in range(0, len(slots), 10_000):
            yield pd.DataFrame({"longer": longer, "slot": slots[i : i + 10_000], "bytes": n[i : i + 10_000]})
        self.parts, self.size, self.full = [], 0, False


def weigh(texts: Iterator[str], window: int, slots: int, kept: int = KEPT_SLOTS) -> Iterator[pd.DataFrame]:
    """Bytes of strings that pack() would send for each slot of minimisers, and of these with longer runs."""
    totals = (_Sums(slots, kept), _Sums(slots, kept))
    found: tuple[list, list] = ([], [])
    size = 0

    def add() -> None:
        for total, parts in zip(totals, found, strict=True):
            if parts:
                keys, ids, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                one = np.unique(ids, return_index=True)[1]
                total.add((keys[one] & np.uint64(slots - 1)).astype(np.int64), n[one])
            parts.clear()

    for text in texts:
        words = text.encode().split()
        if len(words) < window:
            continue
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
        h = _hashes(words)
        least, whole = _minima(h, MINIMISER, window), run_hashes(h, window)
        for keys, parts in zip((least, _mix(least, _minima(h, LONGER, window))), found, strict=True):
            a, b = _pieces(keys)
            # A string is known by its first and last window and its length; 40 bytes of numbers go with it.
            ids = _mix(_mix(whole[a], whole[b - 1]), (b - a).astype(np.uint64))
            parts.append((keys[a], ids, ends[b + window - 1] - ends[a] + 40))
        size += int(ends[-1])
        if size >= PORTION:
            add()
            size = 0
            for longer, total in enumerate(totals):
                if total.full:
                    yield from total.sent(bool(longer))
    add()
    for longer, total in enumerate(totals):
        yield from total.sent(bool(longer))


def hot_slots(texts: DataFrame, window: int, buckets: int, bucket_bytes: int) -> Hot:
    """The slots whose strings are more than a bucket should have: of minimisers, and of these with longer runs.

    Their number is at most that of the buckets.
    """
    slots = max(SLOTS, 1 << (SLOTS_PER_BUCKET * buckets - 1).bit_length())
    counted = texts.select("text").mapInPandas(lambda it: weigh((t for b in it for t in b["text"]), window, slots), COUNTED)
    table = counted.groupBy("longer", "slot").agg(F.sum("bytes").alias("n")).filter(F.col("n") > bucket_bytes).select("longer", "slot").toArrow()
    longer, slot = table.column("longer").to_numpy().astype(bool), table.column("slot").to_numpy()
    return np.sort(slot[~longer]), np.sort(slot[longer]), slots


def _blob(entries: list, compress) -> bytes:
    """Strings with their windows, and the place of those seen once."""
    meta = np.array([e[1:] for e in entries], np.int64)
    text = b"\n".join([e[0] for e in entries])
    return compress(struct.pack("<q", len(entries)) + meta.tobytes() + text)


def _unblob(data: bytes, expand) -> tuple[np.ndarray, bytes]:
    raw = expand(data)
    n = struct.unpack_from("<q", raw)[0]
    meta = np.frombuffer(raw, np.int64, n * 5, 8).reshape(n, 5)
    return meta, raw[8 + n * 40 :]


def pack(batches: Iterator[pd.DataFrame], window: int, buckets: int, hot: Hot | None = None) -> Iterator[pd.DataFrame]:
    """Blobs by bucket, and marks for strings that a portion has twice or more."""
    compress = zstandard.ZstdCompressor(level=3).compress
    seen: dict[bytes, list] = {}
    size = 0

    def flush() -> Iterator[pd.DataFrame]:
        by_bucket, marks = defaultdict(list), defaultdict(list)
        for string, (mini, windows, places) in seen.items():
            once = len(places) == 1
            d, t, s = places[0]
            by_bucket[mini % buckets].append((string, windows, once, d, t, s))
            if not once:
                for d, t, s in places:
                    marks[d, t].append((s, s + windows + window - 1))
        rows = [(b, _blob(e, compress), 0, 0, None) for b, e in by_bucket.items()]
        rows += [((d ^ t) % buckets, None, d, t, np.array(x, np.int32).tobytes()) for (d, t), x in marks.items()]
        seen.clear()
        for i in range(0, len(rows), 1000):
            yield pd.DataFrame(rows[i : i + 1000], columns=["bucket", "payload", "doc_key", "text_key", "spans"])

    for b in batches:
        for d, t, text in zip(b["doc_key"].tolist(), b["text_key"].tolist(), b["text"], strict=True):
            words = text.encode().split()
            if len(words) < window:
                continue
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1).tolist()
            size += len(joined)
            for mini, s, n in super_kmers(words, window, hot):
                string = joined[ends[s - 1] if s else 0 : ends[s + n + window - 2] - 1]
                known = seen.get(string)
                if known is None:
                    seen[string] = (mini, n, [(d, t, s)])
                else:
                    known[2].append((d, t, s))
            if size >= PORTION:
                yield from flush()
                size = 0
    yield from flush()


def repeated_windows(ids: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Of windows of ids that begin at starts: whether the same ids stand at another start."""
    out = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return out
    h = run_hashes(_mix(ids.astype(np.uint64) + np.uint64(1), np.full(len(ids), 7, np.uint64)), window)[starts]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    left, right = starts[order[:-1][same]], starts[order[1:][same]]
    span = np.arange(window)
    exact = all(np.array_equal(ids[left[i : i + 20_000, None] + span], ids[right[i : i + 20_000, None] + span]) for i in range(0, len(left), 20_000))
    if exact:
        out[order[:-1][same]] = True
        out[order[1:][same]] = True
        return out
    # Two windows share a hash by chance: compare the windows themselves.
    near = np.unique(np.concatenate([np.flatnonzero(same), np.flatnonzero(same) + 1]))
    rows = ids[starts[order[near], None] + span]
    _, inverse, n = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    out[order[near]] = n[inverse.ravel()] > 1
    return out


def count_bucket(frame: pd.DataFrame, window: int) -> pd.DataFrame:
    """Spans of words that repeated windows cover, by document."""
    expand = zstandard.ZstdDecompressor().decompress
    vocabulary = defaultdict(count().__next__)
    metas, parts = [], []
    for blob in frame["payload"].dropna():
        meta, text = _unblob(blob, expand)
        metas.append(meta)
        words = text.split()
        parts.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
    passed = frame[frame["payload"].isna()]
    rows = list(zip(passed["doc_key"], passed["text_key"], passed["spans"], strict=True))
    if metas:
        meta, ids = np.concatenate(metas), np.concatenate(parts)
        windows = meta[:, 0]
        first = np.concatenate([[0], np.cumsum(windows + window - 1)[:-1]])
        owner = np.repeat(np.arange(len(meta)), windows)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        hit = repeated_windows(ids, first[owner] + within, window) & (meta[owner, 1] == 1)
        at = np.flatnonzero(hit)
        if len(at):
            # Neighbouring windows of one string become one span.
            cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(owner[at]) != 0)) + 1
            a, b = at[np.concatenate([[0], cut])], at[np.append(cut - 1, len(at) - 1)]
            spans = defaultdict(list)
            for o, x, y in zip(owner[a].tolist(), within[a].tolist(), within[b].tolist(), strict=True):
                _, _, d, t, s = meta[o].tolist()
                spans[d, t].append((s + x, s + y + window))
            rows += [(d, t, np.array(x, np.int32).tobytes()) for (d, t), x in spans.items()]
    return pd.DataFrame(rows, columns=["doc_key", "text_key", "spans"])


def kept_words(text: str, spans) -> tuple[int, int, bytes]:
    """Words, words removed and the kept words joined by a space."""
    words = text.encode().split()
    if spans is None or not len(spans):
        return len(words), 0, b" ".join(words)
    pairs = np.concatenate([np.frombuffer(x, np.int32).reshape(-1, 2) for x in spans])
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, pairs[:, 0], 1)
    np.add.at(step, pairs[:, 1], -1)
    keep = np.cumsum(step[:-1]) == 0
    return len(words), int((~keep).sum()), b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def marked(docs: DataFrame, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, text and spans (binary pairs of first and end word) that repeated windows cover."""
    need(docs, "doc_id", "text")
    if window < 1:
        raise ValueError("a window has one word at least")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.select("doc_id", F.coalesce("doc_id", F.lit(-1)).alias("doc_key"), F.xxhash64("text").alias("text_key"), "text")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(3 * total / bucket_bytes))
    hot = spark.sparkContext.broadcast(hot_slots(rows, window, buckets, bucket_bytes))
    packed = keyed.select("doc_key", "text_key", "text").mapInPandas(lambda it: pack(it, window, buckets, hot.value), PACKED)
    found = packed.groupBy("bucket").applyInPandas(lambda frame: count_bucket(frame, window), MARKED)
    spans = found.groupBy("doc_key", "text_key").agg(F.collect_list("spans").alias("spans"))
    return keyed.join(spans, ["doc_key", "text_key"], "left").select("doc_id", "text", "spans")


def removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and text without the repeated words (kept words joined by one space).

    Null texts become empty ones; rows that repeat lose what repeats, each; an
    empty table gives an empty one; other columns are not kept.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [kept_words(t, s)[2].decode() for t, s in zip(b["text"], b["spans"], strict=True)]})

    return marked(docs, window).mapInPandas(run, "doc_id long, text string")


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Words, removed words and a digest of what stays, one row for each row of docs.

    A word goes when a window that covers it also starts elsewhere, in another
    row or the same.  Null texts have no words; texts shorter than a window
    stay whole; a repeated row repeats all its windows; an empty table gives
    an empty one; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [kept_words(t, s) for t, s in zip(b["text"], b["spans"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_words": [x[0] for x in out], "n_removed": [x[1] for x in out], "kept_sha256": [hashlib.sha256(x[2]).hexdigest() for x in out]})

    return marked(docs, window).mapInPandas(run, RESULT)
