"""Near duplicates by min-max hashing: each permutation gives both its minimum and its maximum.

A permutation's minimum is common to two sets with a chance of their
similarity, and so is its maximum.  Permutations come in groups; the minima of
a group are one band, the maxima another, so a band of five needs five
permutations for two bands.  For one pair the two rather exclude than repeat
each other, which lowers the variance of what a signature tells.

At the lowest similarity that links, 0.8, a pair of sets shares a given band
with 0.8 ** 5 = 0.33, and none of the 50 bands once in 400 million pairs.  Rows
with one set are one class and are signed once.

Classes that share a band are compared on their full sets: in rounds with one
of them, the hub, where verified links merge components and a band whose classes
are all in one component is done.  What is left after the rounds is compared
within the band if it has few classes; bands with many are solved exactly, by
the prefixes of their rarest shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrain.llm import ngram_join
from tidegrain.llm.common import forget, need, small_batches, stored
from tidegrain.llm.ngram_join import class_of, shingle_set

WORDS, PERCENT = 4, 80
#: Permutations of a band, and groups of them; each group gives two bands.
ROWS, GROUPS = 5, 25
HUB_ROUNDS = 3
#: Classes up to which those of a band are paired directly.
FEW = 32
#: Shingles that are permuted at once.
PIECE = 4096

_GOLDEN = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def multipliers(n: int) -> np.ndarray:
    """n odd numbers of 64 bits; a set's hashes times one of them are its permuted hashes."""
    out, x = [], 0
    for _ in range(n):
        x = (x + _GOLDEN) & _ALL
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _ALL
        out.append((z ^ (z >> 31)) | 1)
    return np.array(out, np.uint64)


def extremes(s: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of a set under each permutation."""
    low, high = np.full(len(factors), _ALL, np.uint64), np.zeros(len(factors), np.uint64)
    for at in range(0, len(s), PIECE):
        x = factors[:, None] * s[None, at : at + PIECE]
        np.minimum(low, x.min(axis=1), out=low)
        np.maximum(high, x.max(axis=1), out=high)
    return low, high


def bands(s: np.ndarray, factors: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band: first those of minima, then those of maxima."""
    values = np.concatenate(extremes(s, factors)).reshape(-1, rows)
    key = np.arange(1, len(values) + 1, dtype=np.uint64) * np.uint64(_GOLDEN)
    for i in range(rows):
        key = (key ^ values[:, i]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, factors: np.ndarray) -> float:
    """Similarity of two sets as the share of equal minima and maxima."""
    return float(np.mean([x == y for x, y in zip(extremes(a, factors), extremes(b, factors), strict=True)]))


def signed(docs: DataFrame, n: int = WORDS, rows: int = ROWS, groups: int = GROUPS) -> DataFrame:
    """doc_id, c (class), n (set size) and text_key of each row, with the bands of a class where a task sees it first."""
    factors = multipliers(rows * groups)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            sets = [shingle_set(t, n) for t in b["text"]]
            classes = [class_of(s) for s in sets]
            keys = []
            for s, c in zip(sets, classes, strict=True):
                new = len(s) > 0 and c not in seen
                keys.append(bands(s, factors, rows) if new else None)
                if new:
                    seen.add(c)
            if len(seen) > 200_000:
                seen.clear()
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "c": classes, "n": [len(s) for s in sets], "text_key": b["text_key"], "bands": keys})

    return ngram_join._rows(docs).mapInPandas(run, "doc_id long, c long, n long, text_key long, bands array<long>")


def _fits(percent: int):
    """Whether two sets can be similar by their sizes, both rows before and after in one."""
    return F.lit(100) * F.least("n", "hub_n") >= F.lit(percent) * F.greatest("n", "hub_n")


def _exactly(docs: DataFrame, classes: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) that connect what similarity connects among the classes in members, without bands."""
    text_key = F.xxhash64(F.coalesce("text", F.lit("")))
    wanted = members.select("c").distinct().join(classes, "c").select(F.col("text_key").alias("key")).distinct()
    some = docs.select("doc_id", "text").withColumn("key", text_key).join(wanted, "key", "left_semi").select("doc_id", "text")
    found = ngram_join._labelled(stored(some), n, percent)
    return stored(found.filter("n > 0 and c != comp").select(F.col("c").alias("a"), F.col("comp").alias("b")).distinct())


def labelled(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, rows: int = ROWS, groups: int = GROUPS, few: int = FEW) -> DataFrame:
    """doc_id, c, n, text_key and comp of each row of docs (comp is c where nothing links)."""
    need(docs, "doc_id", "text")
    small_batches(docs.sparkSession)
    seen = stored(signed(docs, n, rows, groups))
    members = seen.select("doc_id", "c", "n", "text_key")
    classes = members.filter("n > 0").groupBy("c").agg(F.min(F.struct("text_key", F.coalesce("doc_id", F.lit(-1)).alias("first_id"))).alias("one")).select("c", "one.*")
    by_band = seen.filter("bands is not null").select("c", "n", F.explode("bands").alias("key"))
    # Only bands that two classes share are read on.
    shared = by_band.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low != high").select("key")
    left = stored(by_band.join(shared, "key").distinct())
    labels = stored(left.select("c").distinct().select("c", F.col("c").alias("comp")))
    done = None
    for k in range(HUB_ROUNDS + 1):
        open_ = left.join(labels, "c")
        hub = F.min(F.struct(F.xxhash64("c", F.lit(k)).alias("h"), F.col("c").alias("hub"), F.col("n").alias("hub_n"), F.col("comp").alias("hub_comp")))
        mixed = open_.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size"), hub.alias("first")).filter("low != high")
        before, left = left, stored(open_.join(mixed.select("key", "size", "first.hub", "first.hub_n", "first.hub_comp"), "key"))
        forget(before)
        if left.isEmpty():
            break
        if k < HUB_ROUNDS:
            found = left.filter((F.col("comp") != F.col("hub_comp")) & _fits(percent)).select("hub", "c")
        else:
            small = left.filter(F.col("size") <= few)
            one = small.select("key", F.col("c").alias("hub"), F.col("n").alias("hub_n"), F.col("comp").alias("hub_comp"))
            found = small.select("key", "c", "n", "comp").join(one, "key").filter((F.col("c") > F.col("hub")) & (F.col("comp") != F.col("hub_comp")) & _fits(percent)).select("hub", "c")
        found = found.distinct()
        if done is not None:
            found = found.join(done, ["hub", "c"], "left_anti").join(done.select(F.col("hub").alias("c"), F.col("c").alias("hub")), ["hub", "c"], "left_anti")
        pairs = stored(found)
        links = stored(ngram_join.verified(docs, classes, pairs, n, percent))
        if k == HUB_ROUNDS:
            many = left.filter(F.col("size") > few)
            if not many.isEmpty():
                links = links.unionByName(_exactly(docs, classes, many, n, percent))
        labels = ngram_join.merged(labels, links)
        done = pairs if done is None else done.unionByName(pairs)
        left = left.select("c", "n", "key")
    return members.join(labels, "c", "left").withColumn("comp", F.coalesce("comp", "c"))


def components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, rows: int = ROWS, groups: int = GROUPS, few: int = FEW) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs.

    component_id is the smallest doc_id that links reach, and kept marks its
    rows.  Null and empty texts and texts of white space have no shingles and
    are components of their own, which are kept; rows with one set are one
    class; rows that repeat a kept doc_id are kept each; a null doc_id is only
    the smallest where nothing else is.  An empty table gives an empty one;
    other columns are not read.  Texts count whole, however long.
    """
    found = labelled(docs, n, percent, rows, groups, few)
    smallest = found.filter("n > 0").groupBy("comp").agg(F.min("doc_id").alias("smallest"))
    own = F.when(F.col("n") > 0, F.coalesce("smallest", "doc_id")).otherwise(F.col("doc_id"))
    out = found.join(smallest, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
