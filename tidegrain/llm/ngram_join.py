"""Similarity self-join on word n-gram sets with several global token orders.

Rows with one shingle set form a class; work is done once for each class.  A
token order ranks shingles by how frequent their hash bucket is in the whole
corpus, then by a hash, another one in each order.  Two sets of the wanted
similarity share a token in their prefixes under every order.  Pairs come from
the first order's prefixes and are intersected with the others', which are kept
by class, before any text is fetched; what is left is compared exactly.

A pair must also be able to reach the similarity with the tokens that follow
the first one it shares, on both sides; copies with edits of their own have
those, which are rare, in front.

Large groups of near copies are not expanded into pairs.  In each round, a
token's classes are held against the one that has it first, verified links merge
components, and tokens whose classes are all in one component are done.  After
the hub rounds, every pair of classes that still shares a token across
components is compared, so no link between components is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrain.llm.common import forget, need, quoted, small_batches, stored
from tidegrain.llm.substring import run_hashes

WORDS = 4
PERCENT = 85
ORDERS = 3
HUB_ROUNDS = 2
#: Members that one task compares with a hub.
HUB_MEMBERS = 200
#: Shingle frequencies are counted in a bucket for each so many bytes of text, within these bounds; a level is one byte.
BYTES_PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 1024, 1 << 16, 1 << 24
#: Buckets whose counts a task sends as one packed row.
BLOCK = 1 << 15
#: Words of 64 bits of the filter that rows to fetch must pass: one for each so many keys, within these bounds.
KEYS_PER_WORD, LEAST_WORDS, MOST_WORDS = 8, 1 << 10, 1 << 21

_ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_set(text: str, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; fewer words are one shingle, none give none."""
    words = text.encode().translate(_ASCII_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(n, len(words))
    # A short text's shingle must not equal a full one.
    return np.unique(run_hashes(h, k) ^ np.uint64(0 if k == n else k * 0x9E3779B97F4A7C1))


def class_of(s: np.ndarray) -> int:
    """Signed 64-bit digest of a set."""
    return int(np.frombuffer(xxhash.xxh64_digest(s.tobytes()), "<i8")[0])


def _levels(counts: np.ndarray, mean: float) -> np.ndarray:
    """Level of a frequency: 0 up to 1.1 times the mean, then four for each doubling."""
    ratio = counts / max(mean, 1e-9)
    return np.where(ratio <= 1.1, 0, np.clip(np.ceil(4 * np.log2(np.maximum(ratio, 1))), 1, 63)).astype(np.uint8)


def frequency_levels(counts: DataFrame, buckets: int) -> np.ndarray:
    """Levels of all buckets from rows a (block), b (its total) and packed counts; only buckets above the mean come to the driver."""
    mean = counts.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("n")).first()["n"] / buckets

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, packed in zip(b["a"].tolist(), b["packed"], strict=True):
                own = np.frombuffer(zlib.decompress(packed), np.int32)
                sums[block] = sums[block] + own if block in sums else own.astype(np.int64)
        for block, n in sums.items():
            high = np.flatnonzero(n > 1.1 * mean)
            yield pd.DataFrame({"bucket": block * BLOCK + high, "n": n[high]})

    table = counts.select("a", "packed").repartition("a").mapInPandas(add, "bucket long, n long").toArrow()
    levels = np.zeros(buckets, np.uint8)
    levels[table.column("bucket").to_numpy()] = _levels(table.column("n").to_numpy(), mean)
    return levels


def prefix(s: np.ndarray, levels: np.ndarray, order: int, percent: int = PERCENT) -> np.ndarray:
    """First tokens of a set under an order: as many as must contain one that a similar set shares."""
    n = len(s)
    size = n - (n * percent + 99) // 100 + 1
    x = (s ^ (s >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * order * 0x632BE59BD9B4E01 & (1 << 64) - 1)
    x ^= x >> np.uint64(29)
    key = (levels[(s & np.uint64(len(levels) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (x >> np.uint64(6))
    if size >= n:
        return s[np.argsort(key, kind="stable")]
    first = np.argpartition(key, size - 1)[:size]
    return s[first[np.argsort(key[first], kind="stable")]]


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def survey(docs: DataFrame, buckets: int, n: int = WORDS) -> DataFrame:
    """Rows of members (kind 0: a doc_id, b class, n set size, text_key) and of frequencies (kind 1: a block of buckets, b their total, packed counts)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(buckets, np.int32)
        for b in batches:
            sets = [shingle_set(t, n) for t in b["text"]]
            for s in sets:
                np.add.at(counts, (s & np.uint64(buckets - 1)).astype(np.int64), 1)
            # Sets go as they come; the counts once, at the end of the task.
            yield pd.DataFrame({"kind": 0, "a": b["doc_id"], "b": [class_of(s) for s in sets], "n": [len(s) for s in sets], "text_key": b["text_key"], "packed": None})
        for block, own in enumerate(counts.reshape(-1, BLOCK)):
            if own.any():
                yield pd.DataFrame({"kind": [1], "a": [block], "b": [int(own.sum())], "n": [0], "text_key": [0], "packed": [zlib.compress(own.tobytes(), 1)]})

    return _rows(docs).mapInPandas(run, "kind int, a long, b long, n long, text_key long, packed binary")


PREFIXES = "token long, pos int, c long, n int, other array<int>, third array<int>"


def tokens(docs: DataFrame, levels, n: int, percent: int) -> DataFrame:
    """For each class: token, its place and the set size for each of the first order's prefix, and one row with the other orders' prefixes.

    Of the other orders 32 bits of each token are kept, which can only let more pairs through.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            out, rest = [], []
            for t in b["text"]:
                s = shingle_set(t, n)
                c = class_of(s)
                if len(s) and c not in seen:
                    seen.add(c)
                    out.append((prefix(s, levels.value, 0, percent).view(np.int64), c, len(s)))
                    rest.append([prefix(s, levels.value, o, percent).astype(np.uint32).view(np.int32) for o in range(1, ORDERS)])
            if len(seen) > 200_000:
                seen.clear()
            if out:
                sizes = [len(p) for p, _, _ in out]
                yield pd.DataFrame({"token": np.concatenate([p for p, _, _ in out]), "pos": np.concatenate([np.arange(k) for k in sizes]), "c": np.repeat([c for _, c, _ in out], sizes), "n": np.repeat([k for _, _, k in out], sizes), "other": None, "third": None})
                yield pd.DataFrame({"token": 0, "pos": -1, "c": [c for _, c, _ in out], "n": [k for _, _, k in out], "other": [x[0] for x in rest], "third": [x[1] for x in rest]})

    return _rows(docs).select("text").mapInPandas(run, PREFIXES)


def meeting(pairs: DataFrame, others: DataFrame) -> DataFrame:
    """The pairs (hub, c) whose prefixes meet under the other orders as well.

    Prefixes are long and pairs are few, so those of other classes are left
    where they are.
    """
    n = pairs.count()
    of = lambda side: wanted(others, "c", pairs.select(F.col(side).alias("key")), n)
    hub = of("hub").select(F.col("c").alias("hub"), F.col("other").alias("hub_other"), F.col("third").alias("hub_third"))
    both = pairs.join(hub, "hub").join(of("c"), "c")
    return both.filter(F.arrays_overlap("other", "hub_other") & F.arrays_overlap("third", "hub_third")).select("hub", "c")


def wanted(rows: DataFrame, column: str, keys: DataFrame, n_keys: int) -> DataFrame:
    """Rows whose hash in column is among keys (column key), and few others.

    A filter of bounded size goes to all tasks and no row is shuffled.
    """
    words = min(MOST_WORDS, max(LEAST_WORDS, 1 << (n_keys // KEYS_PER_WORD).bit_length()))
    at = lambda key: F.shiftrightunsigned(key, 6).bitwiseAND(F.lit(words - 1))
    bit = lambda key: F.pmod(key, F.lit(64)).cast("int")
    mask = keys.select(at(F.col("key")).alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("key"))).alias("flag")).groupBy("_word").agg(F.bit_or("flag").alias("_flags"))
    passed = rows.join(F.broadcast(mask), at(F.col(column)) == F.col("_word"))
    return passed.filter(F.getbit(F.col("_flags"), bit(F.col(column))) == 1).select(rows.columns)


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (hub, c) whose sets have the similarity.

    A class is read from one of its rows in docs.  The rows that pairs need
    are sent once to each group of a hub and up to HUB_MEMBERS members.
    """
    load = pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_MEMBERS).cast("int").alias("parts"))
    members = pairs.join(load, "hub").select("hub", F.pmod(F.xxhash64("c"), "parts").cast("int").alias("part"), F.lit(False).alias("is_hub"), "c")
    hubs = load.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("is_hub"), F.col("hub").alias("c"))
    roles = stored(members.unionByName(hubs).join(classes, "c").withColumnRenamed("text_key", "key"))
    rows = wanted(_rows(docs), "text_key", roles.select("key"), roles.count()).select("text_key", F.coalesce("doc_id", F.lit(-1)).alias("own_id"), "text")
    both = rows.join(roles, (F.col("text_key") == F.col("key")) & (F.col("own_id") == F.col("first_id"))).select("hub", "part", "is_hub", "c", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, hub_set = None, None
        for b in batches:
            links = []
            for hub, part, is_hub, c, text in zip(b["hub"].tolist(), b["part"].tolist(), b["is_hub"].tolist(), b["c"].tolist(), b["text"], strict=True):
                s = shingle_set(text, n)
                if class_of(s) != c:
                    continue  # another text with the same key
                if is_hub:
                    key, hub_set = (hub, part), s
                    continue
                if key != (hub, part):
                    raise ValueError("a hub comes before its members")
                common = len(np.intersect1d(hub_set, s, assume_unique=True))
                if 100 * common >= percent * (len(s) + len(hub_set) - common):
                    links.append((hub, c))
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    ordered = both.repartition("hub", "part").sortWithinPartitions("hub", "part", F.desc("is_hub"))
    return ordered.mapInPandas(run, "a long, b long")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (c, comp) after joining the components that links connect; the smallest label stays."""
    while True:
        ends = links.join(labels.select(F.col("c").alias("a"), F.col("comp").alias("x")), "a").join(labels.select(F.col("c").alias("b"), F.col("comp").alias("y")), "b")
        across = ends.filter("x != y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
        across = stored(across)
        if across.isEmpty():
            return labels
        both = across.unionByName(across.select(F.col("y").alias("x"), F.col("x").alias("y")))
        up = both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("y"))
        jumped = up.join(up.select(F.col("x").alias("y"), F.col("y").alias("z")), "y", "left").select("x", F.least("y", F.coalesce("z", "y")).alias("to"))
        labels = stored(labels.join(jumped, F.col("comp") == F.col("x"), "left").select("c", F.coalesce("to", "comp").alias("comp")))


def _may_link(percent: int) -> Column:
    """Whether two sets can be similar if a token at these places is the first they share.

    Their sizes must fit, and no more tokens can be common than follow the
    first one on either side.
    """
    n, m = F.col("n"), F.col("hub_n")
    sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return sizes & ((100 + percent) * F.least(n - F.col("pos"), m - F.col("hub_pos")) >= percent * (n + m))


def _labelled(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, c, n, text_key and comp of each row of docs (comp is c where nothing links)."""
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (size // BYTES_PER_BUCKET).bit_length()))
    seen = stored(survey(docs, buckets, n))
    levels = spark.sparkContext.broadcast(frequency_levels(seen.filter("kind = 1"), buckets))
    members = seen.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("c"), "n", "text_key")
    classes = members.filter("n > 0").groupBy("c").agg(F.min(F.struct("text_key", F.coalesce("doc_id", F.lit(-1)).alias("first_id"))).alias("one")).select("c", "one.*")

    prefixes = stored(tokens(docs, levels, n, percent))
    by_token = prefixes.filter("pos >= 0").select("token", "pos", "c", "n")
    dense = stored(by_token.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low != high").select("token"))
    shared = stored(wanted(by_token, "token", dense.select(F.col("token").alias("key")), dense.count()).join(dense, "token"))
    labels = stored(classes.join(shared.select("c").distinct(), "c", "left_semi").select("c", F.col("c").alias("comp")))
    # Every row of a class gives the same prefixes.
    others = stored(prefixes.filter("pos < 0").select("c", "other", "third").join(labels, "c", "left_semi").groupBy("c").agg(F.first("other").alias("other"), F.first("third").alias("third")))
    forget(prefixes)
    done = None
    left = shared
    for k in range(HUB_ROUNDS + 1):
        open_ = left.join(labels, "c")
        mixed = open_.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.struct(F.col("pos").alias("hub_pos"), F.xxhash64("c", F.lit(k)).alias("h"), F.col("c").alias("hub"), F.col("n").alias("hub_n"), F.col("comp").alias("hub_comp"))).alias("first")).filter("low != high")
        open_ = stored(open_.join(mixed.select("token", "first.hub", "first.hub_pos", "first.hub_n", "first.hub_comp"), "token"))
        left = open_.select("token", "pos", "c", "n")
        if open_.isEmpty():
            break
        if k < HUB_ROUNDS:
            found = open_.filter((F.col("comp") != F.col("hub_comp")) & _may_link(percent)).select("hub", "c")
        else:
            one = open_.select("token", F.col("pos").alias("hub_pos"), F.col("c").alias("hub"), F.col("n").alias("hub_n"), F.col("comp").alias("hub_comp"))
            two = open_.select("token", "pos", "c", "n", "comp")
            found = two.join(one, "token").filter((F.col("c") > F.col("hub")) & (F.col("comp") != F.col("hub_comp")) & _may_link(percent)).select("hub", "c")
        found = found.distinct()
        if done is not None:
            found = found.join(done, ["hub", "c"], "left_anti").join(done.select(F.col("hub").alias("c"), F.col("c").alias("hub")), ["hub", "c"], "left_anti")
        pairs = stored(found)
        labels = merged(labels, stored(verified(docs, classes, stored(meeting(pairs, others)), n, percent)))
        done = pairs if done is None else done.unionByName(pairs)
    return members.join(labels, "c", "left").withColumn("comp", F.coalesce("comp", "c"))


def components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs.

    component_id is the smallest doc_id that links reach; an empty set is a
    component of its own.  Null texts are empty; rows with one set
    are one class; a null doc_id is never the smallest unless nothing else is;
    an empty table gives an empty one; other columns are not read.
    """
    labelled = _labelled(docs, n, percent)
    smallest = labelled.filter("n > 0").groupBy("comp").agg(F.min("doc_id").alias("smallest"))
    own = F.when(F.col("n") > 0, F.coalesce("smallest", "doc_id")).otherwise(F.col("doc_id"))
    return labelled.join(smallest, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, null_ids_stay: bool = True) -> DataFrame:
    """One row of each component of docs, with its columns; rows without shingles are components of their own.

    The row with the smallest doc_id stays, nulls last; of rows with that
    doc_id, the one with the smallest text_key (xxhash64 of the text); of rows
    alike in both, the one whose columns are smallest as JSON.  With
    null_ids_stay, rows with a null doc_id stay as well and are not counted.
    """
    rows = _labelled(docs, n, percent).filter("n > 0")
    if null_ids_stay:
        rows = rows.filter("doc_id is not null")
    # Rows of one doc_id and text are one key; they have one class and so one component.
    keys = stored(rows.groupBy("comp", "doc_id", "text_key").agg(F.count("*").alias("rows")))
    best = keys.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("best"))
    marked = keys.join(best, "comp").withColumn("wins", F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.text_key") == F.col("text_key")))
    as_key = lambda df: df.select(F.col("doc_id").alias("key_id"), F.col("text_key").alias("key_text"))
    others, several = as_key(marked.filter("not wins or rows > 1")), as_key(marked.filter("wins and rows > 1"))
    text_key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("key_id")) & (text_key == F.col("key_text"))
    once = docs.join(others, same, "left_anti")
    whole = F.struct(*[docs[quoted(c)] for c in docs.columns])
    again = docs.join(several, same, "left_semi").groupBy(docs["doc_id"].cast("long").alias("key_id"), text_key.alias("key_text")).agg(F.min_by(whole, F.to_json(whole)).alias("row"))
    return once.unionByName(again.select(*[F.col("row")[c].alias(c) for c in docs.columns]))
