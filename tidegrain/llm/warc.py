"""Merkle fixity audit of WARC replicas.

Records are ordered, so each has an ordinal and an offset range.  A leaf is
the hash of a record's bytes; a node hashes its children's hashes together
with their ranges, relative to the node's own begin.  Two replicas are
compared from the root down, and only below nodes that differ.

Both trees have the same places for leaves: the records that either replica
has, in the order of their ids.  A record that one of them lost leaves its
place empty, so only the branch above it differs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrain.llm.common import need, small_batches, stored

FANOUT = 64


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A resource record of WARC 1.1; nulls are empty fields."""
    body = (html or "").encode()
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>\r\nWARC-Target-URI: {url or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


#: Records of a range at most, about; there are as many ranges as shuffle partitions at least.
RANGE_ROWS = 1_000_000


def ordered(records: DataFrame, *order: Column) -> DataFrame:
    """Adds ordinal and offset (of the record's first byte) to stored records with a length.

    Rows are range-partitioned; each range is numbered by itself and shifted by
    the totals of the ranges before it, one row for each range.
    """
    spark = records.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(records.count() / RANGE_ROWS))
    numbered = stored(records.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()).withColumn("part", F.shiftright("id", 33)))
    totals = numbered.groupBy("part").agg(F.count("*").alias("rows"), F.sum("length").alias("bytes"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"))
    own = Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return (
        numbered.withColumn("within", F.coalesce(F.sum("length").over(own), F.lit(0)))
        .join(F.broadcast(starts), "part")
        .withColumn("ordinal", F.col("rows_before") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1)))
        .withColumn("offset", F.col("bytes_before") + F.col("within"))
        .drop("id", "part", "within", "rows_before", "bytes_before")
    )


def aligned(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two replicas (record_id, ordinal, offset, length, digest) with place, which is the same for a record of both.

    Records that share an id are told apart by their order.
    """

    def numbered(x: DataFrame) -> DataFrame:
        first = x.groupBy("record_id").agg(F.min("ordinal").alias("first"))
        return stored(x.join(first, "record_id").withColumn("nth", F.col("ordinal") - F.col("first")).drop("first"))

    a, b = numbered(a), numbered(b)
    keys = stored(a.select("record_id", "nth").unionByName(b.select("record_id", "nth")).distinct().withColumn("length", F.lit(0)))
    places = stored(ordered(keys, F.col("record_id"), F.col("nth")).select("record_id", "nth", F.col("ordinal").alias("place")))
    return a.join(places, ["record_id", "nth"]), b.join(places, ["record_id", "nth"])


def level_up(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Parents (node, begin, bytes, hash) of nodes; a parent has fanout children at most."""
    child = F.struct("node", "begin", "bytes", "hash")
    parents = nodes.groupBy(F.floor(F.col("node") / fanout).alias("parent")).agg(F.sort_array(F.collect_list(child)).alias("c"))
    first = F.col("c")[0]["begin"]
    bound = parents.select(F.col("parent").alias("node"), first.alias("begin"), F.aggregate("c", F.lit(0).cast("long"), lambda n, x: n + x["bytes"]).alias("bytes"), "c")
    text = F.transform("c", lambda x: F.concat_ws(":", (x["node"] % fanout).cast("string"), (x["begin"] - F.col("begin")).cast("string"), x["bytes"].cast("string"), x["hash"]))
    return bound.select("node", "begin", "bytes", F.sha2(F.concat_ws("|", text), 256).alias("hash"))


def tree(leaves: DataFrame, n: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the leaves (place, offset, length, digest) of n places up to the root."""
    levels = [leaves.select(F.col("place").alias("node"), F.col("offset").alias("begin"), F.col("length").alias("bytes"), F.col("digest").alias("hash"))]
    while n > 1:
        levels.append(stored(level_up(levels[-1], fanout)))
        n = ceil(n / fanout)
    return levels


def corrupt(a: DataFrame, b: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """place and finding (CHANGED, LOST by b, ADDED in b) where two replicas (place, offset, length, digest) differ.

    Equal roots end the audit; otherwise each level looks only at children of
    nodes that differ.  Replicas without records are equal to each other.
    """
    last = max((r[0] for r in (x.agg(F.max("place")).first() for x in (a, b)) if r[0] is not None), default=-1)
    ours, theirs = tree(a, last + 1, fanout), tree(b, last + 1, fanout)
    bad = None
    for x, y in zip(reversed(ours), reversed(theirs), strict=True):
        if bad is not None:
            parent = F.floor(F.col("node") / fanout)
            x, y = (z.join(bad.select(F.col("node").alias("up")), parent == F.col("up"), "left_semi") for z in (x, y))
        both = x.select("node", F.concat_ws(":", "bytes", "hash").alias("hash_a")).join(y.select("node", F.concat_ws(":", "bytes", "hash").alias("hash_b")), "node", "full")
        finding = F.when(F.col("hash_b").isNull(), "LOST").when(F.col("hash_a").isNull(), "ADDED").otherwise("CHANGED")
        bad = stored(both.filter(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select("node", finding.alias("finding")))
        if bad.isEmpty():
            break
    return bad.select(F.col("node").alias("place"), "finding")


def copies(page_id: int | None, data: bytes) -> list[bytes]:
    """What the query's second replica has of a page's record: some lose it, some have a byte flipped, some have it twice."""
    kind = zlib.crc32(str(page_id).encode()) % 97
    if kind == 0:
        at = len(data) // 2
        return [data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]]
    return [[], [data, data]][kind - 1] if kind in (1, 2) else [data]


def audit_pages(pages: DataFrame) -> DataFrame:
    """page_id, ordinal, offset, length, digest and finding (INTACT or see corrupt) of every page's record in either replica.

    The first replica holds the records as they are, the second is damaged
    (see copies).  Both are ordered by record id, then digest, so repeated
    rows stand side by side.  ordinal, offset, length and digest are the first
    replica's, null for what only the second has.  An empty table gives an
    empty result; other columns are not read.
    """
    need(pages, "page_id", "url", "html")
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page_id, url, html in zip(b["page_id"], b["url"], b["html"], strict=True):
                page_id = None if pd.isna(page_id) else int(page_id)
                data = record(page_id, url, html)
                name = "" if page_id is None else str(page_id)
                rows += [(first, name, len(x), hashlib.sha256(x).hexdigest()) for first, kept in ((True, [data]), (False, copies(page_id, data))) for x in kept]
            yield pd.DataFrame(rows, columns=["first", "record_id", "length", "digest"])

    hashed = stored(pages.select(F.col("page_id").cast("long"), "url", "html").mapInPandas(run, "first boolean, record_id string, length long, digest string"))
    a, b = aligned(*(ordered(hashed.filter(F.col("first") == x).drop("first"), F.col("record_id"), F.col("digest")) for x in (True, False)))
    a, b = stored(a), stored(b)
    bad = corrupt(a, b)
    added = b.join(bad.filter("finding = 'ADDED'"), "place")
    number = F.nullif(F.col("record_id"), F.lit("")).cast("long").alias("page_id")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("ordinal", "long"), ("offset", "long"), ("length", "long"), ("digest", "string"))]
    ours = a.join(bad, "place", "left").select(number, "ordinal", "offset", "length", "digest", F.coalesce("finding", F.lit("INTACT")).alias("finding"))
    return ours.unionByName(added.select(number, *none, "finding"))
