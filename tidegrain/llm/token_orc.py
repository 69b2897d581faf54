"""Token ids in ORC files, ordered by document id.

Documents are range-partitioned and sorted by id, encoded in the task and
written as ORC: stripes can be read in parallel, ids get ORC's integer
run-length encoding, and row indexes and a Bloom filter on ``doc_id`` let a
lookup skip stripes and row groups.  Each row has the number of its range and
how many ids its range has before it, so reading back adds one total for each
range and needs no order among the rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from tidegrain.llm.bpe import byte_characters
from tidegrain.llm.common import need, small_batches
from tidegrain.llm.pretokens import Ids, WordIds, gather

STORED = "doc_id long, part int, before long, n_tokens long, ids array<int>"

#: Pre-tokens merged in one call.
JOINED = 1000
#: Bytes of text aimed at for a file; there are as many files as shuffle partitions at least.
FILE_BYTES = 64 << 20

# A Latin word, perhaps after a space, with punctuation behind it, and perhaps the same on the next line.
# The byte-level pattern ends a pre-token between any two of these parts.
_LETTERS, _POINTS = r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+", r"[.,!?;:#$*&]*"
_PLAIN = re.compile(rf"( ?{_LETTERS})({_POINTS})(?:(\n)({_LETTERS})({_POINTS}))?").fullmatch
_PLAIN_PART = re.compile(rf" ?{_LETTERS}|[.,!?;:#$*&]+|\n").fullmatch
_PLAIN_TEXT = re.compile(rf"(?:[ \n]|{_LETTERS}|[.,!?;:#$*&])*").fullmatch

_loaded: dict[tuple[str, bool], WordIds] = {}


class PlainMerger:
    """The library's ids of words: of plain ones by pre-token, of others as the whole text.

    A plain word's pre-tokens are known if the pre-tokenizer is the byte-level
    one.  Their characters for bytes go to the library's model, many in one
    call, parted by spaces.
    """

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.sizes = np.array([len(tokenizer.id_to_token(i) or "") for i in range(tokenizer.get_vocab_size())])
        self.points = np.array([ord(c) for c in byte_characters()], "<u4")
        self.points[0] = ord(" ")
        self.merger = Tokenizer(tokenizer.model)
        self.merger.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        split = tokenizer.pre_tokenizer
        added = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
        self.plain = isinstance(split, pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space and tokenizer.normalizer is None and not any(map(_PLAIN_TEXT, added))

    def split(self, text: str) -> list[str]:
        m = _PLAIN(text) if self.plain else None
        return [p for p in m.groups() if p] if m else [text] if text else []

    def merge(self, pieces: list[str]) -> Ids:
        fit = [self.plain and _PLAIN_PART(p) is not None for p in pieces]
        plain, rest = [p for p, x in zip(pieces, fit, strict=True) if x], [p for p, x in zip(pieces, fit, strict=True) if not x]
        flats, sizes = [np.zeros(0, "<i4")], np.zeros(len(pieces), np.int64)
        counts = []
        for a in range(0, len(plain), JOINED):
            data = np.frombuffer("\0".join(plain[a : a + JOINED]).encode(), np.uint8)
            ids = np.array(self.merger.encode_batch_fast([self.points[data].tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, "<i4")
            # A piece has a character for each byte, and a zero byte stands between two.
            gaps = np.append(np.flatnonzero(data == 0), len(data))
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), gaps - np.arange(len(gaps))) + 1
            counts.append(np.diff(ends, prepend=0))
            flats.append(ids)
        others = [np.array(x.ids, "<i4") for x in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)] if rest else []
        of_plain, of_rest = np.concatenate([np.zeros(0, np.int64), *counts]), np.array([len(x) for x in others], np.int64)
        mask = np.array(fit, bool)
        sizes[mask], sizes[~mask] = of_plain, of_rest
        ends = np.cumsum(np.concatenate([of_plain, of_rest])) - np.concatenate([of_plain, of_rest])
        starts = np.empty(len(pieces), np.int64)
        starts[mask], starts[~mask] = ends[: len(plain)], ends[len(plain) :]
        return gather(np.concatenate([*flats, *others]), starts, sizes), sizes


def _words(path: str, special_as_text: bool) -> WordIds:
    key = (path, special_as_text)
    if key not in _loaded:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = special_as_text
        tokenizer.no_padding()
        tokenizer.no_truncation()
        merger = PlainMerger(tokenizer)
        _loaded[key] = WordIds(merger.split, merger.merge)
    return _loaded[key]


def encode_rows(docs: DataFrame, tokenizer: str, end_id: int, special_as_text: bool = False) -> DataFrame:
    """doc_id, part (the task's range), before (ids of the part's earlier rows), n_tokens and ids, the end id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, part, total = _words(tokenizer, special_as_text), TaskContext.get().partitionId(), 0
        for b in batches:
            flat, counts = words.lookup(b.column("text"))
            flat, sizes = np.insert(flat, np.cumsum(counts), end_id), counts + 1
            ends = np.cumsum(sizes)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.full(len(sizes), part, np.int32)), pa.array(total + ends - sizes), pa.array(sizes), ids], ["doc_id", "part", "before", "n_tokens", "ids"])
            total += int(sizes.sum())

    return docs.mapInArrow(run, STORED)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, partitions: int | None = None, special_as_text: bool = False) -> None:
    """Write every whole text's ids to ORC files in ascending doc_id order.

    A null or empty text has the end id alone.  Rows with a null doc_id come
    first; rows that share a doc_id are ordered by a hash of the text.  An empty table
    writes a file without rows.  Other columns are not read.  The strings of
    special tokens are encoded as those tokens, as the library does, unless
    special_as_text.
    """
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("tie"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"] if partitions is None else 0
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(size / FILE_BYTES))
    order = (F.col("doc_id").asc_nulls_first(), F.col("tie"))
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    (
        encode_rows(ordered, tokenizer, end_id, special_as_text)
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(16 << 20))
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """Stored rows with start, the number of ids in all documents before."""
    stored = spark.read.schema(STORED).orc(path)
    # Ranges are numbered in the order of the ids; there is one row for each of them, whatever the rows.
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    return _with_crc(stored).join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def _with_crc(stored: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "doc_id", "before", "n_tokens"]
        for b in batches:
            ids = b.column("ids")
            values = np.asarray(ids.flatten()).astype("<u4")
            ends = np.cumsum(np.asarray(ids.value_lengths()))
            crc = [zlib.crc32(x.tobytes()) for x in np.split(values, ends[:-1])] if len(ends) else []
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(crc, pa.int64())], [*names, "ids_crc32"])

    small_batches(stored.sparkSession)
    return stored.select("part", "doc_id", "before", "n_tokens", "ids").mapInArrow(run, "part int, doc_id long, before long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Ids of the named documents; the filter reaches ORC's indexes and Bloom filters."""
    return spark.read.schema(STORED).orc(path).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")
