"""Byte-level BPE through a sentencepiece model made from the vocabulary.

A rank file lists byte strings in merge order.  Each byte maps to one printable
character, so every entry becomes a piece; its score is the negative rank, and
the normaliser is the identity.  sentencepiece then merges the best-scored
neighbours first, which is the merge order of the ranks.  No tokenizer is
trained and no vocabulary is copied here: the file's path is a parameter.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrain.llm.common import need, small_batches
from tidegrain.llm.pretokens import Ids, WordIds, gather

#: A Latin word, perhaps after a space, then punctuation: two pre-tokens of the common pattern.
_PLAIN_WORD = re.compile(r"( ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([.,!?;:]*)").fullmatch

ENCODED = "doc_id long, n_tokens long, ids array<int>, decoded binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_characters() -> list[str]:
    """One printable character for each byte: itself if printable, else the next above 255."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model: piece 0 is the unknown, piece rank + 1 is the entry of that rank."""
    chars = byte_characters()
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the vocabulary must have all single bytes")
    piece = lambda text, score, kind: _block(1, _block(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _number(3, kind))
    pieces = [piece("<unk>", 0.0, 2)]
    pieces += [piece("".join(chars[b] for b in token), -float(rank), 1) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, 0) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    normaliser = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _block(2, trainer) + _block(3, normaliser)


class ByteBPE:
    """Encoder and decoder for one rank file and pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self.pattern = regex.compile(pattern)
        # Patterns that part words by case, script or length take the search.
        one, two = (" fooBar", "XMLHttpFoo", "a\u00c9b\u024f\u0100" * 20), (" a\u00e9.,", "Z\u024f!?;:", " a....", "HTTP;;")
        self.plain = all(len(self.pattern.findall(x)) == 1 for x in one) and all(len(self.pattern.findall(x)) == 2 for x in two)
        chars = byte_characters()
        self.to_chars = {b: c for b, c in enumerate(chars)}
        back = {c: b for b, c in enumerate(chars)}
        pieces = [self.model.id_to_piece(i) for i in range(1, len(self.ranks) + 1)]
        self.token_bytes = [bytes(back[c] for c in p) for p in pieces]
        self.whole = {t.decode(): r for t, r in self.ranks.items() if _is_text(t)}

    def split(self, text: str) -> list[str]:
        """Pre-tokens.  A Latin word with plain punctuation after it needs no search."""
        m = _PLAIN_WORD(text) if self.plain else None
        if m is None:
            return self.pattern.findall(text)
        return [m[1], m[2]] if m[2] else [m[1]]

    def merge(self, pieces: list[str]) -> Ids:
        """Ids of each pre-token; one that is an entry gets that entry's id."""
        unknown = [p for p in pieces if p not in self.whole]
        mapped = [p.encode().decode("latin-1").translate(self.to_chars) for p in unknown]
        merged = iter(self.model.encode(mapped, out_type=int, num_threads=1) if mapped else [])
        # Piece 0 of the model is the unknown one.
        ids = [[self.whole[p] + 1] if p in self.whole else next(merged) for p in pieces]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), "<i4", int(sizes.sum())) - 1, sizes

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


class Digester:
    """Digests of the decimal ids and of the bytes they decode to."""

    def __init__(self, codec: ByteBPE):
        self.tables = [_flat([b"%d," % i for i in range(len(codec.token_bytes))]), _flat(codec.token_bytes)]

    def __call__(self, ids: np.ndarray) -> tuple[str, str]:
        decimals, decoded = (gather(flat, starts[ids], sizes[ids]).tobytes() for flat, starts, sizes in self.tables)
        return hashlib.sha256(decimals[:-1]).hexdigest(), hashlib.sha256(decoded).hexdigest()


def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes


_loaded: dict[tuple[str, str], tuple[ByteBPE, WordIds, Digester]] = {}


def _codec(path: str, pattern: str) -> tuple[ByteBPE, WordIds, Digester]:
    if (path, pattern) not in _loaded:
        codec = ByteBPE(path, pattern)
        _loaded[path, pattern] = codec, WordIds(codec.split, codec.merge), Digester(codec)
    return _loaded[path, pattern]


def _encoded(words: WordIds, texts: pa.Array) -> list[np.ndarray]:
    flat, sizes = words.lookup(texts)
    return np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded bytes of every whole text.

    Null and empty texts have no ids; repeated rows are encoded each by
    itself; an empty table gives an empty one; other columns are not read.
    Each text is one row, so its ids must fit in a task's memory.
    """
    need(docs, "doc_id", "text")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, words, _ = _codec(path, pattern)
        for b in batches:
            ids = _encoded(words, pa.array(b["text"], pa.string()))
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [len(x) for x in ids], "ids": ids, "decoded": [codec.decode(x.tolist()) for x in ids]})

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, ENCODED)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and decoded bytes of an ids column (null ids: no bytes)."""
    need(encoded, "doc_id", "ids")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, _, _ = _codec(path, pattern)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "decoded": [codec.decode([] if x is None else [int(i) for i in x]) for x in b["ids"]]})

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInPandas(run, "doc_id long, decoded binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """encode() and decode() of every text, reduced in the task to counts and digests.

    The same rules as encode(); the ids themselves stay in the task.
    """
    need(docs, "doc_id", "text")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, words, digest = _codec(path, pattern)
        for b in batches:
            ids = _encoded(words, b.column("text"))
            made = [digest(x) for x in ids]
            columns = [b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), *(pa.array([x[k] for x in made], pa.string()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, DIGESTS)
