"""Encoding with a byte-level BPE vocabulary.

Each pre-token's bytes form a doubly linked list of symbols; a priority queue holds the ranks of the
possible merges; the lowest is taken, entries whose symbols have changed since are stale and are
skipped. Decoding concatenates the vocabulary's byte strings.

Defined results: null and empty texts give an empty list; blank text is ordinary text;
strings of special tokens in a text are ordinary text. Repeated rows give repeated rows. Other
columns of the input are not read.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

# Fixed value: the pre-token pattern that belongs to this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FOLDER = os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary file of lines with a base64 byte string and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: merges by rank over a linked list of symbols."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    symbol: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    get = ranks.get
    queue = [(rank, i, piece[i : i + 2]) for i in range(n - 1) if (rank := get(piece[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, left, pair = heapq.heappop(queue)
        first = symbol[left]
        if first is None:
            continue
        right = after[left]
        if right >= n or len(first) + len(symbol[right]) != len(pair) or not pair.startswith(first):
            continue  # stale: one of the two symbols has been merged meanwhile
        symbol[left], symbol[right] = pair, None
        following = after[left] = after[right]
        if following < n:
            before[following] = left
            joined = pair + symbol[following]
            if (rank := get(joined)) is not None:
                heapq.heappush(queue, (rank, left, joined))
        previous = before[left]
        if previous >= 0:
            joined = symbol[previous] + pair
            if (rank := get(joined)) is not None:
                heapq.heappush(queue, (rank, previous, joined))
    return [ranks[s] for s in symbol if s is not None]


class Encoder(dict):
    """Pre-token to ids, each pre-token merged once; the memory of it is bounded by ``keep`` entries."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, keep: int = 200_000) -> None:
        super().__init__()
        self.ranks = ranks
        self.keep = keep
        self._split = regex.compile(pattern).findall

    def __missing__(self, token: str) -> tuple[int, ...]:
        ids = tuple(merge(token.encode("utf-8", "surrogatepass"), self.ranks))
        if len(token) <= 64:
            if len(self) >= self.keep:
                self.clear()
            self[token] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self._split(text))))


class Decoder:
    """Ids to text by concatenating the vocabulary's strings."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.strings = {rank: string for string, rank in ranks.items()}

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One encoder for each vocabulary and worker process; the vocabulary came with the job."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(load_ranks(SparkFiles.get(name)))
    return _ENCODERS[name]


def ship_vocabulary(spark: SparkSession, path: str) -> str:
    """Send the vocabulary file with the job, so only the driver's machine must hold it; returns its name there."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def encode_column(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids) of every row; no shuffle, each partition by itself."""
    name = ship_vocabulary(documents.sparkSession, path or os.path.join(FOLDER, BYTE_BPE_50K))
    narrow = documents.select(key, text)
    kind = narrow.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name).encode
        for batch in batches:
            offsets, flat = [0], []
            for value in batch.column(1).to_pylist():
                flat.extend(encode(value or ""))
                offsets.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    return narrow.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_column(encoded: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, text) of every row of (key, ids); the ids of nothing are an empty text."""
    name = ship_vocabulary(encoded.sparkSession, path or os.path.join(FOLDER, BYTE_BPE_50K))
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(encoder(name).ranks).decode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(ids or []) for ids in batch.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, text string")


def count_tokens(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens) of every row; null and empty texts have no tokens."""
    name = ship_vocabulary(documents.sparkSession, path or os.path.join(FOLDER, BYTE_BPE_50K))
    narrow = documents.select(key, text)
    kind = narrow.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = encoder(name)
        for batch in batches:
            counts = [sum(map(len, map(cache.__getitem__, cache._split(t)))) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32())], names=[key, "n_tokens"])

    return narrow.mapInArrow(run, f"`{key}` {kind}, n_tokens int")
