"""Encoding of whole texts by a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the vocabulary's pattern of pieces
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = 1 << 62
MOST_BYTES = 64 << 20  # of a vocabulary, which is broadcast


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: the leftmost adjacent pair of lowest rank is merged until no pair can be.

    A segment tree over the adjacent pairs holds rank and place in each leaf and the smaller child in each node, so its
    root is the next merge. A merge changes three leaves, each updated along one path: O(n log n) for a piece of n bytes.
    """
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    parts: list[bytes] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << 32 | i
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(leaf: int, value: int) -> None:
        node = size + leaf
        tree[node] = value
        while node > 1:
            node >>= 1
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                return
            tree[node] = least

    while (least := tree[1]) != _NONE:
        left = least & 0xFFFFFFFF
        right = after[left]
        parts[left] += parts[right]
        parts[right] = b""
        after[left] = beyond = after[right]
        if right < n - 1:
            put(right, _NONE)
        if beyond < n:
            before[beyond] = left
            rank = ranks.get(parts[left] + parts[beyond])
            put(left, _NONE if rank is None else rank << 32 | left)
        elif left < n - 1:
            put(left, _NONE)
        if (prior := before[left]) >= 0:
            rank = ranks.get(parts[prior] + parts[left])
            put(prior, _NONE if rank is None else rank << 32 | prior)
    return [ranks[p] for p in parts if p]


class Encoder:
    """Splits texts into pieces and encodes them; short pieces already seen are remembered, ``remembered`` at most."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN, remembered: int = 200_000):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.split, self.known, self.remembered = regex.compile(pattern).findall, {}, remembered

    def __call__(self, text: str | None) -> list[int]:
        ids: list[int] = []
        known = self.known
        for piece in self.split(text or ""):
            found = known.get(piece)
            if found is None:
                found = merge_piece(piece.encode(), self.ranks)
                if len(piece) <= 40:
                    if len(known) >= self.remembered:
                        known.clear()
                    known[piece] = found
            ids += found
        return ids


def _vocabulary(df: DataFrame, path: str):
    """The vocabulary's bytes to every executor; workers needn't have the file. A file over MOST_BYTES is no vocabulary of this kind and refused."""
    if (size := os.path.getsize(path)) > MOST_BYTES:
        raise ValueError(f"{path} has {size} bytes; a vocabulary has {MOST_BYTES} at most")
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) of every row; null and empty texts have an empty list. Special tokens' strings are ordinary text.

    Narrow: no shuffle, only the two columns are read. Ids leave Python as Arrow offsets and values.
    """
    vocabulary = _vocabulary(documents, path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids = pa.array([encoder(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(encode, f"{key} {kind}, ids array<int>")


def token_counts(documents: DataFrame, key: str, text: str = "text", also: tuple[str, ...] = (), path: str = VOCABULARY) -> DataFrame:
    """(key, also..., n_tokens) of every row; null and empty texts have 0."""
    vocabulary = _vocabulary(documents, path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            n = pa.array([len(encoder(t)) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[key, *also, "n_tokens"])

    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in (key, *also))
    return documents.select(key, *also, text).mapInArrow(count, f"{kinds}, n_tokens bigint")
