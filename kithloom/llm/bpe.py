"""Byte-level BPE of a corpus with the vocabulary of a public tokenizer.

Each piece of text is merged with a segment tree over its byte positions. A leaf holds the rank of the pair that starts at
its position, an inner node the leftmost smallest rank below it, so the root is the next merge. A merge changes three leaves
(the merged pair, its live neighbour to the left, the position that vanished), each a walk of logarithmic length: n bytes
take O(n log n), however long a piece without blanks may be. Pieces seen before come from a bounded per-worker memory.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

#: Where the public vocabularies lie, unless a path is given.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE_50K = os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
#: Fixed value: the pattern that cuts text into pieces before the vocabulary's merges.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces a worker remembers, and their longest length; beyond either they are merged anew, with the same result.
REMEMBERED, REMEMBERED_CHARS = 200_000, 64
_SIDE = 20
_NONE = 1 << 62


class BytePairEncoder:
    """Encodes texts to the ids of a rank file (base64 token, rank per line; the rank is the id)."""

    def __init__(self, path: str = BYTE_BPE_50K) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = [ranks[bytes([i])] for i in range(256)]
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a << _SIDE | b] = rank
        self.pieces = regex.compile(PIECES).findall
        self.memory: dict[str, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        n, pair = len(data), self.pairs.get
        token = [self.bytes[b] for b in data]
        if n < 2:
            return token
        shift = (n - 1).bit_length()
        size, mask = 1 << shift, (1 << shift) - 1
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            rank = pair(token[i] << _SIDE | token[i + 1])
            if rank is not None:
                tree[size + i] = rank << shift | i
        for node in range(size - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (best := tree[1]) != _NONE:
            i, rank = best & mask, best >> shift
            gone = after[i]
            k = after[gone]
            token[i], after[i] = rank, k
            changes = [(gone, _NONE)]
            if k < n:
                before[k] = i
                found = pair(rank << _SIDE | token[k])
                changes.append((i, _NONE if found is None else found << shift | i))
            else:
                changes.append((i, _NONE))
            if i:
                p = before[i]
                found = pair(token[p] << _SIDE | rank)
                changes.append((p, _NONE if found is None else found << shift | p))
            for at, value in changes:
                node = size + at
                while tree[node] != value:
                    tree[node] = value
                    if node == 1:
                        break
                    other = tree[node ^ 1]
                    value = value if value < other else other
                    node >>= 1
        ids, i = [], 0
        while i < n:
            ids.append(token[i])
            i = after[i]
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty give none. Characters that UTF-8 can't hold become U+FFFD."""
        if not text:
            return []
        if not text.isascii() and regex.search(r"[\ud800-\udfff]", text):
            text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        memory, ids = self.memory, []
        for piece in self.pieces(text):
            known = memory.get(piece)
            if known is None:
                known = self.merge(piece.encode())
                if len(piece) <= REMEMBERED_CHARS:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[piece] = known
            ids += known
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> BytePairEncoder:
    """The worker's encoder of a vocabulary, loaded once."""
    return BytePairEncoder(path)


def encode_texts(docs: DataFrame, key: str, text: str, path: str = BYTE_BPE_50K) -> DataFrame:
    """(key, ids ARRAY<INT>) of each row: the ids of ``text`` without special tokens; null and empty texts give an empty list.

    The text of special tokens is ordinary text; bytes that aren't UTF-8 are read as U+FFFD. Other columns are ignored; repeated rows
    come out as often as they go in.
    """
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            ends, ids = [0], []
            for x in batch.column(1).to_pylist():
                ids += code.encode(x)
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(ids, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    return docs.select(key, F.make_valid_utf8(F.col(text).cast("string"))).mapInArrow(run, schema)


def count_tokens(docs: DataFrame, keys: list[str], text: str, path: str = BYTE_BPE_50K) -> DataFrame:
    """(keys, n_tokens LONG) of each row, with the encoding of encode_texts."""
    schema = T.StructType([*(docs.schema[k] for k in keys), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            counts = [len(code.encode(x)) for x in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(counts, pa.int64())], names=[*keys, "n_tokens"])

    return docs.select(*keys, F.make_valid_utf8(F.col(text).cast("string")).alias("__text")).mapInArrow(run, schema)
