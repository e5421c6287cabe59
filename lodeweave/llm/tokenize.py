"""Byte-level BPE of a public vocabulary, by a queue of merge ranks under a hierarchical bitmap.

Each merge rank has a bucket of positions in a linked list of tokens; a two-level bitmap
says which buckets hold anything, and its lowest set bit is the next rank. A merge pushes
the two pairs it makes into their buckets; entries that a merge made stale are skipped when
their bucket is emptied. The cost of a pre-token grows in step with its length, so very
long pre-tokens (encoded images, rulers, runs of letters) are no special case.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.session import spread

#: File of the vocabulary as ranks; LODEWEAVE_VOCABULARY names another.
DEFAULT_FILE = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pre-tokens remembered by a worker, and the longest that is remembered.
MEMO_SIZE = 150_000
MEMO_LENGTH = 48
_WORD = 256  # bits of a word of the bitmap


def vocabulary_path(path: str | None = None) -> str:
    """Where the vocabulary is: the parameter, the environment, or the installed public package."""
    if path or os.environ.get("LODEWEAVE_VOCABULARY"):
        return path or os.environ["LODEWEAVE_VOCABULARY"]
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, DEFAULT_FILE)


class Encoder:
    """Text to token ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.first = [self.ranks[bytes([b])] for b in range(256)]
        self.split = regex.compile(PATTERN).findall
        self.pairs: dict[int, int] = {}
        self.memo: dict[str, list[int]] = {}
        size = max(self.ranks.values()) + 1
        self.words = [0] * (size // _WORD + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def rank(self, a: int, b: int) -> int:
        """The id that the pair merges to, which is also its rank; -1 for none."""
        key = a << 20 | b
        r = self.pairs.get(key)
        if r is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            r = self.pairs[key] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return r

    def push(self, r: int, at: int) -> None:
        bucket = self.buckets.get(r)
        if bucket is None:
            self.buckets[r] = [at]
            self.words[r // _WORD] |= 1 << r % _WORD
            self.top |= 1 << r // _WORD
        else:
            bucket.append(at)

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank and its bucket, taken out of the queue."""
        w = (self.top & -self.top).bit_length() - 1
        word = self.words[w]
        low = word & -word
        self.words[w] = word ^ low
        if word == low:
            self.top ^= 1 << w
        r = w * _WORD + low.bit_length() - 1
        return r, self.buckets.pop(r)

    def merge(self, data: bytes) -> list[int]:
        """Token ids of one pre-token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        ids = [self.first[b] for b in data]
        after = list(range(1, n + 1))  # n stands for the end
        before = list(range(-1, n - 1))
        rank, push = self.rank, self.push
        for i in range(n - 1):
            r = rank(ids[i], ids[i + 1])
            if r >= 0:
                push(r, i)
        while self.top:
            # Pairs that hold the new token have higher ranks, so the bucket is complete; leftmost goes first.
            r, bucket = self.pop()
            bucket.sort()
            for i in bucket:
                if ids[i] < 0:
                    continue
                j = after[i]
                if j >= n or rank(ids[i], ids[j]) != r:
                    continue
                ids[i], ids[j] = r, -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    x = rank(r, ids[k])
                    if x >= 0:
                        push(x, i)
                h = before[i]
                if h >= 0:
                    x = rank(ids[h], r)
                    if x >= 0:
                        push(x, h)
        return [t for t in ids if t >= 0]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text without special tokens; none for null and empty texts."""
        if not text:
            return []
        out: list[int] = []
        memo = self.memo
        for piece in self.split(text):
            got = memo.get(piece)
            if got is None:
                got = self.merge(piece.encode("utf-8", "replace"))
                if len(piece) <= MEMO_LENGTH:
                    if len(memo) >= MEMO_SIZE:
                        memo.clear()
                    memo[piece] = got
            out += got
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.bytes_of[i] for i in ids)


def encode_column(df: DataFrame, *, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids) of every row: the token ids of the whole text, an empty list for empty and null texts."""
    where = vocabulary_path(path)
    kind = dict(df.dtypes)[id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(where)
        for b in batches:
            flat: list[int] = []
            offsets = [0]
            for t in b.column(1).to_pylist():
                flat += encoder.encode(t)
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(offsets, dtype=np.int32)), pa.array(np.array(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [id, "ids"])

    return spread(df.select(id, text)).mapInArrow(run, f"`{id}` {kind}, ids array<int>")


def decoded(df: DataFrame, *, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with the column decoded: the text of the ids, empty for none, null for null."""
    where = vocabulary_path(path)

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(where)
        for b in batches:
            yield b.map(lambda x: None if x is None else encoder.decode(x.tolist()).decode("utf-8", "replace"))

    return df.withColumn("decoded", text_of(F.col(ids)))
