"""Token ids of every text under a public byte-level BPE vocabulary.

Two tiers: a minimal perfect hash answers for pre-tokens that are vocabulary entries
as a whole; the rest is merged with a heap over a doubly linked list of bytes.  Pieces
between white space repeat, so a bounded memo sits in front of both.

The vocabulary (a fixed file of 50,256 entries, under 1 MB) is read by the driver and
shipped with the function; texts are encoded where they lie, without a shuffle.

Defined results: null and empty texts give an empty list; strings of special tokens are
ordinary text; a text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the pre-token pattern of the vocabulary byte_bpe_50k.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the pattern sees it (Unicode White_Space); the boundary before such a run always ends a pre-token.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
MEMO = 1 << 18
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_ranks(path: str = VOCABULARY) -> list[bytes]:
    """Entries by id."""
    pairs = [line.split() for line in Path(path).read_bytes().splitlines() if line]
    out = [b""] * len(pairs)
    for word, rank in pairs:
        out[int(rank)] = base64.b64decode(word)
    return out


class PerfectHash:
    """bytes -> position of a fixed set, minimal: n slots for n keys (hash, displace)."""

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        n = self.n = len(keys)
        self.m = max(1, n // per_bucket)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        buckets: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            buckets.setdefault(h % self.m, []).append(i)
        self.seeds, self.slots = [0] * self.m, [-1] * n
        free = None
        for b, members in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(members) == 1:
                if free is None:
                    free = iter([i for i, s in enumerate(self.slots) if s < 0])
                at = next(free)
                self.slots[at], self.seeds[b] = members[0], -at - 1
                continue
            seed = 1
            while True:
                spots = [self._mix(hashes[i], seed) for i in members]
                if len(set(spots)) == len(spots) and all(self.slots[s] < 0 for s in spots):
                    break
                seed += 1
            self.seeds[b] = seed
            for i, s in zip(members, spots):
                self.slots[s] = i
        self.keys = keys

    def _mix(self, h: int, seed: int) -> int:
        x = (h ^ (seed * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 32)) % self.n

    def get(self, key: bytes) -> int:
        """Position of the key, -1 for others."""
        h = xxhash.xxh3_64_intdigest(key)
        seed = self.seeds[h % self.m]
        if not seed:
            return -1
        i = self.slots[-seed - 1 if seed < 0 else self._mix(h, seed)]
        return i if self.keys[i] == key else -1


class Encoder:
    def __init__(self, entries: PerfectHash):
        self.hash = entries
        self.split = regex.compile(PATTERN)
        self.memo: dict[str, list[int]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Byte pairs by rank, leftmost first: a heap of pairs over linked pieces."""
        rank, n = self.hash.get, len(word)
        start, end = list(range(n)), list(range(1, n + 1))  # piece i is word[start[i]:end[i]]
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []
        for i in range(n - 1):
            if (r := rank(word[i : i + 2])) >= 0:
                heap.append((r, i, 2))
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or end[j] - start[i] != size:
                continue  # one of the two has grown or gone since
            end[i], alive[j] = end[j], False
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(word[start[i] : end[k]])) >= 0:
                    heapq.heappush(heap, (r, i, end[k] - start[i]))
            if (h := before[i]) >= 0 and (r := rank(word[start[h] : end[i]])) >= 0:
                heapq.heappush(heap, (r, h, end[i] - start[h]))
        return [rank(word[start[i] : end[i]]) for i in range(n) if alive[i]]

    def piece(self, s: str) -> list[int]:
        out: list[int] = []
        for token in self.split.findall(s):
            word = token.encode("utf-8", "replace")
            whole = self.hash.get(word)
            if whole >= 0:
                out.append(whole)
            else:
                out += self.merge(word)
        if len(self.memo) >= MEMO:
            self.memo.clear()
        if len(s) <= 64:
            self.memo[s] = out
        return out

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            memo, piece = self.memo.get, self.piece
            for s in PIECE.findall(text):
                out += memo(s) or piece(s)
        return out


@functools.lru_cache(maxsize=2)
def perfect_hash(vocabulary: str) -> PerfectHash:
    """Built once by the driver."""
    return PerfectHash(read_ranks(vocabulary))


def encode(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, out: str = "ids") -> DataFrame:
    """(key, ids ARRAY<INT>) of every row."""
    entries = df.sparkSession.sparkContext.broadcast(perfect_hash(vocabulary))  # 50,256 entries by the format of the file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(entries.value)
        for batch in batches:
            ids, ends = [], [0]
            for t in batch.column(1).to_pylist():
                ids += coder.encode(t)
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(ids, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, out])

    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField(out, T.ArrayType(T.IntegerType()))])
    return df.select(key, F.col(text).cast("string")).mapInArrow(run, schema)
