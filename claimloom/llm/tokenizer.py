"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Two-tier lookup. A text is cut into pre-tokens; a minimal perfect hash over the vocabulary resolves those that are tokens
themselves, in one probe and one comparison; the others are merged by a heap of pairs over linked bytes, which takes
n log n steps for a pre-token of n bytes however long it is. The hash, its keys and the merge ranks are built once from the
vocabulary's file on the driver and broadcast: their size is that of the vocabulary. Results of both tiers are kept per
worker in a memo of bounded size, as pre-tokens repeat.

Defined cases: null and empty texts give an empty list; what looks like a special token is plain text; lone surrogates,
which UTF-8 can't hold, can't occur in Spark strings; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie, and the one that is used; both are parameters of every function.
TOKENIZERS = os.environ.get("CLAIMLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
# Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_vocabulary(name: str = VOCABULARY, folder: str = TOKENIZERS) -> dict[bytes, int]:
    """Token bytes to rank, which is the id too."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash by displacement: n keys in n slots; a bucket's displacement sends each of its keys to its own slot.

    Buckets are placed largest first; those of one key take the slots that are left, their displacement being the slot
    itself, written as a negative number. Keys that aren't in the table are told by comparing the slot's key.
    """

    def __init__(self, items: dict[bytes, int]):
        n = self.n = len(items)
        self.buckets = max(1, n // 3)
        self.shift = [0] * self.buckets
        self.keys: list[bytes] = [b""] * n
        self.values = [-1] * n
        by: dict[int, list[bytes]] = {}
        for k in items:
            by.setdefault(xxhash.xxh3_64_intdigest(k) % self.buckets, []).append(k)
        free = [True] * n
        singles = []
        for b, keys in sorted(by.items(), key=lambda kv: (-len(kv[1]), kv[0])):
            if len(keys) == 1:
                singles.append((b, keys[0]))
                continue
            d = 1
            while True:
                slots = {xxhash.xxh3_64_intdigest(k, d) % n for k in keys}
                if len(slots) == len(keys) and all(free[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for k in keys:
                self._put(xxhash.xxh3_64_intdigest(k, d) % n, k, items[k], free)
        left = (s for s in range(n) if free[s])
        for (b, k), s in zip(singles, list(left), strict=True):
            self.shift[b] = -s - 1
            self._put(s, k, items[k], free)

    def _put(self, slot: int, key: bytes, value: int, free: list[bool]) -> None:
        free[slot], self.keys[slot], self.values[slot] = False, key, value

    def get(self, key: bytes) -> int:
        """The key's value, or -1."""
        if not self.n:
            return -1
        d = self.shift[xxhash.xxh3_64_intdigest(key) % self.buckets]
        s = -d - 1 if d < 0 else xxhash.xxh3_64_intdigest(key, d) % self.n
        return self.values[s] if self.keys[s] == key else -1


class Encoder(dict):
    """Pre-token to ids; missing ones are computed when first asked for. ``memo``: the number of pre-tokens kept."""

    def __init__(self, ranks: PerfectHash, memo: int = 300_000):
        super().__init__()
        self.ranks, self.memo = ranks, memo
        self.pairs = dict(zip(ranks.keys, ranks.values, strict=True)).get  # ranks of parts while merging: many probes for each miss
        self.find = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8")
        whole = self.ranks.get(raw)
        ids = (whole,) if whole >= 0 else self.merged(raw)
        if len(self) >= self.memo:
            self.clear()
        if len(raw) <= 64:
            self[piece] = ids
        return ids

    def merged(self, raw: bytes) -> tuple[int, ...]:
        """Byte-pair merges of the lowest rank first, leftmost among equals, by a heap over linked parts."""
        n = len(raw)
        get = self.pairs
        end = list(range(1, n + 1))  # part i covers raw[i:end[i]]; 0 marks a part that was merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(raw[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of its two parts has changed since
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := get(raw[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := get(raw[h:stop])) is not None:
                heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(get(raw[i : end[i]]))
            i = end[i]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.find(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.__getitem__, self.find(text)))) if text else 0


_LOCAL: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder for each worker process and vocabulary, so that its memo outlives the batch."""
    if id(shared.value) not in _LOCAL:
        _LOCAL.clear()
        _LOCAL[id(shared.value)] = Encoder(shared.value)
    return _LOCAL[id(shared.value)]


def _mapped(df: DataFrame, key: str, text: str, name: str, folder: str, out: str, kind: str, make) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(PerfectHash(read_vocabulary(name, folder)))
    key_kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for b in batches:
            for start in range(0, b.num_rows, 256):  # rows of ids are many times larger than their texts
                part = b.slice(start, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), make(encoder, part.column(1).to_pylist())], names=[key, out])

    return df.select(F.col(key), F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {key_kind}, `{out}` {kind}")


def encoded(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids): the token ids of every row's text, without special tokens. Repeated rows stay; more columns are ignored."""
    return _mapped(df, key, text, name, folder, "ids", "array<int>", lambda e, texts: pa.array([e.encode(t) for t in texts], type=pa.list_(pa.int32())))


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """(key, tokens): how many tokens every row's text has; 0 for null and empty ones."""
    return _mapped(df, key, text, name, folder, "tokens", "long", lambda e, texts: pa.array([e.count(t) for t in texts], type=pa.int64()))
