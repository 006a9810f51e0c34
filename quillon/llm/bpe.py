"""Byte-level BPE encoding and decoding over a fixed public vocabulary.

Tier 1: a minimal perfect hash maps a whole pre-token that is in the vocabulary to its id.
Tier 2: any other pre-token is merged with a heap of candidate pairs over a linked list of bytes.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillon.llm.common import column, lean, texts

_PRIME = (1 << 61) - 1
#: Entries of a worker's table of pre-tokens already resolved; the half used longest ago goes when it is full; results don't depend on it.
MEMO_ENTRIES = 600_000
#: Code points below U+0250 by the pattern's classes, so that the faster stdlib engine can split most texts.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_ANY_S = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LATIN = re.compile(rf" ?[{_L}]+| ?[{_N}]+|'(?:[stmd]|re|ve|ll)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_ANY = regex.compile(rf" ?\p{{L}}+| ?\p{{N}}+|'(?:[stmd]|re|ve|ll)| ?[^{_ANY_S}\p{{L}}\p{{N}}]+|[{_ANY_S}]+(?![^{_ANY_S}])|[{_ANY_S}]+")
_BEYOND = re.compile("[^\x00-\u024f]")


def pre_tokens(text: str) -> list[str]:
    """The text cut by the public pattern: contractions, letters, digits, other signs, white space."""
    return (_ANY if not text.isascii() and _BEYOND.search(text) else _LATIN).findall(text)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a .tiktoken rank file or a byte-level .json tokenizer."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model.get("added_tokens", [])}
        back = _byte_of_char()
        return {bytes(back[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(i) for t, i in (line.split() for line in f if line.strip())}


def _byte_of_char() -> dict[str, int]:
    # printable bytes stand for themselves, the others for the code points from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PerfectHash:
    """A minimal perfect hash of byte strings: n keys on n slots, by bucket displacements."""

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // 2)
        self.shift = np.zeros(self.buckets, np.int64)
        self.slot_key: list[bytes] = [b""] * self.n
        by: dict[int, list[bytes]] = {}
        for k in keys:
            by.setdefault(xxhash.xxh64_intdigest(k) % self.buckets, []).append(k)
        free = bytearray(b"\1") * self.n
        order = sorted(by, key=lambda b: (-len(by[b]), b))
        for at, b in enumerate(order):
            group = by[b]
            if len(group) == 1:
                break
            hashes = [xxhash.xxh64_intdigest(k) for k in group]
            d = 1
            while True:
                slots = [self._slot(h, d) for h in hashes]
                if len(set(slots)) == len(slots) and all(free[s] for s in slots):
                    break
                d += 1
            self._place(b, d, group, slots, free)
        else:
            at = len(order)
        holes = (s for s in range(self.n) if free[s])
        for b in order[at:]:  # a bucket of one key takes any slot left, written as a negative number
            s = next(holes)
            self.shift[b] = -s - 1
            self.slot_key[s] = by[b][0]

    def _place(self, b, d, group, slots, free):
        self.shift[b] = d
        for k, s in zip(group, slots, strict=True):
            free[s] = 0
            self.slot_key[s] = k

    def _slot(self, h: int, d: int) -> int:
        return ((h & 0xFFFFFFFF) + d * ((h >> 32) | 1)) % _PRIME % self.n

    def find(self, key: bytes) -> int:
        """The key's slot; -1 if it is not one of the keys."""
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(key)
        d = self.shift.item(h % self.buckets)
        s = -d - 1 if d < 0 else self._slot(h, d)
        return s if self.slot_key[s] == key else -1


class ByteBpe:
    """Encodes and decodes with one vocabulary, whose ids are its merge ranks; every single byte has an id."""

    def __init__(self, ranks: dict[bytes, int], table: PerfectHash | None = None):
        self.ranks = ranks
        self.hash = table or PerfectHash(sorted(ranks))
        self.slot_id = [ranks[k] for k in self.hash.slot_key]
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        self.wide = max(ranks.values()) + 1

    @cached_property
    def byte_of(self) -> dict[int, bytes]:
        return {i: t for t, i in self.ranks.items()}

    @cached_property
    def pairs(self) -> dict[int, int]:
        """The rank of what two adjacent parts join to, by their ids."""
        ranks = self.ranks
        return {
            ranks[t[:k]] * self.wide + ranks[t[k:]]: i
            for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks
        }

    def whole(self, token: bytes) -> int | None:
        s = self.hash.find(token)
        return None if s < 0 else self.slot_id[s]

    def merge(self, token: bytes) -> list[int]:
        """Lowest rank first, leftmost first: a heap of pairs over linked parts; O(n log n) for n bytes."""
        n, pair, wide = len(token), self.pairs.get, self.wide
        part = [self.byte_id[b] for b in token]  # the id of the part that starts here; -1: merged into an earlier one
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r * n + i for i, r in enumerate(map(pair, [a * wide + b for a, b in zip(part, part[1:])])) if r is not None]  # noqa: B905
        heapify(heap)
        while heap:
            rank, i = divmod(heappop(heap), n)
            j = after[i]
            if part[i] < 0 or j >= n or pair(part[i] * wide + part[j]) != rank:
                continue
            part[i], part[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := pair(rank * wide + part[k])) is not None:
                    heappush(heap, r * n + i)
            if (p := before[i]) >= 0 and (r := pair(part[p] * wide + rank)) is not None:
                heappush(heap, r * n + p)
        return [x for x in part if x >= 0]

    def token_ids(self, token: bytes) -> list[int]:
        one = self.whole(token)
        return self.merge(token) if one is None else [one]

    def encoder(self) -> Callable[[str], bytes]:
        """text -> ids as little-endian unsigned 32-bit integers; keeps a bounded memo of pre-tokens."""
        memo: dict[str, bytes] = {}
        older: dict[str, bytes] = {}

        def resolve(t: str) -> bytes:
            nonlocal memo, older, get
            if len(memo) >= MEMO_ENTRIES // 2:
                memo, older = {}, memo
                get = memo.get
            if (out := older.get(t)) is not None:
                memo[t] = out
                return out
            b = t.encode("utf-8")
            one = self.whole(b)
            ids = self.merge(b) if one is None else [one]
            out = array("I", ids).tobytes()
            if len(b) <= 64:
                memo[t] = out
            return out

        get = memo.get

        def encode_text(text: str) -> bytes:
            known = get
            return b"".join([known(t) or resolve(t) for t in pre_tokens(text)])

        return encode_text

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.byte_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def pack_ranks(ranks: dict[bytes, int]) -> bytes:
    """Vocabulary and perfect hash as one compact value for workers; its size is the vocabulary's, whatever the data."""
    table = PerfectHash(sorted(ranks))
    keys = table.slot_key
    head = np.array([len(keys), table.buckets], "<i8").tobytes()
    return head + table.shift.astype("<i8").tobytes() + np.array([*map(len, keys), *(ranks[k] for k in keys)], "<u4").tobytes() + b"".join(keys)


@lru_cache(maxsize=4)
def packed_vocabulary(vocab_path: str) -> bytes:
    return pack_ranks(read_ranks(vocab_path))


@lru_cache(maxsize=1)
def load_packed(data: bytes) -> ByteBpe:
    """The codec for packed ranks; built once in each Python worker."""
    n, buckets = np.frombuffer(data[:16], "<i8").tolist()
    at = 16 + 8 * buckets
    lengths, ids = np.frombuffer(data[at : at + 8 * n], "<u4").reshape(2, n).tolist()
    at += 8 * n
    keys = []
    for size in lengths:
        keys.append(data[at : at + size])
        at += size
    table = PerfectHash([])
    table.n, table.buckets, table.shift, table.slot_key = n, buckets, np.frombuffer(data[16 : 16 + 8 * buckets], "<i8"), keys
    return ByteBpe(dict(zip(keys, ids, strict=True)), table)


def encode(df: DataFrame, vocab_path: str, keep: list[str], text: str = "text", ids: str = "ids", count: str = "n_tokens") -> DataFrame:
    """The `keep` columns plus ids (binary, little-endian unsigned 32-bit) and their number (long).

    The whole text is encoded without special tokens. Null texts encode as empty ones, with no ids. Very
    long texts are encoded whole; repeated rows and empty tables need nothing special. Other columns
    are not read. The vocabulary is read by the driver and broadcast (its size is the file's).
    """
    shared = df.sparkSession.sparkContext.broadcast(packed_vocabulary(vocab_path))
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(ids, T.BinaryType()), T.StructField(count, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            enc = load_packed(shared.value).encoder()
            for batch in batches:
                for part, values in texts(batch, "_text"):
                    out = [enc(t) if t else b"" for t in values]
                    yield pa.RecordBatch.from_arrays(
                        [*(column(part, f"_k{i}") for i in range(len(keep))), pa.array(out, pa.binary()), pa.array([len(o) // 4 for o in out], pa.int64())],
                        names=[*keep, ids, count],
                    )

    return df.select(*(df[c].alias(f"_k{i}") for i, c in enumerate(keep)), df[text].alias("_text")).mapInArrow(run, schema)


def decode(df: DataFrame, vocab_path: str, keep: list[str], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The `keep` columns plus the bytes that the ids stand for (binary). Null ids decode to no bytes."""
    shared = df.sparkSession.sparkContext.broadcast(packed_vocabulary(vocab_path))
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            codec = load_packed(shared.value)
            for batch in batches:
                for part, values in texts(batch, "_ids"):
                    yield pa.RecordBatch.from_arrays(
                        [*(column(part, f"_k{i}") for i in range(len(keep))), pa.array([codec.decode(v or b"") for v in values], pa.binary())], names=[*keep, out]
                    )

    return df.select(*(df[c].alias(f"_k{i}") for i, c in enumerate(keep)), df[ids].alias("_ids")).mapInArrow(run, schema)
