"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is split into pre-tokens by the vocabulary's pattern. Tier one is a minimal perfect hash over
the vocabulary: a pre-token that is a token itself gets its id from one probe. Tier two merges what
is left: bytes in a linked list and a heap of the ranks of neighbouring pairs, so that a pre-token
of n bytes takes O(n log n), whatever its length. The ranks of pairs come from a dictionary of the vocabulary.

Both tiers work on the distinct pre-tokens of a text; a cache of bounded bytes keeps short ones between
texts. The vocabulary travels as bytes read from a path on the driver, once per task.

Defined results: a null text is encoded as the empty text, which has no ids; repeated rows are
encoded alike; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import map_arrow

#: Characters of pre-tokens that a worker keeps with their ids; when full, the cache starts anew. A longer pre-token
#: than LONG is looked up each time. No result depends on either.
CACHE, LONG = 4_000_000, 64
#: Rows that are encoded together.
ROWS = 1000


def read_ranks(data: bytes) -> list[bytes]:
    """Tokens by rank from the lines of a rank file."""
    pairs = [line.split() for line in data.splitlines() if line.strip()]
    out = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class PerfectHash:
    """A minimal perfect hash by displacement: n keys in n slots, no two in one.

    A key's bucket names a displacement seed; the key's hash under that seed is its slot. The slot's
    own key is compared, so a string that is no key is told from one that is.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 4) -> None:
        self.n = n = len(keys)
        self.buckets = m = max(1, -(-n // per_bucket))
        self.seeds = [0] * m
        self.values = [-1] * n
        self.keys = [b""] * n
        groups: list[list[int]] = [[] for _ in range(m)]
        for i, k in enumerate(keys):
            groups[xxhash.xxh64_intdigest(k) % m].append(i)
        free = bytearray(b"\x01") * n
        singles: list[int] = []
        for b in sorted(range(m), key=lambda b: -len(groups[b])):
            own = groups[b]
            if len(own) < 2:
                singles += [b] if own else []
                continue
            seed = 1
            while True:
                slots = {xxhash.xxh64_intdigest(keys[i], seed) % n for i in own}
                if len(slots) == len(own) and all(free[s] for s in slots):
                    break
                seed += 1
            self.seeds[b] = seed
            for i in own:
                self._put(xxhash.xxh64_intdigest(keys[i], seed) % n, i, keys, free)
        # A bucket of one key names its slot itself, as a negative seed.
        rest = (s for s in range(n) if free[s])
        for b, s in zip(singles, list(rest), strict=False):
            self.seeds[b] = -s - 1
            self._put(s, groups[b][0], keys, free)

    def _put(self, slot: int, i: int, keys: list[bytes], free: bytearray) -> None:
        free[slot], self.values[slot], self.keys[slot] = 0, i, keys[i]

    def get(self, key: bytes) -> int:
        """The key's value, or -1."""
        if not self.n:
            return -1
        seed = self.seeds[xxhash.xxh64_intdigest(key) % self.buckets]
        slot = -seed - 1 if seed < 0 else xxhash.xxh64_intdigest(key, seed) % self.n
        return self.values[slot] if self.keys[slot] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the lowest-ranked neighbouring pair first, the leftmost of equals."""
    n = len(piece)
    end = list(range(1, n + 1))  # where the part that starts here ends; 0: no part starts here
    before = list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        if not (mid := end[i]) or mid == n or ranks.get(piece[i : end[mid]]) != rank:
            continue  # one of the two parts has been merged since
        end[i], end[mid] = end[mid], 0
        if end[i] < n:
            before[end[i]] = i
            if (r := ranks.get(piece[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (r, i))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p : end[i]])) is not None:
            heapq.heappush(heap, (r, p))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        self.tokens = read_ranks(ranks)
        self.split = regex.compile(pattern)
        self.whole = PerfectHash(self.tokens)
        self.ranks = {t: i for i, t in enumerate(self.tokens)}
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def piece(self, text: str) -> bytes:
        """The ids of a pre-token, as little-endian unsigned 32-bit integers."""
        data = text.encode("utf-8", "surrogatepass")
        if (found := self.whole.get(data)) >= 0:
            return struct.pack("<I", found)
        ids = merge(data, self.ranks)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as little-endian unsigned 32-bit integers."""
        cache, pieces = self.cache, self.split.findall(text)
        missing = set(pieces).difference(cache)
        if not missing:
            return b"".join(map(cache.__getitem__, pieces))
        own = {p: self.piece(p) for p in missing}
        short = {p: ids for p, ids in own.items() if len(p) <= LONG}
        self.held += sum(map(len, short))
        if self.held > CACHE:
            self.cache = cache = {p: cache[p] for p in set(pieces) if p in cache}
            self.held = sum(map(len, cache)) + sum(map(len, short))
        cache.update(short)
        if len(short) == len(own):
            return b"".join(map(cache.__getitem__, pieces))
        return b"".join([own[p] if p in own else cache[p] for p in pieces])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(ranks: bytes, pattern: str) -> Codec:
    """One codec per Python worker, kept between tasks."""
    return Codec(ranks, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array) and decoded (the bytes decoded again): one row per row of ``docs``."""
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, under 2 MB
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded binary" * with_decoded

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value, pattern)
        # Some rows at a time, so that no more than their ids are held.
        for b in (x.slice(a, ROWS) for x in batches for a in range(0, x.num_rows, ROWS)):
            n, ids_sha, out_sha, ids, decoded = [], [], [], [], []
            for t in b.column(1):
                got = own.encode(t.as_py() or "")
                back = own.decode(got)
                n.append(len(got) // 4)
                ids_sha.append(hashlib.sha256(got).hexdigest())
                out_sha.append(hashlib.sha256(back).hexdigest())
                if with_ids:
                    ids.append(got)
                if with_decoded:
                    decoded.append(back)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), flat))
                names.append("ids")
            if with_decoded:
                cols.append(pa.array(decoded, pa.binary()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return map_arrow(slim, run, schema)
