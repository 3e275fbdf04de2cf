"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary resolves whole pre-tokens.
Tier 2: the rest is merged with a heap of ranked pairs over linked bytes.

Defined results: a null or empty text has no ids and decodes to the empty
string; repeated rows give repeated results; further columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .cache import Cache
from .common import give_back

#: Entries of each generation of a Python worker's caches of words and pre-tokens (some 100 MB), longest word that is kept, in characters.
CACHE_ENTRIES, CACHED_LENGTH = (250_000, 150_000), 64
#: Bytes of ids that are returned at once.
SLICE_BYTES = 4 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace.

    Keys fall into buckets; the largest buckets first look for a displacement
    that sends their keys to free slots, and buckets of one key name their slot.
    """

    def __init__(self, keys: list[bytes], load: int = 4, tries: int = 256):
        self.n, self.m = len(keys), max(1, len(keys) // load)
        h = self._hash(keys)
        if len(np.unique(h)) != self.n:
            raise ValueError("keys repeat or collide")
        bucket = self._bucket(h)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=self.m)
        starts = np.cumsum(counts) - counts
        self.shift, self.slot_key = np.zeros(self.m, np.int64), np.zeros(self.n, np.int64)
        free = np.ones(self.n, bool)
        singles = []
        for k in np.argsort(-counts, kind="stable"):
            members = order[starts[k] : starts[k] + counts[k]]
            if counts[k] == 0:
                break
            if counts[k] == 1:
                singles.append((k, members[0]))
                continue
            first = 0
            while True:
                at = self._slot(h[members, None], np.arange(first, first + tries, dtype=np.uint64))
                good = free[at].all(0)
                if good.any():
                    s = np.sort(at[:, good], axis=0)
                    apart = (s[1:] != s[:-1]).all(0)
                    if apart.any():
                        j = np.flatnonzero(good)[np.flatnonzero(apart)[0]]
                        self.shift[k] = first + j
                        free[at[:, j]] = False
                        self.slot_key[at[:, j]] = members
                        break
                first += tries
        for (k, member), slot in zip(singles, np.flatnonzero(free)):
            self.shift[k] = -1 - slot
            self.slot_key[slot] = member

    @staticmethod
    def _hash(keys: list[bytes]) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(k, 7) for k in keys), np.uint64, len(keys))

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) % np.uint64(self.m)).astype(np.int64)

    def _slot(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = (h ^ (d * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        return (((x ^ (x >> np.uint64(31))) >> np.uint64(20)) % np.uint64(self.n)).astype(np.int64)

    def key_index(self, items: list[bytes]) -> np.ndarray:
        """For each item the only key that it can equal, by its index."""
        h = self._hash(items)
        d = self.shift[self._bucket(h)]
        slot = np.where(d < 0, -1 - d, self._slot(h, np.maximum(d, 0).astype(np.uint64)))
        return self.slot_key[slot]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: always the lowest-ranked neighbouring pair, leftmost first."""
    n, get, push, pop = len(piece), ranks.get, heapq.heappush, heapq.heappop
    end, before = list(range(1, n + 1)), list(range(-1, n))
    # a heap entry is one number: rank, start and end of a pair; it is stale unless both its halves still stand
    bits = n.bit_length()
    low, two = (1 << bits) - 1, 2 * bits
    heap = [r << two | i << bits | i + 2 for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        x = pop(heap)
        stop, i = x & low, x >> bits & low
        mid = end[i]
        if mid < 0 or mid >= n or end[mid] != stop:
            continue
        end[i], end[mid], before[stop] = stop, -1, i
        if stop < n and (r := get(piece[i : (e := end[stop])])) is not None:
            push(heap, r << two | i << bits | e)
        if (p := before[i]) >= 0 and (r := get(piece[p:stop])) is not None:
            push(heap, r << two | p << bits | stop)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_entries: tuple[int, int] = CACHE_ENTRIES):
        self.ranks, self.pattern, self.cache_entries = ranks, pattern, cache_entries
        self.keys = list(ranks)
        self.hash = PerfectHash(self.keys)
        self._ready()

    def _ready(self) -> None:
        self.find = regex.compile(self.pattern).findall
        self.spaced = regex.compile(r"\s").search
        self.word, self.packed = (Cache(n) for n in self.cache_entries)
        self.ids = np.array([self.ranks[k] for k in self.keys], np.int64)
        self.token = {i: k for k, i in self.ranks.items()}

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("ranks", "pattern", "cache_entries", "keys", "hash")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def _learn(self, pieces) -> dict[str, bytes]:
        """Packed ids of the different ``pieces`` (pre-tokens); long ones aren't kept."""
        pieces = set(pieces)
        short = {x for x in pieces if len(x) <= CACHED_LENGTH}
        new = self.packed.unknown(short)
        known = self.packed.now
        found = {}
        for part in (new, [x for x in pieces if len(x) > CACHED_LENGTH]):
            into = known if part is new else found
            raw = [x.encode() for x in part]
            for text, piece, k in zip(part, raw, self.hash.key_index(raw).tolist()):
                if self.keys[k] == piece:
                    into[text] = struct.pack("<I", self.ids[k])
                else:
                    ids = merge(piece, self.ranks)
                    into[text] = struct.pack(f"<{len(ids)}I", *ids)
        return known if not found else {x: known[x] for x in short} | found

    def _pieces(self, parts: list[str]) -> bytes:
        return b"".join(map(self._learn(parts).__getitem__, parts))

    def _learn_words(self, new: list[str]) -> dict[str, bytes | None]:
        """Words after one space, or after one line feed that the word then starts with.

        Such a word's pre-tokens don't depend on what stands around it, unless
        it is empty or holds white space: then it is None, and the whole text is split at once.
        """
        good = [w for w in new if (body := w[1:] if w[:1] == "\n" else w) and not self.spaced(body)]
        split = [self.find(w if w[0] == "\n" else " " + w) for w in good]
        packed = self._learn(x for parts in split for x in parts)
        return dict.fromkeys(new) | {w: b"".join([packed[x] for x in parts]) for w, parts in zip(good, split)}

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        first, *rest = text.replace("\n", " \n").split(" ")
        if not first or self.spaced(first):
            return self._pieces(self.find(text))
        different = set(rest)
        long = [w for w in different if len(w) > CACHED_LENGTH]
        new = self.word.unknown(different.difference(long) if long else different)
        word = self.word.now
        if new:
            word.update(self._learn_words(new))
        if long:
            word = {w: word[w] for w in different.difference(long)} | self._learn_words(long)
        try:
            return self._pieces(self.find(first)) + b"".join(map(word.__getitem__, rest))
        except TypeError:  # None stands for a word that can't be taken alone
            return self._pieces(self.find(text))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def decode_packed(self, packed: bytes) -> bytes:
        return self.decode(np.frombuffer(packed, "<u4").tolist())


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = True, cache_entries: tuple[int, int] = CACHE_ENTRIES) -> DataFrame:
    """Per row: key, n_tokens, ids_sha256, decoded_sha256, ids (array). No shuffle.

    ``ranks_path`` is read by the driver; the model of a few MB is broadcast.
    Rows are returned as soon as their ids fill SLICE_BYTES. Smaller caches take
    less of a worker's memory and more time; results don't depend on them.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(ByteBPE(load_ranks(ranks_path), pattern, cache_entries))
    schema = StructType([StructField(key, docs.schema[key].dataType)])
    for name, kind in (("n_tokens", LongType()), ("ids_sha256", StringType()), ("decoded_sha256", StringType()), ("ids", ArrayType(IntegerType())))[: 4 if with_ids else 3]:
        schema = schema.add(name, kind)

    def run(batches):
        give_back()  # what earlier stages left in this worker
        bpe = model.value

        def slice_(batch, at, packed, plain):
            columns = [batch.column(0).slice(at, len(packed)), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in packed]), pa.array(plain)]
            if with_ids:
                ends = np.cumsum([0] + [len(p) // 4 for p in packed]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4"))))
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            at, held, packed, plain = 0, 0, [], []
            for t in batch.column(1):
                packed.append(bpe.encode_packed(t.as_py() or ""))
                plain.append(hashlib.sha256(bpe.decode_packed(packed[-1])).hexdigest())
                held += len(packed[-1])
                if held >= SLICE_BYTES:
                    yield slice_(batch, at, packed, plain)
                    at, held, packed, plain = at + len(packed), 0, [], []
            if packed:
                yield slice_(batch, at, packed, plain)

    return docs.select(docs[key].alias(key), docs[text].alias("__text")).mapInArrow(run, schema)
