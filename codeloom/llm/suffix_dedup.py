"""Removal of repeated byte strings with suffix arrays by induced sorting.

A byte goes if a string of WIDTH bytes that covers it also starts earlier.

Sharding. A window of WIDTH bytes is known by its anchor: the smallest hash among
the GRAM-byte strings in it, the leftmost of equals. Equal windows have equal
anchors at the same place, so windows that can be equal meet in one shard.
Neighbouring windows with one anchor make one snippet (some 140 bytes). Snippets
that are equal as a whole are told by two 64-bit hashes; all but the first go as
they are. What is left of anchors with different snippets is sorted.

Sorting. A shard's snippets are joined with separators and sorted by induced
sorting: suffixes are classified, leftmost-smaller (LMS) substrings sorted and
named, the string of names sorted recursively, and the order induced bucket by
bucket. Permuted common prefixes, up to WIDTH, then tell the classes of equal
windows; in each class all but the earliest go.

Defined results: null and empty texts have nothing to remove; texts under WIDTH
bytes are kept whole; null keys come last; of rows that repeat a key and text the
first stays; rows that repeat a key only are ordered by text; matches never cross
documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Length of the strings; of the grams whose hashes are anchors; bytes of a sorted shard; bytes hashed at once.
WIDTH, GRAM, SHARD_BYTES, CHUNK = 100, 16, 1 << 20, 1 << 22
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE = np.uint64((1 << 24) - 1)


class _Roller:
    """Rolling hashes of all substrings of a chunk, modulo 2^64."""

    def __init__(self):
        rng = np.random.default_rng(6)
        self.table = rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        n = CHUNK + 4 * WIDTH
        inverse = pow(_BASE, -1, 1 << 64)
        self.up, self.down = (self._powers(b, n) for b in (_BASE, inverse))

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n + 1, np.uint64(base))
        out[0] = 1
        return np.multiply.accumulate(out)

    def __call__(self, x: np.ndarray) -> None:
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(self.table[x] * self.up[: len(x)], out=self.sums[1:])

    def at(self, start: np.ndarray | int, stop: np.ndarray) -> np.ndarray:
        h = (self.sums[stop] - self.sums[start]) * self.down[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))

    def grams(self, n: int) -> np.ndarray:
        h = (self.sums[GRAM : n + 1] - self.sums[: n + 1 - GRAM]) * self.down[: n + 1 - GRAM]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        v = np.minimum(v[:-done], v[done:])
        done *= 2
    return np.minimum(v[: len(v) - (width - done)], v[width - done :]) if width > done else v


def snippets(x: np.ndarray, ends: np.ndarray, roll: _Roller):
    """For joined pieces that end at ``ends``: anchor, content, first byte, bytes and piece of each snippet."""
    roll(x)
    n = len(x) - WIDTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, none
    grams = roll.grams(len(x))
    packed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    place = (_sliding_min(packed, WIDTH - GRAM + 1) & _PLACE).astype(np.int32)
    piece_end = np.repeat(ends, np.diff(ends, prepend=0))[:n]
    good = np.arange(n) + WIDTH <= piece_end
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | (good[1:] != good[:-1]) | (piece_end[1:] != piece_end[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    keep = good[first]
    first, last = first[keep], last[keep]
    m = place[first]
    size = last - first + WIDTH
    content = roll.at(first, first + size) ^ (((m - first).astype(np.uint64) * np.uint64(256) + size.astype(np.uint64)) * np.uint64(_BASE))
    return grams[m].view(np.int64), content.view(np.int64), first, size, np.searchsorted(ends, first, "right")


_EVENT = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("key", pa.int64()), ("no", pa.int32()), ("at", pa.int64()), ("size", pa.int32()), ("local", pa.bool_())])


def _snippet_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Snippets of all texts; those that repeat within one text (``local``) go without comparison."""
    roll = _Roller()

    def flush(pieces, owners):
        x = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        anchor, content, first, size, piece = snippets(x, ends, roll)
        if not len(anchor):
            return None
        starts = ends - [len(p) for p in pieces]
        key, null, no, base, doc = (np.array(c) for c in zip(*owners))
        order = np.lexsort((first, content, doc[piece]))
        a, c, d = anchor[order], content[order], doc[piece][order]
        local = np.zeros(len(order), bool)
        local[order[1:]] = (a[1:] == a[:-1]) & (c[1:] == c[:-1]) & (d[1:] == d[:-1])
        at = first - starts[piece] + base[piece]
        # what goes anyway is spread by its place, runs of it joined
        mark = np.flatnonzero(local)
        if len(mark):
            join = np.zeros(len(mark), bool)
            join[1:] = (piece[mark[1:]] == piece[mark[:-1]]) & (at[mark[1:]] <= at[mark[:-1]] + size[mark[:-1]])
            head = np.flatnonzero(~join)
            stop = np.maximum.reduceat(at[mark] + size[mark], head)
            keep = np.flatnonzero(~local)
            take = np.concatenate([keep, mark[head]])
            size = np.concatenate([size[keep], stop - at[mark[head]]])
            anchor, content, local, at, piece = anchor[take], content[take], local[take], at[take], piece[take]
            anchor = np.where(local, content ^ (at * 0x9E3779B1), anchor)
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(content), pa.array(key[piece], pa.int64(), mask=null[piece].astype(bool)), pa.array(no[piece].astype(np.int32)), pa.array(at.astype(np.int64)), pa.array(size.astype(np.int32)), pa.array(local)], schema=_EVENT)

    pieces, owners, held, doc = [], [], 0, 0
    for batch in batches:
        for key, no, text in zip(*(c.to_pylist() for c in batch.columns)):
            doc += 1
            if not text or len(text) < WIDTH:
                continue
            for base in range(0, len(text) - WIDTH + 1, CHUNK // 2):
                piece = text[base : base + CHUNK // 2 + WIDTH - 1]
                if held + len(piece) > CHUNK:
                    if (out := flush(pieces, owners)) is not None:
                        yield out
                    pieces, owners, held = [], [], 0
                pieces.append(piece)
                owners.append((key or 0, key is None, no, base, doc))
                held += len(piece)
    if pieces and (out := flush(pieces, owners)) is not None:
        yield out


# induced sorting


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last place holds the smallest letter alone."""
    n = len(s)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1])
    step[-1] = 1
    known = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(known[::-1])[::-1]
    return step[nearest] > 0


def _induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, letters: int) -> np.ndarray:
    """The order of all suffixes from that of the LMS suffixes; a bucket's members move at once."""
    larger: list[list[np.ndarray]] = [[] for _ in range(letters)]
    empty = np.zeros(0, lms.dtype)

    def grow(seed: list[np.ndarray], of: int, want: bool) -> np.ndarray:
        """A bucket's own members put their predecessors of the same letter behind themselves."""
        front = np.concatenate(seed) if seed else empty
        parts = [front]
        while len(front):
            before = front[front > 0] - 1
            front = before[(s[before] == of) & (smaller[before] == want)]
            parts.append(front)
        return np.concatenate(parts)

    def deal(members: np.ndarray, of: int, want: bool, buckets) -> None:
        before = members[members > 0] - 1
        before = before[(smaller[before] == want) & (s[before] != of)]
        if len(before):
            letter = s[before]
            order = np.argsort(letter, kind="stable")
            before, letter = before[order], letter[order]
            cuts = np.flatnonzero(letter[1:] != letter[:-1]) + 1
            for part, c in zip(np.split(before, cuts), letter[np.append(0, cuts)].tolist()):
                buckets[c].append(part)

    first = s[lms]
    cut = np.searchsorted(first, np.arange(letters + 1)) if len(lms) else np.zeros(letters + 1, np.int64)
    big = []
    for c in range(letters):
        own = grow(larger[c], c, False)
        big.append(own)
        deal(np.concatenate([own, lms[cut[c] : cut[c + 1]]]), c, False, larger)
    # from the right: members of a bucket are met in falling order
    small: list[list[np.ndarray]] = [[] for _ in range(letters)]
    out: list[np.ndarray] = []
    small[int(s[-1])].append(np.array([len(s) - 1], lms.dtype))
    for c in range(letters - 1, -1, -1):
        own = grow(small[c], c, True)
        deal(np.concatenate([own, big[c][::-1]]), c, True, small)
        out += [own, big[c][::-1]]
    return np.concatenate(out)[::-1]


def _names(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in text order, equal ones alike; ``order`` has the sorted LMS places."""
    size = np.ones(len(s), np.int64)
    size[lms[:-1]] = np.diff(lms) + 1
    a, b = order[:-1], order[1:]
    same = size[a] == size[b]
    active, k = np.flatnonzero(same), 0
    while len(active):
        equal = s[a[active] + k] == s[b[active] + k]
        same[active[~equal]] = False
        k += 1
        active = active[equal]
        active = active[size[a[active]] > k]
    name = np.zeros(len(s), np.int64)
    name[order] = np.concatenate([[0], np.cumsum(~same)])
    return name[lms], int((~same).sum()) + 1


def _refine(letters: np.ndarray, start: np.ndarray, stop: np.ndarray, tail: np.ndarray | None = None) -> np.ndarray:
    """Rank of each letters[start:stop], then of its tail; equal ones have equal ranks. Rounds sort only what is still tied."""
    bits = int(letters.max() + 1).bit_length()
    per = max(1, 63 // bits)
    padded = np.concatenate([letters + 1, np.zeros(per, np.int64)])
    rank, active, at = np.zeros(len(start), np.int64), np.arange(len(start)), start.copy()

    def split(active: np.ndarray, key: np.ndarray) -> np.ndarray:
        order = np.lexsort((key, rank[active]))
        active, key = active[order], key[order]
        old = rank[active]
        here = np.arange(len(active))
        group = np.ones(len(active), bool)
        group[1:] = old[1:] != old[:-1]
        new = group.copy()
        new[1:] |= key[1:] != key[:-1]
        head = lambda marks: np.maximum.accumulate(np.where(marks, here, 0))
        rank[active] = old + head(new) - head(group)
        alone = new & np.append(new[1:], True)
        return active[~alone]

    while len(active):
        key = np.zeros(len(active), np.int64)
        for k in range(per):
            place = np.minimum(at[active] + k, len(padded) - 1)
            key = (key << bits) | np.where(place < stop[active], padded[place], 0)
        at[active] += per
        active = split(active, key)
        if tail is None:
            active = active[at[active] < stop[active]]
        elif not (at[active] < stop[active]).any():
            split(active, tail[active])
            break
    return rank


def _sort_names(s: np.ndarray) -> np.ndarray:
    """Suffix array of a string of numbers whose last is the one smallest, by the same steps for large alphabets.

    With its type a letter tells whether an LMS place begins, so suffixes are in the order of their
    letters up to and with the next LMS place and then of that place's rank.
    """
    n = len(s)
    if int(s.max()) == n - 1:
        out = np.empty(n, np.int64)
        out[s] = np.arange(n)
        return out
    smaller = _types(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    typed = 2 * s.astype(np.int64) + smaller
    _, names = np.unique(_refine(typed, lms, np.append(lms[1:], n - 1) + 1), return_inverse=True)
    place = np.empty(len(lms), np.int64)
    place[_sort_names(names)] = np.arange(len(lms))
    after = np.searchsorted(lms, np.arange(n), "right")
    tail = np.append(place, -1)[after]
    return np.argsort(_refine(typed, np.arange(n), np.append(lms, n - 1)[after] + 1, tail))


def suffix_array(s: np.ndarray, letters: int) -> np.ndarray:
    """Suffix array of small letters (numpy integers); the last must be the one smallest."""
    smaller = _types(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    by_letter = lms[np.argsort(s[lms], kind="stable")]
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    if len(lms) > 1:
        sa = _induce(s, smaller, by_letter, letters)
        order = sa[is_lms[sa]]
        names, n = _names(s, lms, order)
        if n < len(lms):
            order = lms[_sort_names(names)]
    else:
        order = lms
    return _induce(s, smaller, order, letters)


def common_prefixes(s: np.ndarray, sa: np.ndarray, most: int, asked: np.ndarray | None = None) -> np.ndarray:
    """Permuted: for each place (that is asked for) the letters, up to ``most``, that it shares with the suffix sorted before it."""
    n = len(s)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    words = np.zeros(n + most, np.uint64)  # the bytes that tell letters apart, eight from each place
    low = np.zeros(n + most + 8, np.uint64)
    low[:n] = s.astype(np.uint64)
    for k in range(7):
        words |= (low[k : n + most + k] & np.uint64(511)) << np.uint64(9 * k)
    out = np.zeros(n, np.int64)
    active = np.flatnonzero(before >= 0 if asked is None else asked & (before >= 0))
    for k in range(0, most, 7):
        x = words[active + k] ^ words[before[active] + k]
        differ = x != 0
        place = active[differ]
        lowest = x[differ] & (~x[differ] + np.uint64(1))
        out[place] = k + np.log2(lowest.astype(float)).astype(np.int64) // 9
        active = active[~differ]
        out[active] = k + 7
        active = active[(active + k + 7 < n) & (before[active] + k + 7 < n)]
    return np.minimum(out, most)


def repeated_windows(parts: list[bytes], order: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each part, which of its windows is equal to one with a smaller ``order`` (of the part's first byte; later bytes add 1)."""
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes + 1) - sizes - 1
    s = np.frombuffer(b"\0".join(parts) + b"\0\0", np.uint8).astype(np.int16) + 2
    s[starts[1:] - 1] = 1
    s[-2], s[-1] = 1, 0
    sa = suffix_array(s, 258)
    part = np.repeat(np.arange(len(parts)), sizes + 1)
    part = np.append(part, part[-1])
    offset = np.arange(len(s)) - starts[part]
    valid = offset + width <= sizes[part]
    lcp = common_prefixes(s, sa, width, valid)
    rank = np.flatnonzero(valid[sa])
    at = sa[rank]
    out = np.zeros(len(s), bool)
    if len(at):
        head = np.flatnonzero(lcp[at] < width)
        if not len(head) or head[0] != 0:
            head = np.append(0, head)
        value = order[part[at]] + offset[at]
        least = np.minimum.reduceat(value, head)
        out[at] = value != np.repeat(least, np.diff(np.append(head, len(at))))
    return [out[a : a + max(0, n - width + 1)] for a, n in zip(starts.tolist(), sizes.tolist())]


_RANGE = pa.schema([("key", pa.int64()), ("no", pa.int32()), ("at", pa.int64()), ("size", pa.int32())])


def _sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: sorts whole anchors, about SHARD_BYTES at once."""

    def flush(rows):
        keys = sorted({(r[1] is None, r[1] or 0, r[2]) for r in rows})
        rank = {k: i for i, k in enumerate(keys)}
        order = np.array([(rank[r[1] is None, r[1] or 0, r[2]] << 36) + r[3] for r in rows], np.int64)
        out = [[], [], [], []]
        for r, gone in zip(rows, repeated_windows([r[4] for r in rows], order)):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                for col, v in zip(out, (r[1], r[2], r[3] + a, b - a + WIDTH - 1)):
                    col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _RANGE.types)], schema=_RANGE)

    rows, held, last = [], 0, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held > SHARD_BYTES and row[0] != last:
                yield flush(rows)
                rows, held = [], 0
            rows.append(row)
            held += len(row[4])
            last = row[0]
    if rows:
        yield flush(rows)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the snippets that are to be sorted."""
    names = ["anchor", "key", "no", "at", "snippet"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    for batch in batches:
        out = [[] for _ in names]
        for key, no, text, parts in zip(*(c.to_pylist() for c in batch.columns)):
            for p in parts:
                for col, v in zip(out, (p["anchor"], key, no, p["at"], text[p["at"] : p["at"] + p["size"]])):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Columns key, no, text (bytes): ``no`` tells rows apart that repeat a key, in the order of their texts."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    if rows.groupBy("key").count().where("count > 1").isEmpty():
        return rows.select("key", F.lit(0).alias("no"), "text")
    return rows.select("key", (F.row_number().over(Window.partitionBy("key").orderBy("text")) - 1).alias("no"), "text")


def repeated_ranges(rows: DataFrame) -> DataFrame:
    """Columns key, no, at, size of what goes; ranges may overlap."""
    found = rows.where(F.length("text") >= WIDTH).mapInArrow(_snippet_rows, "anchor long, content long, key long, no int, at long, size int, local boolean")
    anchor = Window.partitionBy("anchor")
    ordered = anchor.orderBy("content", F.col("key").asc_nulls_last(), "no", "at")
    told = found.select("*", (F.min("content").over(anchor) != F.max("content").over(anchor)).alias("mixed"), F.lag("content").over(ordered).eqNullSafe(F.col("content")).alias("again"))
    events = stash(told.where("local or again or mixed").select("anchor", "key", "no", "at", "size", (F.col("local") | F.col("again")).alias("goes")), "repeats")
    gone = events.where("goes").select("key", "no", "at", "size")
    ask = events.where("not goes").groupBy("key", "no").agg(F.collect_list(F.struct("anchor", "at", "size")).alias("parts"))
    same = rows["key"].eqNullSafe(ask["key"]) & (rows["no"] == ask["no"])
    cut = rows.join(ask, same).select(rows["key"], rows["no"], "text", "parts").mapInArrow(_cut, "anchor long, key long, no int, at long, snippet binary")
    shards = cut.repartition("anchor").sortWithinPartitions("anchor")
    return gone.unionByName(shards.mapInArrow(_sort_shards, "key long, no int, at long, size int"))


def kept_bytes(text: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left, the number of bytes that go, and of maximal runs of them."""
    if not ranges:
        return text, 0, 0
    gone = np.zeros(len(text) + 1, np.int32)
    at, size = np.array(ranges).T
    np.add.at(gone, at, 1)
    np.add.at(gone, at + size, -1)
    mask = np.cumsum(gone)[:-1] > 0
    spans = int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1]))
    return np.frombuffer(text, np.uint8)[~mask].tobytes(), int(mask.sum()), spans


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", with_bytes: bool = False) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the bytes that are left)."""
    rows = numbered(docs, key, text)
    ranges = repeated_ranges(rows).groupBy("key", "no").agg(F.collect_list(F.struct("at", "size")).alias("ranges"))
    both = rows.join(ranges, rows["key"].eqNullSafe(ranges["key"]) & (rows["no"] == ranges["no"]), "left").select(rows["key"], "text", "ranges")
    names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_bytes
    schema = f"`{key}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes

    def run(batches):
        for batch in batches:
            out = {n: [] for n in names}
            for k, t, r in zip(*(c.to_pylist() for c in batch.columns)):
                left, removed, spans = kept_bytes(t, [(x["at"], x["size"]) for x in r or ()])
                for n, v in zip(names, (k, len(t), removed, spans, hashlib.sha256(left).hexdigest(), left)):
                    out[n].append(v)
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types)], names=names)

    return both.mapInArrow(run, schema)
