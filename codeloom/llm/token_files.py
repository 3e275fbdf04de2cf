"""Token-ID files: independent zstandard frames, a trailing seek table, checksums.

A file is a run of frames, one a document, then one skippable frame that holds
the seek table: for each frame its key, compressed and plain size and checksum.
A reader takes the table from the file's end and then reads only the frames that
it wants. Files are written in ascending key order, each by one task under a
name of its own, so a lost executor leaves at worst a file that no manifest
names.

Defined results: null texts count as empty and hold the end id only; null keys
come first; rows with the same key are ordered by their text; an empty table
gives an empty manifest and no rows.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cache import Cache
from .common import new_path, stash

#: Fixed values of the zstandard seekable layout: a skippable frame's magic number and the footer's.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_ENTRY = struct.Struct("<qBIIQ")  # key, key is null, compressed size, plain size, checksum
_FOOTER = struct.Struct("<QI")  # entries, magic number
#: Words of each of the two generations of a Python worker's cache, and words that are encoded as one text.
CACHE_ENTRIES, JOIN = 600_000, 64


class FrameWriter:
    """Writes documents' ids to a binary stream; ids below 65,536 take two bytes."""

    def __init__(self, out, wide: bool = False, level: int = 1):
        self.out, self.dtype = out, np.dtype("<u4" if wide else "<u2")
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress
        self.table: list[bytes] = []
        self.tokens = 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        if len(ids) and ids.max() > np.iinfo(self.dtype).max:
            raise ValueError("ids don't fit into the file's width")
        plain = ids.astype(self.dtype).tobytes()
        frame = self.pack(plain)
        self.out.write(frame)
        self.table.append(_ENTRY.pack(key or 0, key is None, len(frame), len(plain), xxhash.xxh64_intdigest(plain)))
        self.tokens += len(ids)

    def close(self) -> None:
        body = bytes([self.dtype.itemsize]) + b"".join(self.table) + _FOOTER.pack(len(self.table), SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()


class FrameReader:
    """Reads the seek table from the end of a file, then single frames or all of them."""

    def __init__(self, src):
        self.src, size = src, src.size()
        if size < 21:
            raise ValueError("file is too short for a seek table")
        n, magic = _FOOTER.unpack(src.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        rows = src.read_at(n * _ENTRY.size, size - _FOOTER.size - n * _ENTRY.size)
        self.dtype = np.dtype({2: "<u2", 4: "<u4"}[src.read_at(1, size - _FOOTER.size - n * _ENTRY.size - 1)[0]])
        self.entries = list(_ENTRY.iter_unpack(rows))
        self.offsets = [0]
        for _, _, packed, _, _ in self.entries:
            self.offsets.append(self.offsets[-1] + packed)
        self.unpack = zstandard.ZstdDecompressor().decompress

    def __len__(self) -> int:
        return len(self.entries)

    def key(self, k: int) -> int | None:
        return None if self.entries[k][1] else self.entries[k][0]

    def ids(self, k: int, frame: bytes | None = None) -> np.ndarray:
        _, _, packed, size, check = self.entries[k]
        plain = self.unpack(frame if frame is not None else self.src.read_at(packed, self.offsets[k]))
        if len(plain) != size or xxhash.xxh64_intdigest(plain) != check:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(plain, self.dtype)

    def walk(self, step: int = 4 << 20) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order; reads runs of frames of about ``step`` bytes."""
        k = 0
        while k < len(self):
            j = k + 1
            while j < len(self) and self.offsets[j + 1] - self.offsets[k] <= step:
                j += 1
            at = self.offsets[k]
            block = self.src.read_at(self.offsets[j] - at, at)
            for i in range(k, j):
                yield self.key(i), self.ids(i, block[self.offsets[i] - at : self.offsets[i + 1] - at])
            k = j


def _words_apart(model: dict) -> bool:
    """Whether a tokenizer's first pre-tokenizer drops all white space, so that a text's ids are those of its words."""
    step = model.get("pre_tokenizer") or {}
    if step.get("type") == "Sequence":
        step = (step.get("pretokenizers") or [{}])[0]
    if step.get("type") in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer"):
        return True
    pattern = (step.get("pattern") or {}).get("Regex")
    if step.get("type") != "Split" or step.get("behavior") != "Removed" or not step.get("invert") or not pattern:
        return False
    probe = "".join(f"{a}{space}{b}" for a in "a1.'" for b in "a1.'" for space in (" ", "\n", "\t \r", "\x0b", "\x0c"))
    return not any(c.isspace() for m in regex.finditer(pattern, probe) for c in m.group())


class WordEncoder:
    """A tokenizers model applied to whole texts: word by word with a cache, if no rule of it reaches across white space.

    Then a text's ids are those of its words (runs outside ASCII white space) in
    order. New words are encoded many at once, as texts of JOIN words, and told
    apart by the tokens' offsets. Other models get whole texts.
    """

    def __init__(self, path_or_json: str, cache_entries: int = CACHE_ENTRIES):
        self.json, self.cache_entries = path_or_json, cache_entries
        model = json.loads(path_or_json)
        self.apart = _words_apart(model)
        self.largest = max([*model["model"]["vocab"].values(), *(t["id"] for t in model.get("added_tokens") or ())]) if isinstance(model["model"].get("vocab"), dict) else 1 << 31
        self.model = None

    def __getstate__(self):
        return self.__dict__ | {"model": None, "many": None, "cache": None}

    def _start(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(self.json)
        self.many = self.model.encode_batch  # its fast form gives no offsets
        self.cache = Cache(self.cache_entries)

    def _learn(self, new: list[bytes], into: dict[bytes, bytes]) -> None:
        for k in range(0, len(new), 64 * JOIN):
            words = [w.decode() for w in new[k : k + 64 * JOIN]]
            groups = [words[i : i + JOIN] for i in range(0, len(words), JOIN)]
            for i, (group, e) in enumerate(zip(groups, self.many([" ".join(g) for g in groups], add_special_tokens=False))):
                ids = np.array(e.ids, "<u4").tobytes()
                begins = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids))
                ends = np.cumsum([len(w) + 1 for w in group])
                cuts = (4 * np.searchsorted(begins, ends)).tolist()
                for w, a, b in zip(new[k + i * JOIN : k + (i + 1) * JOIN], [0, *cuts], cuts):
                    into[w] = ids[a:b]

    def encode(self, texts: list[bytes], end: int | None) -> list[np.ndarray]:
        if self.model is None:
            self._start()
        tail, out = b"" if end is None else struct.pack("<I", end), []
        for at in range(0, len(texts), 256):
            some = texts[at : at + 256]
            if not self.apart:
                out += [np.frombuffer(np.array(e.ids, "<u4").tobytes() + tail, "<u4") for e in self.many([t.decode() for t in some], add_special_tokens=False)]
                continue
            parts = [t.split() for t in some]
            if new := self.cache.unknown(set().union(*parts)):
                self._learn(new, self.cache.now)
            word = self.cache.now
            out += [np.frombuffer(b"".join(map(word.__getitem__, p)) + tail, "<u4") for p in parts]
        return out


def write_files(docs: DataFrame, tokenizer_path: str, end_id: int | None, files: int | None = None, folder: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and write; returns the manifest: ordinal, path, n_docs, n_tokens, base.

    ``folder`` is any URI that pyarrow's file systems reach; by default one in the
    session's shared folder. ``base`` counts the ids of all files before.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    with open(tokenizer_path, encoding="utf-8") as f:
        made = WordEncoder(f.read())
    shared, wide = spark.sparkContext.broadcast(made), max(made.largest, end_id or 0) > 65_535
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, path = shared.value, None, None
        first, docs_in = None, 0
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [x or b"" for x in batch.column(1).to_pylist()]
            for at in range(0, len(keys), 512):
                for k, ids in zip(keys[at : at + 512], encoder.encode(texts[at : at + 512], end_id)):
                    if writer is None:
                        fs, where = pafs.FileSystem.from_uri(folder)
                        fs.create_dir(where, recursive=True)
                        path = f"{folder}/{uuid.uuid4().hex}.zst"
                        writer, first = FrameWriter(fs.open_output_stream(f"{where}/{path.rsplit('/', 1)[1]}", compression=None), wide), k
                    writer.add(k, ids)
                    docs_in += 1
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"first_key": [first], "path": [path], "n_docs": [docs_in], "n_tokens": [writer.tokens]}, schema=pa.schema([("first_key", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("binary").alias("t"))
    parts = rows.repartitionByRange(files, "k").sortWithinPartitions(F.col("k").asc_nulls_first(), "t")
    made = stash(parts.mapInArrow(run, "first_key long, path string, n_docs long, n_tokens long"), "token-manifest")
    # one row a file: a few hundred bytes for each output partition
    manifest = sorted(made.collect(), key=lambda r: (r.first_key is not None, r.first_key or 0))
    base, out = 0, []
    for i, r in enumerate(manifest):
        out.append((i, r.path, r.n_docs, r.n_tokens, base))
        base += r.n_tokens
    return spark.createDataFrame(out, "ordinal int, path string, n_docs long, n_tokens long, base long")


def _open(path: str):
    fs, where = pafs.FileSystem.from_uri(path)
    return FrameReader(fs.open_input_file(where))


def read_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32, ids as bytes' crc only."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, at = [], base
                for k, ids in _open(path).walk():
                    rows.append((k, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(rows) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    n = max(1, manifest.count())
    return manifest.select("path", "base").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(path: str, keys: set) -> dict:
    """Ids of single documents of one file: decompresses only their frames."""
    reader = _open(path)
    return {reader.key(k): reader.ids(k).tolist() for k in range(len(reader)) if reader.key(k) in keys}
