"""Near-duplicates by SimHash: segment-popcount embedding and a grid range-join.

A 64-bit fingerprint is cut into 32 segments of two bits; the number of bits set
in each is a point of {0,1,2}^32. The Manhattan distance of two points is at most
the number of differing bits, so it bounds it from below. Links of three bits or
fewer lie, in one of the two halves of 16 segments, at Manhattan distance 0 or 1
(were both 2 or more, the sum would be 4). So every point stands in the grid cell
of each half, and points whose half sums to an even number also probe the cells
one step away (a step changes the sum's parity, so the other side needn't). Pairs
that meet are tested by the whole Manhattan distance, then exactly.

Counts are written in unary (00, 01, 11), which makes a Manhattan distance the
bit count of an exclusive or.

Defined results: null texts count as empty; without words the fingerprint is
zero and is linked like any other; equal fingerprints form one vertex, however
many rows have them; a null key is never the smallest; an empty table gives no rows.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import map_rows, stash, texts_of
from .components import components

_LOW = 0x5555555555555555
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles, repeats included; bit 1 where over half the hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        # cut each shingle out of the joined words
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        shingles = [joined[a:b] for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, seed) for s in shingles], np.uint64)
    ones = np.zeros((8, 8), np.int64)  # [bit of a byte][byte]
    for at in range(0, len(h), 255):
        part = h[at : at + 255]
        for bit in range(8):  # lanes of a byte hold at most 255
            ones[bit] += np.frombuffer(int(((part >> np.uint64(bit)) & _LANES).sum(dtype=np.uint64)).to_bytes(8, "little"), np.uint8)
    bits = (ones.T.reshape(64) * 2 > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """Columns key and fp (the fingerprint's 64 bits as a long). No shuffle."""

    def one(batch):
        fp = np.array([fingerprint(t, width) for t in texts_of(batch, "__text")], np.uint64)
        return {key: batch.column(0), "fp": fp.view(np.int64)}

    return map_rows(docs.select(docs[key].alias(key), docs[text].alias("__text")), one, f"`{key}` {docs.schema[key].dataType.simpleString()}, fp long")


def unary(fp: Column) -> Column:
    """The segment counts of a fingerprint, each in two bits: 00, 01 or 11."""
    low = F.lit(_LOW)
    high = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(high).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(low), 1))


def links(points: DataFrame, most: int = 3) -> DataFrame:
    """Pairs (u, v) of ids whose fingerprints (distinct, column fp) differ in at most ``most`` <= 3 bits."""
    if most > 3:
        raise ValueError("two halves guarantee links of three bits at most")
    base = points.select("id", "fp", unary(F.col("fp")).alias("point"))
    half = F.explode(F.array(*(F.struct(F.lit(k).alias("half"), F.shiftrightunsigned("point", 32 * k).bitwiseAND(F.lit(0xFFFFFFFF)).alias("cell")) for k in (0, 1))))
    placed = base.select("id", "fp", "point", half.alias("h")).select("id", "fp", "point", "h.half", "h.cell")
    steps = []
    for s in range(16):  # one step up or down in a segment: 00 <-> 01 <-> 11
        count = F.shiftright("cell", 2 * s).bitwiseAND(F.lit(3))
        steps.append(F.when(count == 0, F.col("cell").bitwiseOR(F.lit(1 << 2 * s))).when(count == 3, F.col("cell") - F.lit(2 << 2 * s)))
        steps += [F.when(count == 1, F.col("cell").bitwiseOR(F.lit(2 << 2 * s))), F.when(count == 1, F.col("cell") - F.lit(1 << 2 * s))]
    even = F.bit_count("cell") % 2 == 0
    probes = F.explode(F.concat(F.array("cell"), F.when(even, F.array_compact(F.array(*steps))).otherwise(F.array().cast("array<long>"))))
    own = F.col("probe") == F.col("home")
    right = placed.select(F.col("id").alias("id2"), F.col("fp").alias("fp2"), F.col("point").alias("point2"), F.col("half").alias("half2"), F.col("cell").alias("home"), probes.alias("probe"))
    near = (F.bit_count(F.col("point").bitwiseXOR(F.col("point2"))) <= most) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= most)
    once = ~own | (F.col("fp") < F.col("fp2"))  # points of one cell meet twice
    met = (F.col("half") == F.col("half2")) & (F.col("cell") == F.col("probe")) & once & near
    return placed.join(right, met).select(F.col("id").alias("u"), F.col("id2").alias("v"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 3, width: int = 3) -> DataFrame:
    """Per row: key, fp, component_id (the smallest key that is reachable)."""
    prints = stash(fingerprints(docs, key, text, width), "simhash")
    groups = prints.groupBy("fp").agg(F.min(key).cast("long").alias("id"))
    points = stash(groups.where("id is not null"), "simhash-points")
    joined = components(links(points, most))
    named = points.join(joined, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return prints.join(named, "fp", "left").select(key, "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 3, width: int = 3) -> DataFrame:
    """The rows of ``docs`` with the smallest key of each group of near-duplicates; of rows that repeat it, one."""
    found = near_duplicates(docs, key, text, most, width)
    gone = stash(found.where(~F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("__key")).distinct(), "simhash-gone")
    twice = docs.groupBy(key).count().where("count > 1")
    if not twice.isEmpty():
        # rows that share a key are told apart by their prints: the anti-join alone would take or leave all of them
        columns = docs.columns
        named = found.select(F.col(key).alias("__key"), "component_id", "fp").distinct()
        printed = with_fingerprint(docs, text, width)
        rows = printed.join(named, printed[key].eqNullSafe(named["__key"]) & (printed["__fp"] == named["fp"])).where(F.col(key).eqNullSafe(F.col("component_id")))
        return rows.withColumn("__group", F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), "fp"))).dropDuplicates(["__group"]).select(*columns)
    return docs.join(gone, docs[key].eqNullSafe(gone["__key"]), "left_anti")


def with_fingerprint(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """The rows of ``docs`` and their fingerprint, ``__fp``."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, width) for t in texts_of(batch, text)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp, pa.int64())], names=[*batch.schema.names, "__fp"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__fp", LongType())]))
