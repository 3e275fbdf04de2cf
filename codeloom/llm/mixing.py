"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents, in a keyed random order, form one stream of words that
is cut into blocks. A target of e whole passes and a remainder takes all blocks
e times and the remainder's quota of blocks once more; a pass or remainder is a
draw. A binary tree over the output shards splits all draws' quotas exactly: at
each node a multivariate hypergeometric draw says how many blocks of each go left.
A shard then owns a range of each draw's permuted block order, so its blocks are
disjoint from other shards', and its rows are shuffled by a keyed hash.

Only one scan reads texts: key, source, size and a keyed mark of each row are
written to the shared folder, and all planning is done on these light rows.

Defined results: a null text has size 0; the null source is a source of its own,
last in order, and differs from the empty one; a source of size 0 has target 0;
documents of size 0 take nothing; repeated rows are mixed like any others; an
empty table gives no rows; columns of the input that are called ``source_size`` or
``target`` give way in ``mix``, all others stay. Everything is keyed by ``seed``,
so reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BREAK, stash

#: Words of a block, rows that one bucket of the stream order should hold, words of a shard, least number of shards.
BLOCK_WORDS, BUCKET_ROWS, SHARD_WORDS, SHARDS = 1024, 250, 1 << 27, 16
#: Blocks of all draws together stay below this, the limit of the hypergeometric generator.
MOST_BLOCKS = 10**9 - 1
#: Weights, dealt to the sources by code point, null last, over and over.
WEIGHTS = (3.0, 1.0, 2.0)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text, null counting 0."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{WORD_BREAK}|{WORD_BREAK}$", "")
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, WORD_BREAK))).cast("long")


def targets(sizes: list[int], weights: list[float], share: float, limit: float) -> list[float]:
    """``share`` times all sizes by weight, none above ``limit`` times its size; the excess is reshared by weight."""
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > limit * sizes[i]]
        for i in over or open_:
            out[i] = limit * sizes[i] if over else unit * weights[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in over] if over else []
    return out


def split_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (column) in each shard (row); columns sum to the quotas, rows differ by one at most."""
    out = np.zeros((shards, len(quotas)), np.int64)
    total = sum(quotas)
    capacity = [total // shards + (k < total % shards) for k in range(shards)]

    def halve(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid, rng = (lo + hi) // 2, np.random.default_rng([seed, lo, hi])
        want, rest, took = sum(capacity[lo:mid]), int(have.sum()), np.zeros_like(have)
        for i, n in enumerate(have.tolist()):  # source by source: the conditional draws make up the joint one
            rest -= n
            took[i] = _draw(rng, n, rest, want)
            want -= took[i]
        halve(lo, mid, took)
        halve(mid, hi, have - took)

    halve(0, shards, np.array(quotas, np.int64))
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    if not good or not sample:
        return 0
    return int(rng.hypergeometric(good, bad, sample)) if bad else min(good, sample)


def plan(sizes: list[tuple[str | None, int]], share: float, limit: float, weights, shards: int, seed: int, block_words: int):
    """One tuple a source: source, size, target, passes, block words, blocks, quota, multiplier, offset, and for each draw
    (the passes, then the remainder) the first block rank after each shard's."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    wants = targets([n for _, n in order], [weights[i % len(weights)] for i in range(len(order))], share, limit)
    # so long that the blocks of all draws, and one more a draw for what is rounded up, stay below the limit
    draws = (math.floor(limit) + 1) * len(order)
    least = math.ceil(sum(n for _, n in order) * (limit + 1) / max(1, MOST_BLOCKS - draws))
    rows, quotas = [], []
    for i, ((source, size), want) in enumerate(zip(order, wants)):
        words = max(1, min(block_words, size // 1000), least)
        blocks, passes = max(1, -(-size // words)), min(int(want // size), int(limit)) if size else 0
        quota = min(blocks, max(0, round((want - passes * size) / words))) if size else 0
        rng = np.random.default_rng([seed, i])
        step = int(rng.integers(1, max(2, blocks)))
        while math.gcd(step, max(1, blocks)) != 1:
            step += 1
        rows.append([source, size, float(want), passes, words, blocks, quota, step, int(rng.integers(0, max(1, blocks)))])
        quotas.append([blocks] * passes + [quota])
    tree = np.cumsum(split_tree([q for own in quotas for q in own], shards, seed), axis=0)
    at = 0
    for row, own in zip(rows, quotas):
        row.append([[int(x) for x in tree[:, at + k]] for k in range(len(own))])
        at += len(own)
    return [tuple(r) for r in rows]


_PLAN = "of string, source_size long, target double, passes int, words long, blocks long, quota long, step long, first long, ends array<array<long>>"
_PLANNED = "size long, source_size long, target double, taken long, shards array<int>"


def _light(docs: DataFrame, key: str, text: str, source: str, seed: int) -> dict[str, Column]:
    """What tells a row: its key, source and a keyed mark of key and text."""
    return {"key": F.col(key), "source": F.col(source), "mark": F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.col(text))}


def planned(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, limit: float = 2.0, weights=WEIGHTS, shards: int | None = None, seed: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix of each row, without texts: key, source, mark, size, source_size, target, taken and shards.

    ``taken`` counts the words that the mix takes, repeats included; ``shards`` has the
    shard of each copy of the whole row (its middle word decides whether the remainder
    holds it). The sources (one small row each, not documents) are planned on the driver.
    """
    spark = docs.sparkSession
    rows = stash(docs.select(*(c.alias(n) for n, c in _light(docs, key, text, source, seed).items()), word_count(F.col(text)).alias("size")), "mix-rows")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    if not per_source:
        return rows.select("key", "source", "mark", *(F.lit(None).cast(f.split(" ")[1]).alias(f.split(" ")[0]) for f in _PLANNED.split(", ")))
    shards = shards or max(SHARDS, math.ceil(share * sum(r.n or 0 for r in per_source) / SHARD_WORDS))
    made = plan([(r["source"], r.n or 0) for r in per_source], share, limit, weights, shards, seed, block_words)
    sources = spark.createDataFrame(made, _PLAN)
    # buckets of the keyed order; as many as the rows need, the same for every source
    bits = max(0, math.ceil(math.log2(max(1, max(r.rows for r in per_source) / BUCKET_ROWS))))
    rows = rows.withColumn("bucket", F.shiftrightunsigned("mark", 64 - bits) if bits else F.lit(0).cast("long"))
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    # one row a source and bucket: about one in BUCKET_ROWS of the documents
    before = totals.select(F.col("source").alias("source_b"), F.col("bucket").alias("bucket_b"), (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("mark", "key")
    rows = rows.withColumn("run", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.join(before, F.col("source").eqNullSafe(F.col("source_b")) & (F.col("bucket") == F.col("bucket_b")))
    rows = rows.join(F.broadcast(sources) if len(made) <= 10_000 else sources, F.col("source").eqNullSafe(F.col("of")))
    start = F.col("base") + F.col("run")
    lo, hi = F.floor(start / F.col("words")), F.floor((start + F.greatest("size", F.lit(1)) - 1) / F.col("words"))
    rank = lambda b, draw: (b * F.col("step") + F.col("first") + draw) % F.col("blocks")
    inside_block = lambda b: F.least(start + F.col("size"), (b + 1) * F.col("words")) - F.greatest(start, b * F.col("words"))
    # a block is in the remainder if a shard owns its rank there
    owned = F.element_at(F.element_at("ends", -1), -1)
    drawn = lambda b: F.when(rank(b, F.col("passes")) < owned, inside_block(b)).otherwise(F.lit(0).cast("long"))
    extra = F.when((owned == 0) | (F.col("size") == 0), F.lit(0).cast("long")).otherwise(F.aggregate(F.sequence(lo, hi), F.lit(0).cast("long"), lambda a, b: a + drawn(b)))
    middle = F.floor((start + F.floor(F.col("size") / 2)) / F.col("words"))
    shard = lambda ends, draw: F.size(F.filter(ends, lambda e: e <= rank(middle, draw)))
    every = F.transform("ends", shard)
    shards_of = F.when(F.col("size") == 0, F.array().cast("array<int>")).otherwise(F.filter(every, lambda k: k < shards))
    return rows.select("key", "source", "mark", "size", "source_size", "target", (F.col("passes") * F.col("size") + extra).alias("taken"), shards_of.alias("shards"))


def _with_rows(docs: DataFrame, mixed: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    """The rows of ``docs`` with their mix, in columns ``__mix_*``; repeated rows are told apart by number."""
    mixed = mixed.select(*(F.col(c).alias(f"__mix_{c}") for c in mixed.columns))
    whole = docs.withColumns({f"__row_{n}": c for n, c in _light(docs, key, text, source, seed).items()})
    told = ["key", "source", "mark"]
    if not mixed.groupBy(*(f"__mix_{c}" for c in told)).count().where("count > 1").isEmpty():
        number = lambda p, last: F.row_number().over(Window.partitionBy(*(f"__{p}_{c}" for c in told)).orderBy(last))
        mixed, whole = mixed.withColumn("__mix_no", number("mix", "__mix_taken")), whole.withColumn("__row_no", number("row", "__row_mark"))
        told = [*told, "no"]
    same = F.lit(True)
    for c in told:
        same = same & F.col(f"__row_{c}").eqNullSafe(F.col(f"__mix_{c}"))
    return whole.join(mixed, same)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 20, **options) -> DataFrame:
    """Every row with its size, source_size, target, words taken and the shards of its copies; see ``planned``."""
    rows = _with_rows(docs, planned(docs, key, text, source, seed=seed, **options), key, text, source, seed)
    own = [c for c in docs.columns if c not in ("source_size", "target")]
    return rows.select(*own, F.col("__mix_size").alias("__size"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), F.col("__mix_taken").alias("__taken"), F.col("__mix_shards").alias("__shards"))


def draw(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 20, **options) -> DataFrame:
    """The mix as whole rows with the columns of ``docs``, each as often as it is drawn: dealt to its shards, shuffled in each."""
    mixed = planned(docs, key, text, source, seed=seed, **options).where(F.size("shards") > 0)
    rows = _with_rows(docs, mixed, key, text, source, seed).select(*docs.columns, "__mix_mark", F.posexplode("__mix_shards").alias("__mix_copy", "__mix_shard"))
    rows = rows.withColumn("__mix_order", F.xxhash64(F.lit(seed + 1), "__mix_mark", "__mix_copy"))
    return rows.repartition("__mix_shard").sortWithinPartitions("__mix_shard", "__mix_order").select(*docs.columns)
