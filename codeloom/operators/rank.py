"""Ranking: boosts, fusion with summaries, dedupe, packing, iteration."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sets import bare_name, dedupe_parts, dedupe_texts
from .vector import rrf

#: Fixed values of the composite score: category, mention (each, at most), same file; summary weight and depth.
CATEGORY_BOOST, MENTION_BOOST, MENTION_MOST, FILE_BOOST = 0.12, 0.05, 0.2, 0.08
SUMMARY_WEIGHT, SUMMARY_DEPTH = 0.5, 30


def category_boost(pool: DataFrame, wanted: Column) -> DataFrame:
    return pool.withColumn("score", F.col("score") + F.when(F.arrays_overlap(F.col("tags"), wanted), CATEGORY_BOOST).otherwise(0.0))


def rerank(pool: DataFrame, predict) -> DataFrame:
    """Replaces scores by a model's: ``predict`` maps lists of queries and texts to a list of floats."""
    @F.pandas_udf("double")
    def run(query: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series(predict(list(query), list(text)), dtype=float)

    return pool.withColumn("score", run("query", "text"))


def composite(pool: DataFrame, wanted: Column) -> DataFrame:
    """Score plus mentions of the symbol's short name in the pool's texts (its own included), plus its file
    among the query's five best semantic hits, plus the category. Pools are small and joined by query."""
    names = pool.select("query_id", "item", bare_name(F.col("scope")).alias("short"))
    texts = pool.select("query_id", F.col("text").alias("other"))
    counts = names.join(texts, "query_id").where(F.col("other").contains(F.col("short")) & (F.col("short") != "")).groupBy("query_id", "item").agg(F.count("*").alias("n_mentions"))
    top = Window.partitionBy("query_id").orderBy(F.desc("semantic"), "item")
    near = pool.withColumn("__r", F.row_number().over(top)).where(F.col("__r") <= 5).select("query_id", "path").distinct().withColumn("near", F.lit(True))
    both = pool.join(counts, ["query_id", "item"], "left").join(near, ["query_id", "path"], "left")
    bonus = F.least(F.lit(MENTION_MOST), MENTION_BOOST * F.coalesce("n_mentions", F.lit(0))) + F.when(F.col("near"), FILE_BOOST).otherwise(0.0)
    return category_boost(both.withColumn("score", F.col("score") + bonus), wanted).drop("n_mentions", "near")


def fuse_summaries(final: DataFrame, summaries: DataFrame, file_weight: float = 1.0) -> DataFrame:
    """Fuses a ranking (query_id, item, path, scope, text, tier, rank0) with a summary list (query_id, item,
    rank0): weights 1 (tier 1), ``file_weight`` (others) and 0.5, ranks from 1; then text twins and parts go."""
    a = final.select("query_id", "item", "rank0", F.when(F.col("tier") == 1, 1.0).otherwise(file_weight).alias("w"))
    b = summaries.where(F.col("rank0") < SUMMARY_DEPTH).select("query_id", "item", "rank0", F.lit(SUMMARY_WEIGHT).alias("w"))
    fused = rrf(a.unionByName(b), "item", offset=1, weight=F.col("w"))
    rows = fused.join(final.select("item", "path", "scope", "text", "tier").dropDuplicates(["item"]), "item")
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item")))
    rows = rows.withColumn("path", F.concat_ws("\0", F.col("query_id").cast("string"), "path"))
    scopes = rows.select("item", "scope").dropDuplicates(["item"])
    kept = dedupe_parts(dedupe_texts(rows).join(scopes, "item"))
    split = F.split("path", "\0")
    return kept.withColumn("query_id", split[0]).withColumn("path", split[1])


def pack_skipping(rows: DataFrame, budget: int, by: str = "query_id") -> DataFrame:
    """Greedy packing in order of ``pos``: an item goes in if used + its tokens stay below the budget; others
    are skipped and the rest still tried. One small list a query."""
    schema = rows.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used, keep = 0, []
        pdf = pdf.sort_values("pos")
        for n in pdf.n_tokens:
            fits = used + n < budget
            used += n if fits else 0
            keep.append(fits)
        return pdf[keep]

    return rows.groupBy(by).applyInPandas(run, schema)


def pack_prefix(rows: DataFrame, budget: int, by: str = "query_id") -> DataFrame:
    """Priority packing: structural hits with 0.9 of the top semantic score or more come first; stops at the first overflow."""
    top = F.max(F.when(F.col("source") == "semantic", F.col("score"))).over(Window.partitionBy(by))
    promoted = F.when((F.col("source") == "structural") & (F.col("score") >= 0.9 * top), 0).otherwise(1)
    w = Window.partitionBy(by).orderBy("__first", "pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__first", promoted).withColumn("__used", F.sum("n_tokens").over(w)).where(F.col("__used") <= budget).drop("__first", "__used")


def first_per_file(ranking: DataFrame, by: str = "query_id") -> DataFrame:
    w = Window.partitionBy(by, "path").orderBy("pos")
    return ranking.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def bucket_cap(rows: DataFrame, bucket: str, caps: dict[str, int], by: str = "query_id") -> DataFrame:
    """At most so many rows of each bucket, in order; buckets without a cap stay whole.

    Shares of a bucket are capped first, and what is left together: no task holds a whole bucket. Uncapped rows stay in their share."""
    most = F.create_map(*(x for k, v in caps.items() for x in (F.lit(k), F.lit(v))))[F.col(bucket)]
    kept = rows.withColumn("__most", most).withColumn("__share", F.pmod(F.xxhash64("pos"), F.lit(512)))
    for share in (F.col("__share"), F.when(F.col("__most").isNull(), F.col("__share"))):
        kept = kept.withColumn("__part", share)
        w = Window.partitionBy(by, bucket, "__part").orderBy("pos")
        kept = kept.withColumn("__r", F.row_number().over(w)).where(F.col("__most").isNull() | (F.col("__r") <= F.col("__most")))
    return kept.drop("__most", "__share", "__part", "__r")


def iterate(query: str, retrieve, rounds: int = 3, enough: float = 0.85) -> list[dict]:
    """Iterative retrieval: up to three rounds, each asking with the three best names so far as context and
    leaving out what was seen; stops when the fifth score is near enough to the top one.

    ``retrieve(text)`` gives rows (dicts with path, text, scope, score), best first.
    """
    seen, out, ask = set(), [], query
    for _ in range(rounds):
        new = [r for r in retrieve(ask) if (r["path"], r["text"]) not in seen]
        if not new:
            break
        seen |= {(r["path"], r["text"]) for r in new}
        out = sorted(out + new, key=lambda r: -r["score"])
        if len(out) >= 5 and out[0]["score"] > 0 and out[4]["score"] / out[0]["score"] >= enough:
            break
        ask = f"{query} [context: {', '.join(r['scope'] for r in out[:3])}]"
    return out
