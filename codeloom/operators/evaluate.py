"""Retrieval and extraction quality."""

from __future__ import annotations

import random
import statistics

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def query_scores(ranking: DataFrame, qrels: DataFrame, cuts: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Per query MRR, NDCG, MAP, recall and success at the cuts; ranks from 0. The ideal gain is cut to the
    list's length; queries without a list or a relevant item score 0."""
    n_list = ranking.groupBy("query_id").agg(F.count("*").alias("n_list"))
    rel = qrels.where("gain > 0").select("query_id", "item_id").distinct()
    n_rel = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    hit = ranking.join(rel, ["query_id", "item_id"]).select("query_id", "rank")
    from pyspark.sql import Window

    hit = hit.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    gain = 1 / F.log2(F.col("rank") + 2.0)
    sums = hit.groupBy("query_id").agg(F.min("rank").alias("first"), F.sum(gain).alias("dcg"), F.sum(F.col("k") / (F.col("rank") + 1)).alias("ap"), *(F.count_if(F.col("rank") < c).alias(f"h{c}") for c in cuts))
    rows = n_list.join(n_rel, "query_id", "full").join(sums, "query_id", "left")
    ideal_n = F.least(F.coalesce("n_rel", F.lit(0)), F.coalesce("n_list", F.lit(0))).cast("int")
    ideal = F.when(ideal_n > 0, F.aggregate(F.sequence(F.lit(0), ideal_n - 1), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 2.0)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = [zero(1 / (F.col("first") + 1.0)).alias("mrr"), zero(F.col("dcg") / ideal).alias("ndcg"), zero(F.col("ap") / F.col("n_rel")).alias("map")]
    for c in cuts:
        out += [zero(F.col(f"h{c}") / F.col("n_rel")).alias(f"recall_{c}"), (F.coalesce(f"h{c}", F.lit(0)) > 0).cast("double").alias(f"success_{c}")]
    return rows.select("query_id", *out)


def mean_ci(scores: DataFrame, column: str) -> DataFrame:
    """Mean and 95% half-width, 1.96 sd / sqrt(n); fewer than two give 0."""
    n = F.count(column)
    half = F.when(n < 2, 0.0).otherwise(1.96 * F.stddev_samp(column) / F.sqrt(n))
    return scores.agg(F.coalesce(F.avg(column), F.lit(0.0)).alias("mean"), F.coalesce(half, F.lit(0.0)).alias("ci95"), n.alias("n"))


def paired_lift(base: DataFrame, arm: DataFrame, column: str) -> DataFrame:
    both = base.select("query_id", F.col(column).alias("x")).join(arm.select("query_id", F.col(column).alias("y")), "query_id")
    return mean_ci(both.select((F.col("y") - F.col("x")).alias("lift")), "lift")


def verdict(lifts: DataFrame) -> DataFrame:
    """Pass if both metrics' lifts and their lower ends are above 0 and no language's lift is below 0.
    Columns metric, language (null: all), mean, ci95."""
    whole = F.col("language").isNull()
    good = F.bool_and(F.when(whole, (F.col("mean") > 0) & (F.col("mean") - F.col("ci95") > 0)).otherwise(F.col("mean") >= 0))
    return lifts.agg(good.alias("passed"))


def matches_gold(scope: Column, gold: Column) -> Column:
    """Equal, or a tail that starts after ``::``, a dot or a slash; part suffixes don't count."""
    plain = F.regexp_replace(scope, r"_part_[0-9]+$", "")
    return (plain == gold) | plain.endswith(F.concat(F.lit("::"), gold)) | plain.endswith(F.concat(F.lit("."), gold)) | plain.endswith(F.concat(F.lit("/"), gold))


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A seeded sample of n rows, the same on any partitioning."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def latency(rows: DataFrame, column: str, budget: float) -> DataFrame:
    """Mean, exact median and 95th percentile, share within the budget."""
    return rows.agg(F.avg(column).alias("mean"), F.percentile(column, 0.5).alias("p50"), F.percentile(column, 0.95).alias("p95"), F.avg((F.col(column) <= budget).cast("double")).alias("within"))


def bootstrap_ci(values: list[float], rounds: int = 5000, seed: int = 0) -> tuple[float, float]:
    rng = random.Random(seed)
    means = sorted(statistics.fmean(rng.choices(values, k=len(values))) for _ in range(rounds))
    return means[int(0.025 * rounds)], means[int(0.975 * rounds) - 1]


def micro(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Micro precision and recall of sets; an empty side scores 1 if the other is empty too, else 0."""
    e, a = expected.select(*key).distinct().withColumn("e", F.lit(1)), actual.select(*key).distinct().withColumn("a", F.lit(1))
    n = e.join(a, key, "full").agg(F.count_if(F.col("e").isNotNull() & F.col("a").isNotNull()).alias("hit"), F.count("e").alias("ne"), F.count("a").alias("na"))
    share = lambda of, other: F.when(F.col(of) > 0, F.col("hit") / F.col(of)).otherwise((F.col(other) == 0).cast("double"))
    return n.select("hit", share("na", "ne").alias("precision"), share("ne", "na").alias("recall"))


def key_collisions(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def resolution_rates(resolved: DataFrame, gold: DataFrame) -> DataFrame:
    """Outcome counts, rate and precision: hit, wrong, unknown_ok, miss. Keys source_fqn, target; gold has expected."""
    both = gold.join(resolved.select("source_fqn", "target", "resolved_target"), ["source_fqn", "target"], "left")
    got, want = F.col("resolved_target"), F.col("expected")
    how = F.when(want.isNull() & got.isNull(), "unknown_ok").when(got.isNull(), "miss").when(got.eqNullSafe(want), "hit").otherwise("wrong")
    n = both.select(how.alias("how")).agg(*(F.count_if(F.col("how") == x).alias(x) for x in ("hit", "wrong", "unknown_ok", "miss")))
    rate = F.coalesce(F.col("hit") / F.nullif(F.col("hit") + F.col("wrong") + F.col("miss"), F.lit(0)), F.lit(1.0))
    precision = F.coalesce(F.col("hit") / F.nullif(F.col("hit") + F.col("wrong"), F.lit(0)), F.lit(1.0))
    return n.select("*", rate.alias("rate"), precision.alias("precision"))
