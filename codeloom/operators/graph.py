"""Graph traversal over call edges with confidence."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Confidence of a candidate edge without one, and the floor of a verified edge.
CANDIDATE_CONFIDENCE, CONFIDENCE_FLOOR = 0.25, 0.5


def effective_confidence(candidate: Column, confidence: Column) -> Column:
    return F.coalesce(confidence, F.when(F.coalesce(candidate, F.lit(False)), F.lit(CANDIDATE_CONFIDENCE)).otherwise(F.lit(1.0)))


def verified(candidate: Column, confidence: Column) -> Column:
    return effective_confidence(candidate, confidence) >= CONFIDENCE_FLOOR


def adjacency(edges: DataFrame) -> DataFrame:
    """CALLS edges both ways: node, next, direction, candidate, confidence."""
    calls = edges.where(F.col("kind") == "CALLS").select("source_fqn", F.coalesce("resolved_target", "target").alias("t"), F.coalesce("candidate", F.lit(False)).alias("candidate"), effective_confidence(F.col("candidate"), F.col("confidence")).alias("confidence"))
    out = calls.select(F.col("source_fqn").alias("node"), F.col("t").alias("next"), F.lit("calls").alias("direction"), "candidate", "confidence")
    return out.unionByName(calls.select(F.col("t").alias("node"), F.col("source_fqn").alias("next"), F.lit("called_by").alias("direction"), "candidate", "confidence"))


def call_graph(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Nodes within ``depth`` steps of each seed, in both directions mixed.

    A walk never visits a node twice. Each (root, fqn, direction) has its least depth, whether every
    last edge is a candidate, and the greatest confidence of a last edge. Columns of ``seeds``: fqn.
    """
    steps = adjacency(edges)
    walk = seeds.select(F.col("fqn").alias("root"), F.col("fqn").alias("node"), F.array("fqn").alias("path"))
    found = walk.select("root", F.col("node").alias("fqn"), F.lit("root").alias("direction"), F.lit(0).alias("depth"), F.lit(False).alias("candidate"), F.lit(1.0).alias("confidence"))
    for d in range(1, depth + 1):
        moved = walk.join(steps, "node").where(~F.array_contains("path", F.col("next")))
        level = moved.select("root", F.col("next").alias("fqn"), "direction", F.lit(d).alias("depth"), "candidate", "confidence")
        found = found.unionByName(level)
        # walks with the same visited set and end go on alike
        walk = moved.select("root", F.col("next").alias("node"), F.array_append("path", F.col("next")).alias("path")).withColumn("seen", F.array_sort("path")).dropDuplicates(["root", "node", "seen"]).drop("seen")
    return found.groupBy("root", "fqn", "direction").agg(F.min("depth").alias("depth"), F.min("candidate").alias("candidate"), F.max("confidence").alias("confidence"))


def neighbours(edges: DataFrame, fqn: str, direction: str) -> DataFrame:
    """Callers (``called_by``) or callees (``calls``) of one symbol with their confidence."""
    one = adjacency(edges).where((F.col("node") == fqn) & (F.col("direction") == direction) & (F.col("next") != fqn))
    return one.groupBy(F.col("next").alias("fqn")).agg(F.min("candidate").alias("candidate"), F.max("confidence").alias("confidence"))


def decorate(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds kind, path and lines of known symbols."""
    return nodes.join(symbols.select("fqn", F.col("kind").alias("symbol_kind"), "path", "start_line", "end_line"), "fqn", "left")


def fan_out(edges: DataFrame) -> DataFrame:
    """Adjacency snapshot: each caller's targets, sorted, without repeats."""
    calls = edges.where(F.col("kind") == "CALLS").select("source_fqn", F.coalesce("resolved_target", "target").alias("t"))
    return calls.groupBy("source_fqn").agg(F.array_sort(F.collect_set("t")).alias("targets"))


def best_first(seeds: list[tuple[str, float]], neighbours_of, decay: float = 0.7, floor: float = 0.3, per_pop: int = 5, budget: int = 20) -> list[tuple[str, float, str]]:
    """Budgeted best-first expansion: pops the best node, adds its first neighbours at ``decay`` times its
    score, and stops below ``floor`` times the top score or after ``budget`` additions.

    ``neighbours_of`` gives a node's neighbours in (depth, direction, name) order.
    """
    if not seeds:
        return []
    top = max(s for _, s in seeds)
    heap = [(-s, i, n) for i, (n, s) in enumerate(seeds)]
    heapq.heapify(heap)
    seen, out, count = {n for n, _ in seeds}, [], len(heap)
    while heap and len(out) < budget:
        score, _, node = heapq.heappop(heap)
        if -score < floor * top:
            break
        for name in neighbours_of(node)[:per_pop]:
            if name in seen:
                continue
            if len(out) >= budget:
                break
            seen.add(name)
            out.append((name, -score * decay, node))
            heapq.heappush(heap, (score * decay, count, name))
            count += 1
    return out


def expand(seeds: DataFrame, edges: DataFrame, hops: int = 3, **options) -> DataFrame:
    """``best_first`` for each query (columns query_id, fqn, score), over the part of the graph within
    ``hops`` steps of its seeds; one small group a query."""
    steps = adjacency(edges).select("node", "next", "direction").distinct()
    reach = seeds.select("query_id", F.col("fqn").alias("node")).distinct()
    around = None
    for _ in range(hops):
        out = reach.join(steps, "node")
        around = out if around is None else around.unionByName(out)
        reach = out.select("query_id", F.col("next").alias("node")).distinct()
    rows = around.distinct().select("query_id", "node", "next", "direction", F.lit(None).cast("double").alias("score"))
    rows = rows.unionByName(seeds.select("query_id", F.col("fqn").alias("node"), F.lit(None).cast("string").alias("next"), F.lit("seed").alias("direction"), F.col("score").cast("double").alias("score")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf[pdf.direction == "seed"].sort_values(["score", "node"], ascending=[False, True])
        near: dict[str, list] = {}
        for n, x, d in sorted(pdf[pdf.direction != "seed"][["node", "next", "direction"]].itertuples(index=False), key=lambda r: (r[0], r[2], r[1])):
            near.setdefault(n, []).append(x)
        got = best_first(list(zip(first.node, first.score)), lambda n: near.get(n, []), **options)
        return pd.DataFrame([(pdf.query_id.iloc[0], n, s, via, i) for i, (n, s, via) in enumerate(got)], columns=["query_id", "fqn", "score", "via", "pos"])

    return rows.groupBy("query_id").applyInPandas(run, f"query_id {seeds.schema['query_id'].dataType.simpleString()}, fqn string, score double, via string, pos int")
