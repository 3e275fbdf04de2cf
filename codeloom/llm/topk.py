"""Exact top-k search by inner product over multi-resolution segment statistics.

A vector is cut into segments; a segment of length L has mean m and deviation s.
For a query q the squared distance of two vectors is at least the sum over
segments of L((m - m')^2 + (s - s')^2), and as the norms are known, the inner
product is at most the sum of L(m m' + s s'). Bounds from few segments rule most
candidates out, those from more segments the next, and exact inner products are
computed for the survivors.

Queries and candidates meet in cells (block of queries, group of candidates) of
bounded size; each cell keeps the k best of each query.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part, nor do rows without an id; only vectors of equal length
are compared; rows may repeat an id: all but the query's own row are candidates;
ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a cell: queries, candidates (fewer for long vectors: CELL_BYTES).
QUERY_ROWS, CANDIDATE_ROWS, CELL_BYTES = 2048, 16384, 32 << 20
#: Segments of a vector at each resolution.
RESOLUTIONS = (4, 16)


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a double; null if a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when((F.size(vector) > 0) & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """For each segment sqrt(L) mean and sqrt(L) deviation: their products bound inner products."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    length = np.diff(edges)
    sums, squares = np.add.reduceat(x, edges[:-1], 1), np.add.reduceat(x * x, edges[:-1], 1)
    mean = sums / length
    return np.hstack([mean * np.sqrt(length), np.sqrt(np.maximum(squares - mean * mean * length, 0))])


def best(queries: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, own: list[int | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The k best (ids, exact scores) of each query among the rows of x; ``own[i]`` is left out."""
    size = float(np.abs(queries).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
    exact = size < 2**53
    xf, qf = x.astype(float), queries.astype(float)
    levels = [(_statistics(qf, s), _statistics(xf, s)) for s in RESOLUTIONS]
    slack = 1e-9 * size + 1e-6
    out = []
    for at in range(0, len(qf), 64):
        coarse = levels[0][0][at : at + 64] @ levels[0][1].T + slack
        for i in range(len(coarse)):
            q, bound = qf[at + i], coarse[i]
            if own[at + i] is not None:
                bound[own[at + i]] = -np.inf
            some = np.argpartition(-bound, 4 * k)[: 4 * k] if len(bound) > 4 * k else np.arange(len(bound))
            first = xf[some] @ q
            first[~np.isfinite(bound[some])] = -np.inf
            enough = np.sort(first)[-k] if len(first) >= k else -np.inf
            alive = np.flatnonzero((bound >= enough - slack) & np.isfinite(bound))
            for fine_q, fine_x in levels[1:]:
                alive = alive[fine_x[alive] @ fine_q[at + i] + 2 * slack >= enough]
            if exact:
                score = (xf[alive] @ q).astype(np.int64)
            else:
                score = np.array([max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(queries[at + i], row)))) for row in x[alive]], np.int64)
            order = np.lexsort((ids[alive], -score.astype(object) if not exact else -score))[:k]
            out.append((ids[alive][order], score[order]))
    return out


def search(vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """For each row whose id is divisible by ``every`` its k best other rows: query_id, rank, key, score."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), whole_numbers(F.col(vector), scale).alias("v")).where("id is not null and v is not null").withColumn("dim", F.size("v"))
    spark = vectors.sparkSession
    is_query = F.pmod("id", F.lit(every)) == 0
    n, n_queries, dim = rows.agg(F.count("*"), F.count_if(is_query), F.max("dim")).first()
    dim = dim or 1
    per_cell = max(256, min(CANDIDATE_ROWS, CELL_BYTES // (8 * dim)))
    spread = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, n // 512))
    groups, blocks = max(1, math.ceil(n / per_cell), spread), max(1, math.ceil(n_queries / QUERY_ROWS))
    # both sides' keys need one type: an int and a long of equal value hash apart, and their cells would never meet
    group, block = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks)).cast("int")
    asked = rows.where(is_query).select("id", "v", "dim", block.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    given = rows.select("id", "v", "dim", group.alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    schema = pa.schema([("query_id", pa.int64()), ("no", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if left.num_rows and right.num_rows:
            width = left.column("dim")[0].as_py()
            side = lambda t: (t.column("id").to_numpy(), t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, width))
            (qid, q), (ids, x) = side(left), side(right)
            order = np.lexsort((*q.T[::-1], qid))  # the same in every cell: rows that repeat an id are told apart
            qid, q = qid[order], q[order]
            spot: dict[int, list[int]] = {}
            wanted = set(qid.tolist())
            for j, i in enumerate(ids.tolist()):
                if i in wanted:
                    spot.setdefault(i, []).append(j)
            own = [next((j for j in spot.get(i, ()) if (x[j] == v).all()), None) for i, v in zip(qid.tolist(), q)]
            no, last = 0, None
            for i, (found, score) in zip(qid.tolist(), best(q, ids, x, k, own)):
                no, last = (no + 1 if i == last else 0), i
                for col, v in zip(out, ([i] * len(found), [no] * len(found), found.tolist(), score.tolist())):
                    col += v
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)

    by = ("g", "b", "dim")
    found = asked.groupBy(*by).cogroup(given.groupBy(*by)).applyInArrow(cell, "query_id long, no int, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "no").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
