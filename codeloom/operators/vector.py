"""Dense and sparse retrieval, score fusion."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The reciprocal-rank constant; Okapi's k1, b and floor of negative idf.
RRF_K, K1, B, EPSILON = 60, 1.5, 0.75, 0.25
#: A term of lower-cased text, as ``tokens`` finds it.
_WORD = re.compile(r"[a-z0-9]+")
#: Rows of a cell of the vector search: queries, candidates (fewer for long vectors: CELL_BYTES).
QUERY_ROWS, CANDIDATE_ROWS, CELL_BYTES = 2048, 16384, 32 << 20


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalise(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Unit length; zero vectors stay."""
    n = norm(F.col(column))
    return vectors.withColumn(column, F.transform(column, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))


def top_k(queries: DataFrame, vectors: DataFrame, k: int, by: str | None = None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Exact top-k inner product: query_id, [by], key, score, rank0; ties go to the smaller key.

    Blocks of queries meet groups of candidates, both of bounded size, by an equi-join on their numbers and on the
    vectors' length; each cell keeps k rows of each query before the shuffle. A matrix product, whose sums run in any
    order, only rules candidates out, with room for its rounding; scores of the others are sums from the first component
    to the last, so that equal vectors tie. Null vectors take no part."""
    spark = vectors.sparkSession
    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q"), F.size("q").alias("dim")).where("q is not null")
    given = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"), (F.col(by).cast("string") if by else F.lit("")).alias("part"), F.size(column).alias("dim")).where("v is not null")
    n, dim = given.agg(F.count("*"), F.max("dim")).first()
    n_queries = asked.count()
    groups = max(math.ceil(n / max(256, min(CANDIDATE_ROWS, CELL_BYTES // (8 * max(1, dim or 0))))), min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, n // 512)), 1)
    blocks = max(1, math.ceil(n_queries / QUERY_ROWS))
    # both sides' keys need one type: an int and a long of equal value hash apart, and their cells would never meet
    group, block = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    asked = asked.withColumn("b", block).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    given = given.withColumn("g", group).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = pa.schema([("query_id", pa.int64()), ("part", pa.string()), ("id", pa.int64()), ("score", pa.float64())])

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if left.num_rows and right.num_rows:
            side = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            q, v = side(left, "q"), side(right, "v")
            ids, qid = right.column("id").to_numpy(), left.column("query_id").to_pylist()
            parts = right.column("part").combine_chunks().dictionary_encode(null_encoding="encode")
            codes = parts.indices.to_numpy()
            slack = 4 * (q.shape[1] + 1) * np.finfo(float).eps * np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1).max())
            for code, p in enumerate(parts.dictionary.to_pylist()):
                own = np.flatnonzero(codes == code)
                x, names = v[own], ids[own]
                for at in range(0, len(q), 64):
                    for i, s in enumerate(q[at : at + 64] @ x.T, at):
                        least = np.partition(s, len(s) - k)[len(s) - k] - slack[i] if len(s) > k else -np.inf
                        some = np.flatnonzero(~(s < least))
                        score = np.add.accumulate(x[some] * q[i], axis=1)[:, -1] if q.shape[1] else np.zeros(len(some))
                        best = np.lexsort((names[some], -score))[:k]
                        for col, y in zip(out, ([qid[i]] * len(best), [p] * len(best), names[some[best]].tolist(), score[best].tolist())):
                            col += y
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)

    on = ("g", "b", "dim")
    found = asked.groupBy(*on).cogroup(given.groupBy(*on)).applyInArrow(cell, "query_id long, part string, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "id")) - 1
    out = found.withColumn("rank0", rank).where(F.col("rank0") < k)
    return out.select("query_id", *([F.col("part").alias(by)] if by else []), F.col("id").alias(key), "score", "rank0")


def rrf(ranking: DataFrame, item: str, k: int | None = None, offset: int = 0, weight: Column | None = None) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, item, rank0) lists: sum of weight / (60 + rank0 + offset)."""
    w = F.lit(1.0) if weight is None else weight
    fused = ranking.groupBy("query_id", item).agg(F.round(F.sum(w / (F.lit(RRF_K + offset) + F.col("rank0"))), 12).alias("score"))
    if k is None:
        return fused
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), item))
    return fused.withColumn("rank", rank).where(F.col("rank") <= k)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def bm25(queries: DataFrame, docs: DataFrame, key: str = "doc_id", k: int | None = None) -> DataFrame:
    """Okapi BM25 of queries (query_id, text) over documents (key, text): query_id, key, score.

    idf is ln(N - n + 0.5) - ln(n + 0.5); negative ones become EPSILON times the mean idf. The
    terms of all documents are counted: the floor needs the mean idf of the whole vocabulary.

    A document is scored where it is read: counts of terms (one row a term and batch) and scores are all that is
    shuffled. The queries' terms with their weights go to every task; queries are few. Rows that repeat a key count
    as one document, so these few are counted and scored by joins.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.lower("text").alias("low"))
    twice = rows.groupBy("id").agg(F.count("*").alias("c")).where("c > 1 or id is null").select("id")
    repeated = not twice.isEmpty()
    once = rows.join(twice, "id", "left_anti") if repeated else rows
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    wanted = asked.collect()

    def count(batches):
        for batch in batches:
            n: Counter = Counter()
            total = 0
            for low in batch.column("low").to_pylist():
                if low is not None:
                    w = _WORD.findall(low)
                    total += len(w)
                    n.update(set(w))
            nulls = batch.column("low").null_count
            yield pa.RecordBatch.from_pydict({"term": [None, *n], "n": [batch.num_rows, *n.values()], "words": [total, *[0] * len(n)], "nulls": [nulls, *[0] * len(n)]}, schema=counted)

    counted = pa.schema([("term", pa.string()), ("n", pa.int64()), ("words", pa.int64()), ("nulls", pa.int64())])
    parts = once.select("low").mapInArrow(count, "term string, n long, words long, nulls long")
    if repeated:
        words = rows.join(twice, "id", "left_semi").select("id", F.regexp_extract_all("low", F.lit("[a-z0-9]+"), F.lit(0)).alias("w"))
        posted = words.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
        more = posted.groupBy("term").agg(F.count_distinct("id").alias("n"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("nulls"))
        sizes = words.agg(F.lit(None).cast("string").alias("term"), F.count("*").alias("n"), F.coalesce(F.sum(F.size("w")), F.lit(0)).cast("long").alias("words"), F.count_if(F.col("w").isNull()).alias("nulls"))
        parts = parts.unionByName(more).unionByName(sizes)
    counts = parts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.sum("nulls").alias("nulls")).persist()
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"
    try:
        whole = counts.where("term is null").first()
        n_docs, total, nulls = (whole["n"], whole["words"], whole["nulls"]) if whole else (0, 0, 0)
        avg_len = total / (n_docs - nulls) if n_docs > nulls else 0.0
        raw = (F.log(n_docs - F.col("n") + 0.5) - F.log(F.col("n") + 0.5)).alias("raw")
        mean = counts.where("term is not null").agg(F.avg(raw)).first()[0]
        needed = F.broadcast(asked.select("term").distinct())  # the queries' terms
        idf = {r["term"]: EPSILON * mean if r["raw"] < 0 else r["raw"] for r in counts.join(needed, "term").select("term", raw).collect()}
    finally:
        counts.unpersist()
    ids = sorted({r["query_id"] for r in wanted if r["term"] in idf}, key=repr)
    place = {q: i for i, q in enumerate(ids)}
    by_term: dict[str, list[tuple[int, float]]] = {}
    for r in wanted:
        if r["term"] in idf:
            by_term.setdefault(r["term"], []).append((place[r["query_id"]], r["qtf"] * idf[r["term"]]))
    table = spark.sparkContext.broadcast((ids, {t: (np.array([i for i, _ in x]), np.array([y for _, y in x])) for t, x in by_term.items()}))

    def score(batches):
        qids, weights = table.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out, names, sums = [], [], []
                for i, low in enumerate(part.column("low").to_pylist()):
                    words = _WORD.findall(low or "")
                    met, s = np.zeros(len(qids), bool), np.zeros(len(qids))
                    for t, tf in Counter(words).items():
                        if t in weights:
                            who, w = weights[t]
                            s[who] += w * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / avg_len))
                            met[who] = True
                    hit = np.flatnonzero(met)
                    out += [i] * len(hit)
                    names += [qids[j] for j in hit.tolist()]
                    sums += s[hit].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(names, arrow[0].type), part.column("id").take(pa.array(out, pa.int64())), pa.array(sums, pa.float64())], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    scores = once.select("id", "low").mapInArrow(score, schema)
    if repeated:
        known = spark.createDataFrame(list(idf.items()), "term string, idf double")
        part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avg_len)))
        scores = scores.unionByName(asked.join(known, "term").join(posted, "term").groupBy("query_id", "id").agg(F.sum(part).alias("score")).select("query_id", "id", "score"))
    scores = scores.withColumnRenamed("id", key)
    if k is None:
        return scores
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def min_max(scores: DataFrame, column: str = "score", by: str = "query_id") -> DataFrame:
    """Scaled to 0..1 within a query; constant lists become zeros."""
    w = Window.partitionBy(by)
    lo, hi = F.min(column).over(w), F.max(column).over(w)
    return scores.withColumn(column, F.when(hi > lo, (F.col(column) - lo) / (hi - lo)).otherwise(F.lit(0.0)))


def convex(dense: DataFrame, sparse: DataFrame, item: str, w_dense: float = 0.5, w_sparse: float = 0.5) -> DataFrame:
    """Weighted mean of two min-max scaled lists over the union of their items; weights are made to sum to 1."""
    total = w_dense + w_sparse
    a, b = (w_dense / total, w_sparse / total) if total > 0 else (0.0, 0.0)
    d, s = min_max(dense).select("query_id", item, F.col("score").alias("d")), min_max(sparse).select("query_id", item, F.col("score").alias("s"))
    both = d.join(s, ["query_id", item], "full")
    return both.select("query_id", item, (a * F.coalesce("d", F.lit(0.0)) + b * F.coalesce("s", F.lit(0.0))).alias("score"))


def hashed_embedder(text: str, dim: int = 64) -> list[float]:
    """A deterministic bag of hashed tokens; it stands in for a model and has no semantics."""
    import re

    import xxhash

    out = [0.0] * dim
    for t in re.findall(r"[a-z0-9]+", text.lower()):
        h = xxhash.xxh64_intdigest(t)
        out[h % dim] += 1.0 if h >> 63 else -1.0
    n = math.sqrt(sum(x * x for x in out))
    return [x / n for x in out] if n else out


def embed(docs: DataFrame, embedder=hashed_embedder, text: str = "text") -> DataFrame:
    """Adds ``embedding`` by any function from a text to a list of floats, over Arrow batches."""
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(embedder)

    return docs.withColumn("embedding", run(text))
