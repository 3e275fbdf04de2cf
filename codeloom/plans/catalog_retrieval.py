"""Registered queries: vectors, fusion, ranking, text functions, analytics, maintenance, evaluation."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import identity, text as T
from ..operators import analytics, chunking, evaluate, incremental, joins, rank, resolve, vector
from ..streaming import changes
from .catalog import register


def _queries(m, every: int = 50):
    return m.embeddings.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


_DOT = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))"


@register("SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 5) AS n2 FROM {embeddings}")
def l2_normalise(m):
    unit = vector.normalise(m.embeddings)
    return unit.select("vec_id", F.round(joins.dot(F.col("embedding"), F.col("embedding")), 5).alias("n2"))


@register(f"SELECT query_id, vec_id, rank0, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, {_DOT} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, v.vec_id) - 1 AS rank0 FROM {{embeddings}} q JOIN {{embeddings}} v ON true WHERE q.vec_id % 50 = 0) z WHERE rank0 < 10")
def vector_top_k(m):
    return vector.top_k(_queries(m), m.embeddings, 10).select("query_id", "vec_id", "rank0", F.round("score", 6).alias("score"))


_TIERS = f"SELECT q.vec_id AS query_id, v.vec_id AS vec_id, row_number() OVER (PARTITION BY q.vec_id, v.vec_id % 3 ORDER BY {_DOT} DESC, v.vec_id) - 1 AS rank0 FROM {{embeddings}} q JOIN {{embeddings}} v ON true WHERE q.vec_id % 50 = 0"


@register(f"SELECT query_id, vec_id, round(score, 9) AS score, label FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS r FROM (SELECT query_id, vec_id, sum(1.0 / (60 + rank0)) AS score FROM ({_TIERS}) t WHERE rank0 < 50 GROUP BY 1, 2) s) z JOIN {{embeddings}} e USING (vec_id) WHERE r <= 10")
def semantic_search_rrf(m):
    ranked = vector.top_k(_queries(m), m.embeddings.withColumn("tier", F.col("vec_id") % 3), 50, by="tier")
    best = vector.rrf(ranked, "vec_id", k=10)
    return best.join(m.embeddings.select("vec_id", "label"), "vec_id").select("query_id", "vec_id", F.round("score", 9).alias("score"), "label")


_Q = "SELECT item_id AS query_id, text FROM {benchmark}"
_BM = f"""SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len))) AS score FROM (
    SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM ({_Q}) a) b GROUP BY 1, 2) q
    JOIN (SELECT term, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END AS idf FROM (SELECT term, ln(n_docs - n + 0.5) - ln(n + 0.5) AS raw FROM (SELECT term, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM {{documents}}) c GROUP BY term) d, (SELECT count(*) AS n_docs FROM {{documents}}) e) f) i USING (term)
    JOIN (SELECT doc_id, term, dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {{documents}}) g) h GROUP BY 1, 2, 3) t USING (term),
    (SELECT avg(len(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS avg_len FROM {{documents}}) l GROUP BY 1, 2"""


@register(f"SELECT query_id, doc_id, round(score, 4) AS score FROM ({_BM}) z")
def bm25(m):
    return vector.bm25(m.sql(_Q), m.documents).withColumn("score", F.round("score", 4))


@register("SELECT query_id, vec_id, CASE WHEN hi > lo THEN round((x - lo) / (hi - lo), 6) ELSE 0 END AS score FROM (SELECT label AS query_id, vec_id, x, min(x) OVER (PARTITION BY label) AS lo, max(x) OVER (PARTITION BY label) AS hi FROM (SELECT label, vec_id, CAST(vec_id * 37 % 101 AS DOUBLE) AS x FROM {embeddings}) a) b")
def min_max(m):
    rows = m.embeddings.select(F.col("label").alias("query_id"), "vec_id", (F.col("vec_id") * 37 % 101).cast("double").alias("score"))
    return vector.min_max(rows).withColumn("score", F.round("score", 6))


_MM = "CASE WHEN max(x) OVER (PARTITION BY label) > min(x) OVER (PARTITION BY label) THEN (x - min(x) OVER (PARTITION BY label)) / (max(x) OVER (PARTITION BY label) - min(x) OVER (PARTITION BY label)) ELSE 0 END"


@register(f"SELECT coalesce(d.label, s.label) AS query_id, coalesce(d.vec_id, s.vec_id) AS vec_id, round(0.75 * coalesce(d.y, 0) + 0.25 * coalesce(s.y, 0), 6) AS score FROM (SELECT label, vec_id, {_MM} AS y FROM (SELECT label, vec_id, CAST(vec_id * 37 % 101 AS DOUBLE) AS x FROM {{embeddings}} WHERE vec_id % 2 = 0) a) d FULL JOIN (SELECT label, vec_id, {_MM} AS y FROM (SELECT label, vec_id, CAST(vec_id * 53 % 97 AS DOUBLE) AS x FROM {{embeddings}} WHERE vec_id % 3 = 0) b) s ON d.label = s.label AND d.vec_id = s.vec_id")
def convex_fusion(m):
    rows = lambda k, mod, n: m.embeddings.where(F.col("vec_id") % n == 0).select(F.col("label").alias("query_id"), "vec_id", (F.col("vec_id") * k % mod).cast("double").alias("score"))
    return vector.convex(rows(37, 101, 2), rows(53, 97, 3), "vec_id", 3.0, 1.0).withColumn("score", F.round("score", 6))


@register("SELECT doc_id, round(n_chars % 10 + CASE WHEN lang IN ('fr', 'de') THEN 0.12 ELSE 0 END, 6) AS score FROM {documents}")
def category_boost(m):
    rows = m.documents.select("doc_id", F.array("lang").alias("tags"), (F.col("n_chars") % 10).cast("double").alias("score"))
    return rank.category_boost(rows, F.array(F.lit("fr"), F.lit("de"))).select("doc_id", F.round("score", 6).alias("score"))


_POOL = "SELECT label AS query_id, vec_id, vec_id % 7 AS f, concat('w', CAST(vec_id % 9 AS STRING)) AS short, concat(' w', CAST(vec_id % 5 AS STRING), ' w', CAST(vec_id % 4 AS STRING), ' ') AS body, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM {embeddings}"


@register(f"SELECT p.query_id, p.vec_id, round(least(0.2, 0.05 * coalesce(n, 0)) + CASE WHEN nf.f IS NOT NULL THEN 0.08 ELSE 0 END, 6) AS score FROM ({_POOL}) p LEFT JOIN (SELECT a.query_id, a.vec_id, count(*) AS n FROM ({_POOL}) a JOIN ({_POOL}) b ON a.query_id = b.query_id AND b.body LIKE '%' || a.short || '%' WHERE a.r <= 20 AND b.r <= 20 GROUP BY 1, 2) c ON p.query_id = c.query_id AND p.vec_id = c.vec_id LEFT JOIN (SELECT DISTINCT query_id, f FROM ({_POOL}) z WHERE r <= 5) nf ON nf.query_id = p.query_id AND nf.f = p.f WHERE p.r <= 20")
def composite_score(m):
    pool = m.sql(_POOL).where("r <= 20").select("query_id", F.col("vec_id").alias("item"), F.col("f").alias("path"), F.concat(F.lit("x."), "short").alias("scope"), F.col("body").alias("text"), F.lit(0.0).alias("score"), (-F.col("r")).alias("semantic"), F.array(F.lit("t")).alias("tags"))
    return rank.composite(pool, F.array(F.lit("u"))).select("query_id", F.col("item").alias("vec_id"), F.round("score", 6).alias("score"))


_FINAL = "SELECT label AS query_id, vec_id AS item, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rank0 FROM {embeddings}"
_SUMS = "SELECT label AS query_id, vec_id AS item, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) - 1 AS rank0 FROM {embeddings}"


@register(f"SELECT query_id, item, round(sum(w / (61 + rank0)), 9) AS score FROM (SELECT query_id, item, rank0, CAST(1.0 AS DOUBLE) AS w FROM ({_FINAL}) a UNION ALL SELECT query_id, item, rank0, 0.5 FROM ({_SUMS}) b WHERE rank0 < 30) z GROUP BY 1, 2")
def summary_fusion(m):
    final = m.sql(_FINAL).select("*", F.col("item").cast("string").alias("path"), F.col("item").cast("string").alias("scope"), F.col("item").cast("string").alias("text"), F.lit(1).alias("tier"))
    return rank.fuse_summaries(final, m.sql(_SUMS)).select("query_id", "item", F.round("score", 9).alias("score")).withColumn("query_id", F.col("query_id").cast("int"))


@register("SELECT query_id, item FROM (SELECT label AS query_id, vec_id AS item, sum(vec_id % 50 + 1) OVER (PARTITION BY label ORDER BY CASE WHEN vec_id % 4 = 0 AND 1000 - vec_id >= 0.9 * top THEN 0 ELSE 1 END, vec_id) AS used FROM (SELECT *, max(CASE WHEN vec_id % 4 <> 0 THEN 1000 - vec_id END) OVER (PARTITION BY label) AS top FROM {embeddings}) a) z WHERE used <= 400")
def priority_pack(m):
    rows = m.embeddings.select(F.col("label").alias("query_id"), F.col("vec_id").alias("item"), F.col("vec_id").alias("pos"), (F.col("vec_id") % 50 + 1).alias("n_tokens"), (1000 - F.col("vec_id")).cast("double").alias("score"), F.when(F.col("vec_id") % 4 == 0, "structural").otherwise("semantic").alias("source"))
    return rank.pack_prefix(rows, 400).select("query_id", "item")


@register()
def token_budget_pack(m):
    rows = m.documents.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("pos"), F.size(vector.tokens(F.col("text"))).alias("n_tokens"))
    return rank.pack_skipping(rows, 4000)


@register("SELECT source AS path, lang AS query_id, min(doc_id) AS pos FROM {documents} GROUP BY 1, 2")
def first_per_file(m):
    return rank.first_per_file(m.documents.select(F.col("source").alias("path"), F.col("lang").alias("query_id"), F.col("doc_id").alias("pos"))).select("path", "query_id", "pos")


@register("SELECT query_id, bucket, pos FROM (SELECT lang AS query_id, source AS bucket, doc_id AS pos, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS r FROM {documents}) z WHERE (bucket = 'src1' AND r <= 3) OR (bucket = 'src2' AND r <= 1) OR bucket NOT IN ('src1', 'src2')")
def capped_buckets(m):
    rows = m.documents.select(F.col("lang").alias("query_id"), F.col("source").alias("bucket"), F.col("doc_id").alias("pos"))
    return rank.bucket_cap(rows, "bucket", {"src1": 3, "src2": 1})


@register("SELECT e.vec_id, e.vec_id % 5 <> 0 AS kept FROM {embeddings} e")
def vector_reuse(m):
    want = m.embeddings.select("vec_id", (F.col("vec_id") % 5).alias("text_hash"))
    old = m.embeddings.select("vec_id", F.when(F.col("vec_id") % 5 == 0, 99).otherwise(F.col("vec_id") % 5).alias("text_hash"))
    stay, todo = incremental.reuse_vectors(want, old, m.embeddings)
    return stay.select("vec_id", F.lit(True).alias("kept")).unionByName(todo.select("vec_id", F.lit(False).alias("kept")))


@register("SELECT vec_id, label FROM {embeddings} WHERE vec_id IN (SELECT doc_id FROM {documents} WHERE lang = 'en')")
def stale_purge(m):
    return incremental.purge_stale(m.embeddings, m.documents.where("lang = 'en'").select(F.col("doc_id").alias("vec_id"))).select("vec_id", "label")


# text functions

@register("SELECT doc_id, CAST(concat('0x', substr(md5(concat('tier1_surgical::', source, '::', CAST(doc_id AS VARCHAR))), 1, 15)) AS BIGINT) AS id FROM {documents}")
def stable_ids(m):
    return m.documents.select("doc_id", identity.stable_id(F.lit("tier1_surgical"), F.col("source"), F.col("doc_id").cast("string")).alias("id"))


@register("SELECT doc_id, md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS h FROM {documents}")
def file_hash(m):
    return m.documents.select("doc_id", identity.content_hash(F.col("text").cast("binary")).alias("h"))


@register("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n FROM {documents}")
def bm25_tokens(m):
    return m.documents.select("doc_id", F.size(vector.tokens(F.col("text"))).cast("long").alias("n"))


@register("SELECT page_id, list_sort(list_distinct(list_filter(regexp_split_to_array(url, '[_\\-\\s]+'), lambda x: len(x) > 1)))[1] AS first_token FROM (SELECT page_id, lower(url) AS url FROM {pages}) p")
def name_tokens(m):
    return m.pages.select("page_id", F.get(F.array_sort(T.name_tokens(F.lower("url"))), 0).alias("first_token"))


@register("SELECT page_id, CASE WHEN list_has_any(t, ['request', 'response', 'fetch', 'http', 'https', 'api', 'endpoint', 'url', 'uri', 'header', 'headers', 'cookie', 'cookies', 'websocket', 'socket', 'client', 'route', 'router', 'routing', 'middleware', 'proxy', 'webhook', 'rest', 'graphql', 'grpc', 'download', 'upload', 'stream', 'connect', 'disconnect', 'send', 'receive', 'post', 'patch', 'put']) THEN 1 ELSE 0 END AS network FROM (SELECT page_id, regexp_split_to_array(regexp_replace(lower(url), '[^a-z]+', ' ', 'g'), ' ') AS t FROM {pages}) p")
def category_tags(m):
    tags = T.classify_query(F.regexp_replace(F.lower("url"), "[^a-z]+", " "))
    return m.pages.select("page_id", F.when(F.array_contains(tags, "[CAT_NETWORK]"), 1).otherwise(0).alias("network"))


_LAYER_PATH = "concat(CASE doc_id % 6 WHEN 0 THEN 'lib/admin/' WHEN 1 THEN 'functions/src/' WHEN 2 THEN 'app/page.tsx/' WHEN 3 THEN 'types/' ELSE 'x/' END, CASE WHEN doc_id % 5 = 0 THEN 'page.tsx' ELSE 'a.ts' END)"


@register(f"SELECT doc_id, CASE WHEN p LIKE '%lib/admin%' THEN 'DATABASE (Admin SDK)' WHEN p LIKE '%functions/src%' THEN 'CLOUD FUNCTION' WHEN p LIKE '%.tsx%' THEN CASE WHEN p LIKE '%app/%' AND p LIKE '%page.tsx%' THEN 'SERVER COMPONENT' ELSE 'CLIENT COMPONENT (UI)' END WHEN p LIKE '%lib/%' OR p LIKE '%types/%' OR p LIKE '%models/%' THEN 'CORE LOGIC / LIB' ELSE 'UTILITY' END AS layer FROM (SELECT doc_id, {_LAYER_PATH} AS p FROM {{documents}}) z")
def trace_layer(m):
    return m.documents.select("doc_id", T.trace_layer(F.expr(_LAYER_PATH), F.lit("")).alias("layer"))


@register(f"SELECT doc_id, CASE WHEN p LIKE '%lib/admin%' THEN 'DATABASE' WHEN p LIKE '%functions/src%' THEN 'CLOUD_FUNCTION' WHEN p LIKE '%app/%' AND p LIKE '%page.tsx' THEN 'SERVER_COMPONENT' WHEN p LIKE '%lib/%' OR p LIKE '%types/%' OR p LIKE '%models/%' THEN 'CORE_LIB' ELSE 'UTILITY' END AS layer FROM (SELECT doc_id, {_LAYER_PATH} AS p FROM {{documents}}) z")
def investigate_layer(m):
    return m.documents.select("doc_id", T.layer(F.expr(_LAYER_PATH), F.lit("")).alias("layer"))


@register("SELECT doc_id, regexp_matches(lower(text), 'set|update|add|transaction|commit|write|delete|mutate') AS writes, regexp_matches(lower(text), 'get|fetch|query|where|onsnapshot|subscribe|use|read') AS reads FROM {documents}")
def op_profile(m):
    w, r = T.op_profile(F.col("text"))
    return m.documents.select("doc_id", w.alias("writes"), r.alias("reads"))


@register("SELECT conv_id, turn, len(list_distinct(regexp_extract_all(text, '[a-zA-Z_][0-9A-Za-z_]{3,}'))) AS n FROM {conversations}")
def domain_keywords(m):
    return m.conversations.select("conv_id", "turn", F.size(T.domain_keywords(F.col("text"), ["\0"])).cast("long").alias("n"))


@register("SELECT page_id, regexp_replace(html, '([a-zA-Z][a-zA-Z0-9+.-]*://[^ :/@\"''<>]+:)[^ @/\"''<>]+@', '\\1[REDACTED:url-credential]@', 'g') = html AS clean FROM {pages}")
def redaction(m):
    return m.pages.select("page_id", (T.redact(F.col("html")) == F.col("html")).alias("clean"))


@register("SELECT page_id, CASE WHEN regexp_extract(url, '([^/]+)$', 1) = '' THEN '' ELSE regexp_extract(regexp_extract(url, '([^/]+)$', 1), '([^.]*)$', 1) END AS stem FROM {pages} WHERE url NOT LIKE '%index%' AND url NOT LIKE '%.ts' AND url NOT LIKE '%.py'")
def module_stems(m):
    keep = ~F.col("url").contains("index") & ~F.col("url").endswith(".ts") & ~F.col("url").endswith(".py")
    return m.pages.where(keep).select("page_id", T.module_stem(F.col("url")).alias("stem"))


@register()
def token_window_chunks(m):
    return chunking.chunk_files(m.documents.select(F.col("doc_id").cast("string").alias("path"), "text"), 1).select("path", "scope", "start_line", "end_line", F.md5("text").alias("text_md5"))


# graph analytics

@register("SELECT node, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT dst AS node, 1 AS i, 0 AS o FROM (SELECT DISTINCT src, dst FROM {small} WHERE src <> dst) a UNION ALL SELECT src, 0, 1 FROM (SELECT DISTINCT src, dst FROM {small} WHERE src <> dst) b) z GROUP BY node")
def fan_in_out(m):
    return analytics.degrees(analytics.aggregate_edges(m.small))


_REL = "SELECT concat('c', CAST(c_custkey AS STRING)) AS src, concat('n', CAST(c_nationkey AS STRING)) AS dst, 'CALLS' AS kind FROM {customer} UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)), 'IMPORTS' FROM {nation}"
_COMM = "SELECT concat('c', CAST(c_custkey AS STRING)) AS node, CAST(c_nationkey AS INT) AS community FROM {customer} UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), CAST(n_nationkey AS INT) FROM {nation} UNION ALL SELECT concat('r', CAST(r_regionkey AS STRING)), 100 + CAST(r_regionkey AS INT) FROM {region}"
_UND = f"SELECT src AS a, dst AS b, CAST(CASE kind WHEN 'CALLS' THEN 1.0 ELSE 0.6 END AS DOUBLE) AS w FROM ({_REL}) e"


@register(f"SELECT community, round(coalesce(sum(CASE WHEN same THEN w END) / sum(w), 0), 6) AS cohesion FROM (SELECT m.community, e.w, x.community = y.community AS same FROM ({_COMM}) m JOIN ({_UND}) e ON m.node = e.a OR m.node = e.b JOIN ({_COMM}) x ON x.node = e.a JOIN ({_COMM}) y ON y.node = e.b WHERE NOT (x.community = y.community AND m.node = e.b)) z GROUP BY community")
def cohesion(m):
    und = analytics.undirected(analytics.aggregate_edges(m.sql(_REL)))
    return analytics.cohesion(und, m.sql(_COMM)).withColumn("cohesion", F.round("cohesion", 6))


@register(f"SELECT round(sum(coalesce(l, 0) / m - power(d / (2 * m), 2)), 6) AS modularity FROM (SELECT community, sum(w) AS d FROM (SELECT x.community, e.w FROM ({_UND}) e JOIN ({_COMM}) x ON x.node = e.a UNION ALL SELECT y.community, e.w FROM ({_UND}) e JOIN ({_COMM}) y ON y.node = e.b) q GROUP BY community) dd LEFT JOIN (SELECT x.community, sum(e.w) AS l FROM ({_UND}) e JOIN ({_COMM}) x ON x.node = e.a JOIN ({_COMM}) y ON y.node = e.b WHERE x.community = y.community GROUP BY 1) ll USING (community), (SELECT sum(w) AS m FROM ({_UND}) t) mm")
def modularity(m):
    und = analytics.undirected(analytics.aggregate_edges(m.sql(_REL)))
    return analytics.modularity(und, m.sql(_COMM)).withColumn("modularity", F.round("modularity", 6))


@register()
def louvain_communities(m):
    pairs = analytics.aggregate_edges(m.sql(_REL))
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return analytics.communities(analytics.undirected(pairs), nodes)


@register("SELECT n AS node, CAST(0 AS DOUBLE) AS betweenness FROM (SELECT concat('c', CAST(c_custkey AS STRING)) AS n FROM {customer} UNION SELECT concat('r', CAST(n_regionkey AS STRING)) FROM {nation}) z UNION ALL SELECT concat('n', CAST(k AS STRING)), round(CAST(cnt AS DOUBLE) / ((t - 1) * (t - 2)), 9) FROM (SELECT n_nationkey AS k, count(c_custkey) AS cnt FROM {nation} LEFT JOIN (SELECT * FROM {customer}) c ON c_nationkey = n_nationkey GROUP BY 1) x, (SELECT (SELECT count(*) FROM {customer}) + (SELECT count(*) FROM {nation}) + (SELECT count(DISTINCT n_regionkey) FROM {nation}) AS t) y")
def betweenness(m):
    pairs = analytics.aggregate_edges(m.sql(_REL))
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return analytics.betweenness(pairs, nodes).withColumn("betweenness", F.round("betweenness", 9))


_OWN = "SELECT concat('n', CAST(c_nationkey AS STRING)) AS owner, concat('c', CAST(c_custkey AS STRING)) AS member FROM {customer}"
_MEM = "SELECT concat('c', CAST(c_custkey AS STRING)) AS node, CAST(c_custkey % 5 AS INT) AS community FROM {customer}"


@register(f"SELECT owner, span, n_members, round(0.5 * span / 5 + 0.3 * n_members / (SELECT max(n) FROM (SELECT count(*) AS n FROM {{customer}} GROUP BY c_nationkey) t) + 0.2 * span / 5, 6) AS score FROM (SELECT owner, count(DISTINCT community) AS span, count(*) AS n_members FROM ({_OWN}) o JOIN ({_MEM}) m ON o.member = m.node GROUP BY owner) z WHERE span >= 3")
def god_objects(m):
    owns, mem = m.sql(_OWN), m.sql(_MEM)
    central = owns.join(mem.withColumnRenamed("node", "member"), "member").groupBy(F.col("owner").alias("node")).agg(F.count_distinct("community").cast("double").alias("betweenness"), F.count("*").alias("fan_in"))
    return analytics.god_objects(owns, mem, central).withColumn("score", F.round("score", 6))


@register(f"SELECT owner, count(*) AS n_parts, CAST(sum(n) AS BIGINT) AS n_members FROM (SELECT owner, community, count(*) AS n FROM ({_OWN}) o JOIN ({_MEM}) m ON o.member = m.node GROUP BY 1, 2 HAVING count(*) >= 2) z GROUP BY owner HAVING count(*) >= 2")
def split_suggestions(m):
    return analytics.split_suggestions(m.sql(_OWN), m.sql(_MEM)).groupBy("owner").agg(F.count("*").alias("n_parts"), F.sum(F.size("members")).alias("n_members"))


@register(f"SELECT x.community AS row, y.community AS col, round(sum(w), 6) AS weight FROM ({_UND}) e JOIN ({_COMM}) x ON x.node = e.a JOIN ({_COMM}) y ON y.node = e.b GROUP BY 1, 2")
def dsm_by_community(m):
    return analytics.matrix_by_community(analytics.aggregate_edges(m.sql(_REL)), m.sql(_COMM)).withColumn("weight", F.round("weight", 6))


@register(f"SELECT a.place AS row, b.place AS col, round(w, 6) AS weight FROM ({_UND}) e JOIN (SELECT node, row_number() OVER (ORDER BY community, node) - 1 AS place FROM ({_COMM}) m) a ON a.node = e.a JOIN (SELECT node, row_number() OVER (ORDER BY community, node) - 1 AS place FROM ({_COMM}) m) b ON b.node = e.b")
def dsm_symbols(m):
    order = m.sql(_COMM).select("node", F.col("community").alias("g"), F.col("node").alias("k"))
    return analytics.matrix(analytics.aggregate_edges(m.sql(_REL)), order).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.round("weight", 6).alias("weight"))


@register("SELECT c.community, count(*) AS size FROM (SELECT c_custkey % 5 AS community FROM {customer}) c GROUP BY 1")
def community_labels(m):
    mem = m.sql(_MEM)
    symbols = m.customer.select(F.concat(F.lit("c"), "c_custkey").alias("fqn"), F.col("c_mktsegment").alias("path"))
    central = mem.select("node", F.lit(0.0).alias("betweenness"))
    return analytics.community_labels(mem, symbols, central).select("community", "size")


# resolution

@register("""SELECT source_fqn, target, resolved_target, outcome FROM (SELECT e.source_fqn, e.target, CASE WHEN n = 1 THEN r.fqn WHEN nl = 1 THEN near END AS resolved_target, CASE WHEN n IS NULL THEN 'unknown' WHEN n = 1 THEN 'unique' WHEN nl = 1 THEN 'same_file' ELSE 'ambiguous' END AS outcome
    FROM (SELECT DISTINCT concat('C', CAST(c_custkey AS STRING)) AS source_fqn, concat('K', CAST(c_custkey * 3 % 110 AS STRING)) AS target FROM {customer}) e JOIN {symbols} s ON s.fqn = e.source_fqn
    LEFT JOIN (SELECT name, count(*) AS n, max(fqn) AS fqn FROM {symbols} GROUP BY name) r ON r.name = e.target
    LEFT JOIN (SELECT name, path, count(*) AS nl, max(fqn) AS near FROM {symbols} GROUP BY name, path) l ON l.name = e.target AND l.path = s.path) z""")
def call_resolution(m):
    edges = m.customer.select(F.concat(F.lit("C"), "c_custkey").alias("source_fqn"), F.concat(F.lit("K"), (F.col("c_custkey") * 3 % 110).cast("string")).alias("target"), F.lit("CALLS").alias("kind"), F.lit(None).cast("string").alias("resolved_target"), F.lit(None).cast("string").alias("receiver_type"), F.lit(None).cast("string").alias("bound_module"), F.lit(True).alias("member_call"), F.lit(None).cast("boolean").alias("external"))
    return resolve.resolve_calls(edges, m.symbols).select("source_fqn", "target", "resolved_target", "outcome")


@register("SELECT path, specifier, resolved FROM (SELECT DISTINCT f.path, concat('./d', CAST(f.doc_id + 3 AS VARCHAR)) AS specifier, t.path AS resolved FROM {files} f LEFT JOIN {files} t ON t.path = concat('src/d', CAST(f.doc_id + 3 AS VARCHAR), '.ts')) z")
def script_import_resolution(m):
    asked = m.files.select("path", F.concat(F.lit("./d"), (F.col("doc_id") + 3).cast("string")).alias("specifier"))
    return resolve.resolve_script_imports(asked, m.files)


@register("SELECT f.path, concat('src.d', CAST(f.doc_id + 3 AS VARCHAR)) AS specifier, t.path AS resolved FROM {files} f LEFT JOIN {files} t ON t.path = concat('src/d', CAST(f.doc_id + 3 AS VARCHAR), '.py')")
def python_import_resolution(m):
    asked = m.files.select("path", F.concat(F.lit("src.d"), (F.col("doc_id") + 3).cast("string")).alias("specifier"))
    return resolve.resolve_python_imports(asked, m.files)


@register("SELECT path, specifier, specifier = 'os.path' OR specifier = 'numpy' AS external FROM (SELECT path, CASE doc_id % 3 WHEN 0 THEN 'os.path' WHEN 1 THEN 'numpy' ELSE 'src.d2' END AS specifier FROM {files}) z")
def external_imports(m):
    asked = m.files.select("path", F.expr("CASE doc_id % 3 WHEN 0 THEN 'os.path' WHEN 1 THEN 'numpy' ELSE 'src.d2' END").alias("specifier"))
    return resolve.external_imports(asked, m.files)


# maintenance

@register("SELECT path, content_hash FROM {disk} UNION ALL SELECT path, content_hash FROM {stored} WHERE path NOT IN (SELECT path FROM {disk}) AND path NOT LIKE '%5.py'")
def upsert_files(m):
    gone = m.stored.where("path LIKE '%5.py'").select("path").join(m.disk, "path", "left_anti")
    return incremental.upsert(m.stored, m.disk, gone)


@register("SELECT md5(text) AS text_hash, length(min(text)) AS n FROM {documents} WHERE doc_id % 2 = 0 AND md5(text) NOT IN (SELECT md5(text) FROM {documents} WHERE doc_id % 2 = 1) GROUP BY 1")
def summary_cache_misses(m):
    rows = m.documents.select("doc_id", F.md5("text").alias("text_hash"), "text")
    out = incremental.cache_misses(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1").select("text_hash"))
    return out.select("text_hash", F.length("text").cast("long").alias("n"))


@register("SELECT user_id, min(ts) AS first_at, count(*) AS n_events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 600 THEN 0 ELSE 1 END AS new FROM {events}) a) b GROUP BY user_id, s")
def debounce_sessions(m):
    return changes.debounce(m.events, "user_id", gap="600 seconds").select("user_id", "first_at", "n_events")


# evaluation

_RANKING = "SELECT vec_id % 20 AS query_id, vec_id AS item_id, row_number() OVER (PARTITION BY vec_id % 20 ORDER BY vec_id * 7919 % 1009, vec_id) - 1 AS rank, label FROM {embeddings}"
_HITS = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM ({_RANKING}) r WHERE label = 3"
_SCORES = f"""SELECT n.query_id, coalesce(1.0 / (h.first + 1), 0) AS mrr, coalesce(h.dcg / i.ideal, 0) AS ndcg, coalesce(h.ap / h.n_rel, 0) AS map, coalesce(h.h5 / h.n_rel, 0) AS recall_5, CASE WHEN coalesce(h.h5, 0) > 0 THEN 1.0 ELSE 0.0 END AS success_5 FROM (SELECT DISTINCT query_id FROM ({_RANKING}) q) n
    LEFT JOIN (SELECT query_id, min(rank) AS first, sum(1 / log2(rank + 2)) AS dcg, sum(CAST(k AS DOUBLE) / (rank + 1)) AS ap, count(*) AS n_rel, CAST(count(CASE WHEN rank < 5 THEN 1 END) AS DOUBLE) AS h5 FROM ({_HITS}) z GROUP BY 1) h ON n.query_id = h.query_id
    LEFT JOIN (SELECT query_id, sum(1 / log2(k + 1)) AS ideal FROM ({_HITS}) y GROUP BY 1) i ON n.query_id = i.query_id"""


def _scores(m):
    ranking = m.sql(_RANKING)
    return evaluate.query_scores(ranking, ranking.where("label = 3").select("query_id", "item_id", F.lit(1).alias("gain")))


@register(f"SELECT query_id, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, round(map, 6) AS map, round(recall_5, 6) AS recall_5, round(success_5, 6) AS success_5 FROM ({_SCORES}) s")
def ir_metrics(m):
    return _scores(m).select("query_id", *(F.round(c, 6).alias(c) for c in ("mrr", "ndcg", "map", "recall_5", "success_5")))


@register(f"SELECT round(avg(ndcg), 6) AS mean, round(1.96 * stddev_samp(ndcg) / sqrt(count(*)), 6) AS ci95, count(*) AS n FROM ({_SCORES}) s")
def metric_ci95(m):
    return evaluate.mean_ci(_scores(m), "ndcg").select(F.round("mean", 6).alias("mean"), F.round("ci95", 6).alias("ci95"), "n")


@register(f"SELECT round(avg(map - mrr), 6) AS mean, round(1.96 * stddev_samp(map - mrr) / sqrt(count(*)), 6) AS ci95, count(*) AS n FROM ({_SCORES}) s")
def paired_lift(m):
    s = _scores(m)
    return evaluate.paired_lift(s.select("query_id", F.col("mrr").alias("x")), s.select("query_id", F.col("map").alias("x")), "x").select(F.round("mean", 6).alias("mean"), F.round("ci95", 6).alias("ci95"), "n")


@register("SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(CASE WHEN value <= 50 THEN 1.0 ELSE 0.0 END), 6) AS within FROM {events}")
def latency_profile(m):
    out = evaluate.latency(m.events, "value", 50.0)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@register("SELECT count(*) AS hit, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM {disk}), 6) AS precision, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM {stored}), 6) AS recall FROM {disk} d JOIN {stored} s ON d.path = s.path AND d.content_hash = s.content_hash")
def micro_precision_recall(m):
    return evaluate.micro(m.stored, m.disk, ["path", "content_hash"]).select("hit", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@register("SELECT name, path, count(*) AS n FROM {symbols} GROUP BY name, path HAVING count(*) > 1")
def key_collisions(m):
    return evaluate.key_collisions(m.symbols, ["name", "path"])


@register("SELECT count(CASE WHEN b = c THEN 1 END) AS hit, count(CASE WHEN b IS NOT NULL AND b <> c THEN 1 END) AS wrong, CAST(0 AS BIGINT) AS unknown_ok, count(CASE WHEN b IS NULL THEN 1 END) AS miss FROM (SELECT resolved_target AS b, CASE WHEN target LIKE '%7' THEN 'x' ELSE target END AS c FROM {calls}) z")
def resolution_rates(m):
    gold = m.calls.select("source_fqn", "target", F.when(F.col("target").endswith("7"), "x").otherwise(F.col("target")).alias("expected"))
    return evaluate.resolution_rates(m.calls, gold).select("hit", "wrong", "unknown_ok", "miss")
