"""The registered queries of the code-intelligence operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics, graph, joins, lookup, sets
from .binding import Model, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[key] = duck(sql)
        return f

    return add


# lookups

@register("SELECT fqn, path, kind, name, start_line, end_line FROM {symbols} WHERE fqn = 'C7'")
def get_symbol(m):
    return lookup.get_symbol(m.symbols, "C7")


@register("SELECT fqn, name, path FROM {symbols} WHERE name ILIKE 'k1%' AND kind = 'class' ORDER BY name, fqn LIMIT 20")
def search_symbols(m):
    return lookup.search_symbols(m.symbols, "k1", "class").select("fqn", "name", "path")


@register("SELECT fqn, kind, start_line, end_line FROM {symbols} WHERE path = 'src/n3.py'")
def get_file_symbols(m):
    return lookup.file_symbols(m.symbols, "src/n3.py").select("fqn", "kind", "start_line", "end_line")


@register("SELECT s.fqn, s.kind, s.name, s.path, s.start_line, s.end_line FROM {symbols} s WHERE s.name = 'K5' ORDER BY s.path, s.start_line, s.fqn LIMIT 200")
def find_symbol_locations(m):
    return lookup.symbol_locations(m.symbols, m.symbols.select("fqn", "path", "start_line", "end_line"), "K5")


@register("SELECT scope, start_line, end_line FROM {chunks} WHERE path = 'src/d6.py' AND tier = 1")
def get_chunks(m):
    return lookup.chunks_of(m.chunks, "src/d6.py", 1).select("scope", "start_line", "end_line")


@register("SELECT doc_id FROM {documents} WHERE lang LIKE '%c1%' OR source LIKE '%c1%'")
def search_chunks_by_tag(m):
    return lookup.chunks_by_tag(m.documents.select("doc_id", F.array("lang", "source").alias("tags")), "c1").select("doc_id")


@register("SELECT path, scope, CAST(tier AS BIGINT) AS tier FROM {chunks} WHERE path IN (SELECT path FROM {files} WHERE lang = 'fr')")
def chunk_metadata_for_files(m):
    return lookup.metadata_of_files(m.chunks, m.files.where("lang = 'fr'")).select("path", "scope", F.col("tier").cast("long").alias("tier"))


@register("SELECT content_hash, min(n_chars) AS n_chars FROM {files} WHERE content_hash IN (SELECT content_hash FROM {disk}) GROUP BY content_hash")
def get_cached_summaries(m):
    cache = m.files.groupBy("content_hash").agg(F.min("n_chars").alias("n_chars"))
    return lookup.cached(m.disk, cache, "content_hash")


@register("SELECT d.path FROM {disk} d JOIN {stored} s ON d.path = s.path AND d.content_hash = s.content_hash")
def file_is_unchanged(m):
    return lookup.unchanged(m.stored, m.disk)


@register("SELECT path FROM {files} WHERE lower(path) = 'd12.py' OR lower(path) LIKE '%/d12.py' ORDER BY path LIMIT 20")
def find_file_paths(m):
    return lookup.find_paths(m.files, "D12.py")


@register("SELECT DISTINCT source_fqn, kind FROM {edges} WHERE target = 'P9' OR resolved_target = 'P9'")
def get_edges_to(m):
    return lookup.edges_to(m.edges, "P9")


@register("SELECT DISTINCT coalesce(resolved_target, target) AS target, kind FROM {edges} WHERE source_fqn = 'S4'")
def get_edges_from(m):
    return lookup.edges_from(m.edges, "S4")


@register("SELECT DISTINCT source_fqn FROM {edges} WHERE kind = 'IMPORTS' AND resolved_target = 'src/n18.py'")
def get_importers(m):
    return lookup.importers(m.edges, "src/n18.py", resolved=True)


@register("SELECT coalesce(resolved_target, target) AS fqn FROM {edges} WHERE kind = 'OWNS' AND source_fqn = 'S2'")
def get_owned_by(m):
    return lookup.owned_by(m.edges, "S2")


@register("SELECT source_fqn AS fqn FROM {edges} WHERE kind = 'OWNS' AND coalesce(resolved_target, target) = 'P5'")
def get_owners(m):
    return lookup.owners_of(m.edges, "P5")


@register("SELECT path, symbol_name, symbol_fqn, line, ref_kind, context_fqn FROM {refs} WHERE symbol_name = 'K3' AND ref_kind = 'CALL' ORDER BY path, line, context_fqn LIMIT 200")
def get_references(m):
    return lookup.references(m.refs, name="K3", kind="CALL")


@register("SELECT fqn FROM {symbols} WHERE regexp_replace(fqn, '/[0-9]+$', '') = 'C11'")
def match_symbol(m):
    return m.symbols.where(lookup.matches_symbol(F.col("fqn"), "C11()")).select("fqn")


@register("SELECT source AS path, md5(string_agg(text, chr(10) ORDER BY doc_id)) AS text_md5 FROM {documents} GROUP BY source")
def gather_texts(m):
    rows = m.documents.select(F.col("source").alias("path"), F.col("doc_id").alias("start_line"), F.lit("").alias("scope"), "text")
    return lookup.texts_by_file(rows).select("path", F.md5("text").alias("text_md5"))


@register("SELECT o_orderkey, o_orderdate FROM {orders} WHERE o_orderdate > TIMESTAMP '1998-01-01 00:00:00' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def freshness_delta(m):
    rows = m.orders.select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("content_changed_at"))
    return lookup.changed_since(rows, F.lit("1998-01-01").cast("timestamp")).select(F.col("path").alias("o_orderkey"), F.col("content_changed_at").alias("o_orderdate"))


@register("""SELECT coalesce(a.tier, b.tier) AS tier, coalesce(n, 0) AS rows, coalesce(v, 0) AS vectors, coalesce(n, 0) = coalesce(v, 0) AS consistent
    FROM (SELECT doc_id % 3 + 1 AS tier, count(*) AS n FROM {documents} GROUP BY 1) a FULL JOIN (SELECT vec_id % 4 + 1 AS tier, count(*) AS v FROM {embeddings} GROUP BY 1) b ON a.tier = b.tier""")
def status_consistency(m):
    return lookup.tier_consistency(m.documents.select((F.col("doc_id") % 3 + 1).alias("tier")), m.embeddings.select((F.col("vec_id") % 4 + 1).alias("tier")))


@register("SELECT 'files' AS table_name, count(*) AS n FROM {files} UNION ALL SELECT 'symbols', count(*) FROM {symbols} UNION ALL SELECT 'edges', count(*) FROM {edges} UNION ALL SELECT 'refs', count(*) FROM {refs}")
def index_stats(m):
    return lookup.stats(files=m.files, symbols=m.symbols, edges=m.edges, refs=m.refs)


# joins

@register("""SELECT c.path, c.scope, f.content_hash FROM {chunks} c JOIN {files} f ON c.path = f.path""")
def chunks_with_files(m):
    return m.chunks.select("path", "scope").join(m.files.select("path", "content_hash"), "path")


_HERITAGE = """SELECT source_fqn, CASE WHEN n_near = 1 THEN near WHEN n_near = 0 AND n = 1 THEN only_one END AS target, kind FROM (
    SELECT e.source_fqn, e.target, e.kind, count(CASE WHEN t.path = s.path THEN 1 END) AS n_near, max(CASE WHEN t.path = s.path THEN t.fqn END) AS near, count(*) AS n, max(t.fqn) AS only_one
    FROM {edges} e LEFT JOIN {symbols} s ON e.source_fqn = s.fqn JOIN {symbols} t ON t.name = e.target AND t.kind = 'class'
    WHERE e.kind = 'EXTENDS' AND e.resolved_target IS NULL AND e.target NOT IN (SELECT fqn FROM {symbols}) GROUP BY e.source_fqn, e.target, e.kind) q
    WHERE CASE WHEN n_near = 1 THEN near WHEN n_near = 0 AND n = 1 THEN only_one END IS NOT NULL"""


@register(_HERITAGE)
def heritage_bind(m):
    return joins.bind_heritage(m.edges, m.symbols)


@register(f"SELECT DISTINCT * FROM (SELECT source_fqn, coalesce(resolved_target, target) AS target, kind FROM {{edges}} WHERE coalesce(resolved_target, target) IN (SELECT fqn FROM {{symbols}} UNION SELECT path FROM {{docs_files}}) UNION ALL {_HERITAGE}) z")
def get_graph_edges(m):
    return joins.graph_edges(m.edges, m.symbols, m.docs_files)


@register("SELECT s.fqn FROM {symbols} s WHERE NOT EXISTS (SELECT 1 FROM {refs} r WHERE r.symbol_fqn = s.fqn)")
def missing_locations(m):
    return joins.missing(m.symbols, m.refs.select(F.col("symbol_fqn").alias("fqn")), "fqn").select("fqn")


_DIFF = "SELECT coalesce(d.path, s.path) AS path, CASE WHEN s.path IS NULL THEN 'new' WHEN d.path IS NULL THEN 'deleted' WHEN d.content_hash <> s.content_hash THEN 'modified' END AS status FROM {disk} d FULL JOIN {stored} s ON d.path = s.path WHERE s.path IS NULL OR d.path IS NULL OR d.content_hash <> s.content_hash"


@register(_DIFF)
def three_way_diff(m):
    return joins.three_way_diff(m.disk, m.stored)


@register("SELECT doc_id AS vec_id, 'missing' AS status FROM {documents} WHERE doc_id NOT IN (SELECT vec_id FROM {embeddings}) UNION ALL SELECT vec_id, 'surplus' FROM {embeddings} WHERE vec_id NOT IN (SELECT doc_id FROM {documents})")
def reconcile_vectors(m):
    return joins.reconcile_vectors(m.files.select(F.col("doc_id").alias("vec_id"), "path"), m.embeddings).select("vec_id", "status")


_CALLS = "SELECT c.source_fqn, c.target, a.path AS source_path, b.path AS target_path FROM {calls} c JOIN {symbols} a ON c.source_fqn = a.fqn JOIN {symbols} b ON c.target = b.fqn"


@register(f"SELECT q.source_fqn, q.target, (i.source_fqn IS NOT NULL OR q.source_path = q.target_path) AS corroborated FROM ({_CALLS}) q LEFT JOIN (SELECT DISTINCT source_fqn, target FROM {{edges}} WHERE kind = 'IMPORTS') i ON i.source_fqn = q.source_path AND i.target = q.target_path")
def import_corroboration(m):
    imports = m.edges.where("kind = 'IMPORTS'").select(F.col("source_fqn").alias("source_path"), F.col("target").alias("target_path"))
    return joins.corroborate(m.sql(_CALLS), imports).select("source_fqn", "target", "corroborated")


@register("SELECT r.path, r.line, r.context_fqn, (SELECT min_by(s.fqn, concat(lpad(CAST(s.start_line AS VARCHAR), 9, '0'), s.fqn)) FROM {symbols} s WHERE s.path = r.path AND r.line BETWEEN s.start_line AND s.end_line) AS enclosing FROM {refs} r")
def enclosing_symbol(m):
    return joins.containing(m.refs.select("path", "line", "context_fqn"), m.symbols)


_POINTS = "SELECT concat('src/p', CAST(p_partkey % 50 AS STRING), '.ts') AS path, CAST(p_size * 11 AS INT) AS line FROM {part} WHERE p_size < 6"


@register(f"SELECT DISTINCT s.fqn FROM {{symbols}} s JOIN ({_POINTS}) q ON s.path = q.path AND s.start_line <= q.line AND q.line < s.end_line")
def changed_symbols_overlap(m):
    hunks = m.sql(_POINTS).groupBy("path").agg(F.collect_set("line").alias("points")).withColumn("ranges", F.array().cast("array<struct<a:int,b:int>>"))
    return joins.hunk_overlap(hunks, m.symbols).select("fqn")


@register("SELECT DISTINCT e.source_fqn AS importer, regexp_extract(coalesce(e.resolved_target, e.target), '([^/]+)[.]py$', 1) AS stem FROM {edges} e WHERE e.kind = 'IMPORTS'")
def importers_by_stem(m):
    target = F.coalesce("resolved_target", "target")
    return m.edges.where("kind = 'IMPORTS'").select(F.col("source_fqn").alias("importer"), T.module_stem(target).alias("stem")).distinct()


@register("SELECT DISTINCT source_fqn FROM {calls} WHERE target = 'P4' AND coalesce(confidence, CASE WHEN candidate THEN 0.25 ELSE 1.0 END) < 0.5")
def verdict_difference(m):
    callers = graph.neighbours(m.calls, "P4", "called_by").select(F.col("fqn").alias("source_fqn"), "confidence")
    return joins.missing(callers.select("source_fqn"), callers.where("confidence >= 0.5").select("source_fqn"), "source_fqn")


@register("SELECT content_hash AS text_hash, concat('s', content_hash) AS summary FROM {stored} UNION SELECT concat('new-', content_hash), concat('s', content_hash) FROM {stored}")
def summary_rekey(m):
    cache = m.stored.select(F.col("content_hash").alias("text_hash"), F.concat(F.lit("s"), "content_hash").alias("summary")).distinct()
    return joins.rekey(cache, m.stored.select(F.col("content_hash").alias("old_key"), F.concat(F.lit("new-"), "content_hash").alias("new_key")).distinct())


@register("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM {embeddings} a JOIN {embeddings} b ON b.vec_id = a.vec_id + 1 WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) <= 0.1")
def distant_call_pairs(m):
    calls = m.embeddings.select(F.col("vec_id").alias("source"), (F.col("vec_id") + 1).alias("target"))
    return joins.distant_calls(calls, m.embeddings.withColumnRenamed("vec_id", "node"), 0.1).withColumn("cosine", F.round("cosine", 6))


# aggregation and sets

@register("SELECT s.fqn, coalesce(n, 0) AS n_refs FROM {symbols} s LEFT JOIN (SELECT symbol_name, count(*) AS n FROM {refs} GROUP BY 1) r ON r.symbol_name = s.fqn")
def reference_density(m):
    return sets.reference_density(m.refs, m.symbols)


@register("SELECT src, dst, round(sum(CAST(CASE kind WHEN 'CALLS' THEN 1.0 WHEN 'OWNS' THEN 0.4 ELSE 0.6 END AS DOUBLE)), 6) AS weight, round(sum(CAST(CASE kind WHEN 'CALLS' THEN 1.0 WHEN 'OWNS' THEN 0.0 ELSE 0.6 END AS DOUBLE)), 6) AS coupling_weight, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM {small} WHERE src <> dst GROUP BY src, dst")
def edge_aggregation(m):
    pairs = analytics.aggregate_edges(m.small)
    return pairs.select("src", "dst", F.round("weight", 6).alias("weight"), F.round("coupling_weight", 6).alias("coupling_weight"), F.array_join("kinds", ",").alias("kinds"))


@register("SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(sum(CAST(CASE kind WHEN 'CALLS' THEN 1.0 WHEN 'OWNS' THEN 0.4 ELSE 0.6 END AS DOUBLE)), 6) AS w FROM {small} WHERE src <> dst GROUP BY 1, 2")
def reciprocal_sum(m):
    return analytics.undirected(analytics.aggregate_edges(m.small)).withColumn("w", F.round("w", 6))


@register("SELECT source, lang, max(doc_id) AS doc_id FROM {documents} GROUP BY source, lang")
def keep_last_dedupe(m):
    return sets.keep_last(m.documents.select("doc_id", "source", "lang"), ["source", "lang"], "doc_id")


@register("SELECT p.text AS body, min(doc_id) AS pos, max(n_chars % 17 + doc_id % 5) AS score FROM (SELECT md5(text) AS text, doc_id, n_chars FROM {documents}) p GROUP BY p.text")
def text_twin_dedupe(m):
    rows = m.documents.select(F.lit("f").alias("path"), F.md5("text").alias("text"), (F.col("doc_id") % 3).alias("tier"), F.col("doc_id").alias("pos"), (F.col("n_chars") % 17 + F.col("doc_id") % 5).alias("score"), F.col("doc_id").alias("item"))
    return sets.dedupe_texts(rows).select(F.col("text").alias("body"), "pos", "score")


@register("SELECT source AS path, doc_id % 10 AS base, min(doc_id) AS pos FROM {documents} GROUP BY 1, 2")
def part_dedupe(m):
    rows = m.documents.select(F.col("source").alias("path"), F.concat(F.lit("s"), (F.col("doc_id") % 10).cast("string"), F.lit("_part_"), F.col("doc_id").cast("string")).alias("scope"), F.col("doc_id").alias("pos"))
    return sets.dedupe_parts(rows).select("path", F.regexp_extract("scope", "^s([0-9]+)_", 1).cast("long").alias("base"), "pos")


@register("SELECT conv_id, role, min(turn) AS start_line, max(turn) AS end_line, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text_md5 FROM (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS new FROM {conversations}) a) b GROUP BY conv_id, role, run")
def merge_adjacent(m):
    rows = m.conversations.select("conv_id", "role", "turn", F.col("turn").alias("start_line"), F.col("turn").alias("end_line"), "text")
    return sets.merge_adjacent(rows, ["conv_id"], "turn", ["role"]).select("conv_id", "role", "start_line", "end_line", F.md5("text").alias("text_md5"))


@register("SELECT path, content_hash FROM {stored} UNION ALL SELECT path, content_hash FROM {disk} WHERE path NOT IN (SELECT path FROM {stored})")
def insert_or_ignore(m):
    return sets.insert_new(m.stored, m.disk.withColumn("pos", F.lit(0)), ["path"], "pos")


@register("SELECT path, content_hash FROM {disk} UNION ALL SELECT path, content_hash FROM {stored} WHERE path NOT IN (SELECT path FROM {disk})")
def insert_or_replace(m):
    return sets.insert_replace(m.stored, m.disk.withColumn("pos", F.lit(0)), ["path"], "pos")


@register(f"SELECT * FROM ({_DIFF}) q WHERE status <> 'deleted' OR (SELECT count(*) FROM ({_DIFF}) z WHERE status = 'deleted') <= greatest(50, floor((SELECT count(*) FROM {{stored}}) * 0.2))")
def bulk_deletion_guard(m):
    return sets.deletion_guard(joins.three_way_diff(m.disk, m.stored), m.stored)


@register("SELECT name, count(*) AS n FROM {symbols} GROUP BY name ORDER BY n DESC, name LIMIT 10")
def most_common(m):
    return sets.most_common(m.symbols, "name", 10)


# traversal

_ADJ = "SELECT source_fqn AS node, coalesce(resolved_target, target) AS next, 'calls' AS direction, candidate, coalesce(confidence, CASE WHEN candidate THEN 0.25 ELSE 1.0 END) AS confidence FROM {calls} UNION ALL SELECT coalesce(resolved_target, target), source_fqn, 'called_by', candidate, coalesce(confidence, CASE WHEN candidate THEN 0.25 ELSE 1.0 END) FROM {calls}"


@register(f"""SELECT fqn, direction, min(depth) AS depth, bool_and(candidate) AS candidate, max(confidence) AS confidence FROM (
    SELECT 'S3' AS fqn, 'root' AS direction, 0 AS depth, false AS candidate, CAST(1.0 AS DOUBLE) AS confidence
    UNION ALL SELECT next, direction, 1, candidate, confidence FROM ({_ADJ}) a1 WHERE node = 'S3' AND next <> 'S3'
    UNION ALL SELECT b.next, b.direction, 2, b.candidate, b.confidence FROM ({_ADJ}) a JOIN ({_ADJ}) b ON b.node = a.next WHERE a.node = 'S3' AND a.next <> 'S3' AND b.next <> 'S3' AND b.next <> a.next) q GROUP BY fqn, direction""")
def call_graph(m):
    seeds = m.symbols.where("fqn = 'S3'").select("fqn")
    return graph.call_graph(m.calls, seeds, 2).drop("root")


@register(f"SELECT next AS fqn, bool_and(candidate) AS candidate, max(confidence) AS confidence FROM ({_ADJ}) a WHERE node = 'P6' AND direction = 'called_by' GROUP BY next")
def callers(m):
    return graph.neighbours(m.calls, "P6", "called_by")


@register(f"SELECT n.fqn, n.confidence, s.kind AS symbol_kind, s.path FROM (SELECT next AS fqn, max(confidence) AS confidence FROM ({_ADJ}) a WHERE node = 'C10' AND direction = 'calls' GROUP BY next) n LEFT JOIN {{symbols}} s ON n.fqn = s.fqn")
def callees_decorated(m):
    return graph.decorate(graph.neighbours(m.calls, "C10", "calls"), m.symbols).select("fqn", "confidence", "symbol_kind", "path")


@register("SELECT source_fqn, coalesce(confidence, CASE WHEN candidate THEN 0.25 ELSE 1.0 END) AS confidence, coalesce(confidence, CASE WHEN candidate THEN 0.25 ELSE 1.0 END) >= 0.5 AS verified, target FROM {calls}")
def effective_confidence(m):
    c = graph.effective_confidence(F.col("candidate"), F.col("confidence"))
    return m.calls.select("source_fqn", "target", c.alias("confidence"), graph.verified(F.col("candidate"), F.col("confidence")).alias("verified")).select("source_fqn", "confidence", "verified", "target")


@register("SELECT source_fqn, string_agg(DISTINCT coalesce(resolved_target, target), ',' ORDER BY coalesce(resolved_target, target)) AS targets FROM {calls} GROUP BY source_fqn")
def adjacency_snapshot(m):
    return graph.fan_out(m.calls).select("source_fqn", F.array_join("targets", ",").alias("targets"))


@register()
def best_first_expansion(m):
    seeds = m.symbols.where("fqn IN ('S1', 'S2', 'P3')").select(F.lit(1).alias("query_id"), "fqn", (1.0 / (1 + F.length("fqn"))).alias("score"))
    return graph.expand(seeds, m.calls, hops=1)
