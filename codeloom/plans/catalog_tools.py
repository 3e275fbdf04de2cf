"""Registered tool queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import tools
from .catalog import register

_HITS = "SELECT 0 AS query_id, doc_id AS item, path, text, CAST(1000 - doc_id % 500 AS DOUBLE) / 1000 AS score, doc_id AS pos, CASE WHEN doc_id % 4 = 0 THEN 'structural' ELSE 'semantic' END AS source, path AS scope FROM {files}"


@register()
def semantic_code_search(m):
    docs = m.documents.select(F.col("doc_id").alias("vec_id"), F.col("source").alias("path"), F.col("lang").alias("scope"), "text")
    chunks = m.embeddings.join(docs, "vec_id").withColumn("tier", F.col("vec_id") % 3)
    queries = m.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return tools.semantic_code_search(queries, chunks).select("query_id", "vec_id", "pos", "n_tokens")


@register("""SELECT path, bucket FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY pos) AS r FROM (SELECT *, CASE WHEN score >= 0.99 * top THEN 'origin' WHEN text LIKE '%idiot%' THEN 'caller'
    WHEN score / top - CASE WHEN regexp_matches(lower(text), 'get|fetch|query|where|onsnapshot|subscribe|use|read') AND NOT regexp_matches(lower(text), 'set|update|add|transaction|commit|write|delete|mutate') THEN 0.2 ELSE 0 END >= 0.72 THEN 'high' ELSE 'weak' END AS bucket FROM (SELECT *, max(score) OVER () AS top FROM (""" + _HITS + """) h) a) b) c WHERE bucket <> 'weak' OR r <= 4""")
def find_similar_code(m):
    return tools.find_similar_code(m.sql(_HITS), "zzqqw.set(9)", "idiot").select("path", "bucket")


@register()
def analyze_blast_radius(m):
    return tools.analyze_blast_radius(m.sql(_HITS), m.edges, "src/n18.py", "P9")


@register("""SELECT path, CASE WHEN text LIKE '%idiot%' THEN 'compliant' WHEN score >= 0.65 * (SELECT max(score) FROM (""" + _HITS + """) a) THEN 'possible' END AS bucket FROM (""" + _HITS + """) h WHERE text LIKE '%idiot%' OR score >= 0.65 * (SELECT max(score) FROM (""" + _HITS + """) b)""")
def detect_pattern_violations(m):
    return tools.detect_pattern_violations(m.sql(_HITS), m.files, "Zq_a Zq_b", ["idiot"]).select("path", "bucket")


@register(r"""SELECT path, bucket, 'UTILITY' AS layer FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY pos) AS r FROM (SELECT path, pos, CASE
    WHEN path LIKE '%.py' AND regexp_matches(text, '(?m)\b(class|def)\s+the\b|^\s*the\s*[:=]') OR path LIKE '%.ts' AND regexp_matches(text, '\b(interface|type|class|const|function)\s+the\b') OR path LIKE '%.cs' AND regexp_matches(text, '\b(class|interface|record|struct|enum)\s+the\b') THEN 'DEFINITIONS'
    WHEN path LIKE '%.py' AND regexp_matches(text, '\breturn\s+.*\bthe\(|\byield\s+.*\bthe\b') OR path LIKE '%.ts' AND regexp_matches(text, '\bnew\s+the\b|:\s*the\s*=\s*\x7B|\bas\s+the\b') OR path LIKE '%.cs' AND regexp_matches(text, '\bnew\s+the\b') THEN 'PRODUCERS'
    WHEN text LIKE '%the%' AND (text LIKE '%.filter(%' OR text LIKE '%.map(%' OR text LIKE '%.sort(%' OR text LIKE '%useMemo(%') THEN 'TRANSFORMERS'
    WHEN text LIKE '%the%' THEN 'CONSUMERS' END AS bucket FROM (""" + _HITS + """) h) b WHERE bucket IS NOT NULL) z WHERE r <= CASE bucket WHEN 'CONSUMERS' THEN 15 WHEN 'TRANSFORMERS' THEN 12 ELSE r END""")
def trace_data_flow(m):
    return tools.trace_data_flow(m.sql(_HITS), m.files, "the").select("path", "bucket", "layer")


@register("SELECT path, CASE WHEN source = 'structural' THEN 'caller' WHEN text LIKE '%the%' THEN 'consumer' ELSE 'semantic_match' END AS role, 'UTILITY' AS layer FROM (" + _HITS + ") h")
def investigate_architecture(m):
    return tools.investigate_architecture(m.sql(_HITS), "the")[0].select("path", "role", "layer")


@register("SELECT path, id, severity FROM (SELECT path, 'secret' AS id, 'high' AS severity FROM {files} WHERE regexp_matches(text, '(?i)token\\s*=') UNION ALL SELECT path, 'license', 'low' FROM {files} WHERE regexp_matches(text, '(?i)license|copyright')) z")
def risk_rules(m):
    rules = [{"id": "secret", "pattern": r"token\s*=", "severity": "high"}, {"id": "license", "pattern": "license|copyright", "severity": "low"}]
    return tools.apply_rules(m.files.withColumn("layer", F.lit("UTILITY")), rules).select("path", "id", "severity")


@register("SELECT path, 'direct' AS bucket FROM (SELECT concat('src/test_d', CAST(doc_id AS VARCHAR), '.py') AS path FROM {documents}) z WHERE path LIKE '%d12%'")
def find_test_coverage(m):
    files = m.documents.select(F.concat(F.lit("src/test_d"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"))
    return tools.find_test_coverage(files, m.sql(_HITS), "src/d12.py")


@register("SELECT CAST(count(CASE WHEN c >= 0.5 THEN 1 END) AS BIGINT) AS verified, CAST(count(CASE WHEN c < 0.5 THEN 1 END) AS BIGINT) AS candidates FROM (SELECT source_fqn, max(coalesce(confidence, CASE WHEN candidate THEN 0.25 ELSE 1.0 END)) AS c FROM {calls} WHERE target = 'P7' GROUP BY 1) z")
def find_dead_code(m):
    return tools.find_dead_code(m.calls, m.files, "fn7", "src/p7.ts", "P7").select("verified", "candidates")


@register("SELECT c.source_fqn AS fqn, s.path, substr(s.kind, 1, 400) AS source FROM (SELECT source_fqn FROM {calls} WHERE target = 'P4' GROUP BY source_fqn HAVING max(coalesce(confidence, CASE WHEN candidate THEN 0.25 ELSE 1.0 END)) < 0.5) c LEFT JOIN {symbols} s ON s.fqn = c.source_fqn")
def verify_candidate_edges(m):
    return tools.verify_candidate_edges(m.calls, m.symbols.withColumn("text", F.col("kind")), "P4").select("fqn", "path", "source")


_IO = "SELECT concat('R', CAST(o_custkey % 20 AS STRING)) AS source_fqn, concat('T', CAST(o_orderkey % 15 AS STRING)) AS target, CASE WHEN o_orderstatus = 'F' THEN 'WRITES' ELSE 'READS' END AS kind, CAST(NULL AS STRING) AS resolved_target, CAST(o_orderkey % 40 AS INT) AS line FROM {orders}"


@register(f"SELECT source_fqn, target AS t, kind, string_agg(DISTINCT CAST(lpad(CAST(line AS VARCHAR), 3, '0') AS VARCHAR), ',' ORDER BY lpad(CAST(line AS VARCHAR), 3, '0')) AS rungs FROM ({_IO}) e WHERE target = 'T3' GROUP BY 1, 2, 3")
def what_writes(m):
    io = m.sql(_IO)
    refs = io.select(F.col("source_fqn").alias("context_fqn"), F.col("target").alias("symbol_fqn"), F.when(F.col("kind") == "WRITES", "WRITE").otherwise("READ").alias("ref_kind"), "line")
    out = tools.what_writes(io, refs, "T3", readers=True)
    return out.select("source_fqn", "t", "kind", F.array_join(F.transform("rungs", lambda x: F.lpad(x.cast("string"), 3, "0")), ",").alias("rungs"))


@register("SELECT path, 'ambiguous' AS bucket FROM (" + _HITS + ") h WHERE text LIKE '%the%' AND NOT (regexp_matches(lower(text), 'commit|write|delete|mutate') AND NOT regexp_matches(lower(text), 'get|fetch|query|where|onsnapshot|subscribe|use|read')) AND text NOT LIKE '%''the''%' AND text NOT LIKE '%\"the\"%'")
def find_unabstracted_collection_reads(m):
    return tools.find_unabstracted_reads(m.sql(_HITS), m.files.select("path", "text"), "the", ["zzqq"])


@register("SELECT a.fqn, CAST(count(b.fqn) AS BIGINT) AS depth FROM {symbols} a LEFT JOIN {symbols} b ON a.path = b.path AND b.start_line <= a.start_line AND a.end_line <= b.end_line AND a.fqn <> b.fqn WHERE a.path = 'src/n3.py' GROUP BY a.fqn")
def get_file_outline(m):
    return tools.file_outline(m.symbols.withColumn("text", F.col("name")), "src/n3.py").select("fqn", "depth")


@register("SELECT fqn, path, 'same' AS state FROM {symbols} WHERE fqn = 'C12' OR name = 'C12'")
def get_symbol_source(m):
    symbols = m.symbols.withColumn("text", F.lit("body")).withColumn("start_line", F.lit(1))
    files = symbols.select("path").distinct().withColumn("text", F.lit("body"))
    return tools.symbol_source(symbols, files, "C12").select("fqn", "path", "state")


@register("SELECT o_orderkey AS path, o_orderdate AS content_changed_at FROM {orders} WHERE o_orderdate > TIMESTAMP '1997-06-01 00:00:00' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def index_status(m):
    files = m.orders.select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("content_changed_at"))
    return tools.index_status(files, m.chunks, m.embeddings.withColumn("tier", F.lit(1)), F.lit("1997-06-01").cast("timestamp"), 20)["changed"]


@register()
def map_module_communities(m):
    from ..operators import analytics

    pairs = analytics.aggregate_edges(m.sql("SELECT src, dst, kind FROM {small} WHERE kind = 'IMPORTS'"))
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return analytics.communities(analytics.undirected(pairs), nodes)
