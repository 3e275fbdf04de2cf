"""Registered queries of maintenance, path resolution, scan policies and diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics, incremental, lookup, resolve
from ..functions import text as T
from ..sources.files import EXTENSIONS, ScanPolicy
from . import tools
from .catalog import _POINTS, register


@register("SELECT path, content_hash FROM {files} WHERE path = 'src/d6.py'")
def get_file_record(m):
    return lookup.file_record(m.files, "src/d6.py").select("path", "content_hash")


@register("SELECT count(*) > 0 AS has_files FROM {files}")
def has_files(m):
    return lookup.has_files(m.files)


_META = "SELECT concat('k', CAST(n_nationkey AS STRING)) AS key, n_name AS value FROM {nation}"
_FRESH = "SELECT concat('k', CAST(r_regionkey * 7 AS STRING)) AS key, r_name AS value FROM {region}"


@register("SELECT coalesce(max(value), 'none') AS value FROM (" + _META + ") x WHERE key = 'k3'")
def meta_get(m):
    return lookup.meta_get(m.sql(_META), "k3", "none")


@register("SELECT key, value FROM (" + _META + ") x WHERE key NOT IN (SELECT key FROM (" + _FRESH + ") y) UNION ALL " + _FRESH)
def meta_set(m):
    return lookup.meta_set(m.sql(_META), m.sql(_FRESH))


# every path by several spellings; the Python files stand in two folders, so that their names alone are ambiguous
_PATHS = "SELECT path FROM {symbols} UNION SELECT replace(path, 'src/', 'lib/') AS path FROM {symbols} WHERE path LIKE 'src/n%'"
_TAIL = "regexp_extract(path, '([^/]+)$', 1)"
_ASKED = f"""SELECT concat('./', path) AS file FROM (SELECT DISTINCT path FROM {{symbols}}) a UNION SELECT concat('/Repo/', path) FROM {{symbols}} UNION SELECT {_TAIL} FROM {{symbols}}
    UNION SELECT upper({_TAIL}) FROM {{symbols}} UNION SELECT concat('other/', {_TAIL}) FROM {{symbols}} UNION SELECT replace(path, '/', chr(92)) FROM {{symbols}} UNION SELECT ' ' UNION SELECT 'nowhere.py'"""


@register(f"""WITH p AS ({_PATHS}), q AS (SELECT file, regexp_replace(regexp_replace(replace(trim(file), chr(92), '/'), '^/Repo/', ''), '^[.]/', '') AS want FROM ({_ASKED}) a),
t AS (SELECT q.file, string_agg(p.path, ',' ORDER BY p.path) AS tails, count(*) AS n, min(p.path) AS one FROM q JOIN p ON lower(p.path) = lower(q.want) OR ends_with(lower(p.path), concat('/', lower(q.want))) WHERE q.want <> '' GROUP BY q.file),
e AS (SELECT q.file, string_agg(p.path, ',' ORDER BY p.path) AS near FROM q JOIN p ON lower(regexp_extract(p.path, '([^/]+)$', 1)) = lower(regexp_extract(q.want, '([^/]+)$', 1)) GROUP BY q.file),
o AS (SELECT q.file, q.want, CASE WHEN q.want = '' THEN 'empty' WHEN q.want IN (SELECT path FROM p) THEN 'exact' WHEN t.n = 1 THEN 'tail' WHEN t.n > 1 THEN 'ambiguous' ELSE 'missing' END AS outcome, t.tails, t.one, e.near FROM q LEFT JOIN t ON q.file = t.file LEFT JOIN e ON q.file = e.file)
SELECT file, outcome, CASE outcome WHEN 'exact' THEN want WHEN 'tail' THEN one END AS path, CASE WHEN outcome = 'ambiguous' THEN tails WHEN outcome = 'missing' AND want LIKE '%/%' THEN coalesce(near, '') ELSE '' END AS candidates FROM o""")
def resolve_paths(m):
    found = lookup.resolve_paths(m.sql(_PATHS), m.sql(_ASKED), root="/repo")
    return found.withColumn("candidates", F.array_join("candidates", ","))


_RUN = """SELECT coalesce(d.path, s.path) AS path, CASE WHEN d.path IS NULL THEN s.content_hash ELSE d.content_hash END AS content_hash,
    CASE WHEN s.path IS NULL THEN 'new' WHEN d.path IS NULL THEN 'held' WHEN d.content_hash IS DISTINCT FROM s.content_hash THEN 'modified' ELSE 'kept' END AS action
    FROM ({disk_}) d FULL JOIN {stored} s ON d.path = s.path
    WHERE d.path IS NOT NULL OR (SELECT count(*) FROM {stored} x WHERE x.path NOT IN (SELECT path FROM ({disk_}) z)) > greatest(50, floor(0.2 * (SELECT count(*) FROM {stored})))"""
#: A disk of which most files went, as after a folder was unmounted.
_ONE_LANGUAGE = "SELECT path, content_hash FROM {files} WHERE lang = 'en'"


@register(_RUN.replace("{disk_}", "SELECT path, content_hash FROM {disk}"))
def reindex(m):
    return incremental.apply_run(m.disk, m.stored)


@register(_RUN.replace("{disk_}", _ONE_LANGUAGE))
def reindex_guarded(m):
    return incremental.apply_run(m.sql(_ONE_LANGUAGE), m.stored)


_RANGES = "SELECT concat('src/n', CAST(s_nationkey AS STRING), '.py') AS path, CAST(s_suppkey % 800 + 1 AS INT) AS a, CAST(s_suppkey % 800 + 1 + s_suppkey % 60 AS INT) AS b FROM {supplier}"


@register(f"""WITH l AS (SELECT DISTINCT path, unnest(generate_series(a, b)) AS line FROM ({_RANGES}) r),
i AS (SELECT s.fqn, row_number() OVER (PARTITION BY l.path, l.line ORDER BY s.start_line DESC, s.fqn DESC) AS k FROM l JOIN {{symbols}} s ON s.path = l.path AND l.line BETWEEN s.start_line AND s.end_line)
SELECT fqn FROM i WHERE k = 1 UNION SELECT s.fqn FROM {{symbols}} s JOIN ({_POINTS}) q ON s.path = q.path AND s.start_line <= q.line AND q.line < s.end_line""")
def changed_symbols(m):
    ranges = m.sql(_RANGES).groupBy("path").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    points = m.sql(_POINTS).groupBy("path").agg(F.collect_set("line").alias("points"))
    hunks = ranges.join(points, "path", "full").select("path", F.coalesce("ranges", F.array().cast("array<struct<a:int,b:int>>")).alias("ranges"), F.coalesce("points", F.array().cast("array<int>")).alias("points"))
    return tools.changed_symbols(hunks, m.symbols)[0].select("fqn")


@register("SELECT src, dst, kind FROM {small} WHERE split_part(src, '::', 1) LIKE 'src/n1%' OR split_part(dst, '::', 1) LIKE 'src/n1%'")
def scoped_edges(m):
    return analytics.scoped(m.small, "src/n1")


@register("WITH e AS (SELECT src, dst FROM {small} WHERE kind <> 'OWNS' AND src <> dst AND trim(src) <> '' AND trim(dst) <> '') SELECT src AS node FROM e UNION SELECT dst FROM e")
def coupled_core(m):
    return analytics.coupled_core(analytics.aggregate_edges(m.small))


_FOUND = """SELECT concat(CASE doc_id % 7 WHEN 0 THEN 'src/' WHEN 1 THEN 'Node_Modules/x/' WHEN 2 THEN 'bin/' WHEN 3 THEN 'app/bin/Debug/' WHEN 4 THEN 'a/obj/' WHEN 5 THEN 'functions/' ELSE '' END,
    CASE doc_id % 11 WHEN 0 THEN '.env' WHEN 1 THEN '.env.example' WHEN 2 THEN 'id_rsa' WHEN 3 THEN 'my-Service_Account-1.json' WHEN 4 THEN 'a.CXX' WHEN 5 THEN 'b.razor' WHEN 6 THEN 'x.min.js'
    WHEN 7 THEN 'project-0123456789ab.json' WHEN 8 THEN 'tls.pem' WHEN 9 THEN 'keyboard.json' ELSE concat('d', CAST(doc_id AS STRING), '.py') END) AS path FROM {documents}"""


@register(f"""SELECT path FROM ({_FOUND}) f WHERE NOT regexp_matches(lower(path), '(^|/)(node_modules|obj|bin/debug)/|(^|/)([.]env|id_rsa|[^/]*service[-_]account[^/]*[.]json|[^/]*[.]min[.]js|[^/]*-{"[0-9a-f]" * 12}[.]json|[^/]*[.]pem)$')""")
def scan_policy(m):
    policy = ScanPolicy(extensions=(*EXTENSIONS, ".json", ".pem", ".env", ".example", "id_rsa"))
    found = m.sql(_FOUND)
    return found.where(policy.keeps(F.col("path")))


_IMPORTING = """SELECT path, concat('import a from "./m', CAST(doc_id % 9 AS STRING), '"', chr(10), 'const b = require("pkg', CAST(doc_id % 5 AS STRING), '")', chr(10), 'x = "no"') AS text FROM {files}"""


@register(f"SELECT path, s AS specifier, CASE WHEN s LIKE './%' THEN 'unknown' ELSE 'package' END AS class FROM (SELECT path, unnest(regexp_extract_all(text, '(?:from|import|require\\()\\s*[''\"]([^''\"]+)[''\"]', 1)) AS s FROM ({_IMPORTING}) f) g")
def import_classes(m):
    rows = m.sql(_IMPORTING).select("path", F.explode(T.specifiers(F.col("text"))).alias("specifier"))
    return rows.withColumn("class", resolve.import_class(F.lit(None).cast("string"), F.col("specifier")))
