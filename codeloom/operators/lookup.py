"""Point lookups, projections and filters. All filters reach the scan; results have a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EDGE_KINDS


def get_symbol(symbols: DataFrame, fqn: str) -> DataFrame:
    return symbols.where(F.col("fqn") == fqn)


def search_symbols(symbols: DataFrame, prefix: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """Names that start with ``prefix``, ignoring case; ``%`` and ``_`` in it are wildcards."""
    found = symbols.where(F.col("name").ilike(f"{prefix}%"))
    if kind is not None:
        found = found.where(F.col("kind") == kind)
    return found.orderBy("name", "fqn").limit(limit)


def file_symbols(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.where(F.col("path") == path).orderBy("start_line", F.desc("end_line"), "fqn")


def symbol_locations(symbols: DataFrame, locations: DataFrame, name: str, limit: int = 200) -> DataFrame:
    """Every place where a symbol of exactly this name is written down."""
    named = symbols.where(F.col("name") == name).select("fqn", "kind", "name")
    return named.join(locations, "fqn").orderBy("path", "start_line", "fqn").limit(limit)


def chunks_of(chunks: DataFrame, path: str, tier: int) -> DataFrame:
    return chunks.where((F.col("path") == path) & (F.col("tier") == tier)).orderBy("start_line", "scope")


def chunks_by_tag(chunks: DataFrame, tag: str) -> DataFrame:
    """Chunks one of whose tags contains ``tag``."""
    return chunks.where(F.exists("tags", lambda t: t.contains(tag)))


def metadata_of_files(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    return chunks.join(paths.select("path").distinct(), "path", "left_semi").select("path", "scope", "tier", "start_line", "end_line")


def cached(keys: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows of a content-addressed cache that are asked for."""
    return cache.join(keys.select(key).distinct(), key)


def find_paths(files: DataFrame, tail: str, limit: int = 20) -> DataFrame:
    """Paths that equal ``tail`` or end in ``/tail``, ignoring case."""
    low = F.lower("path")
    return files.where((low == tail.lower()) | low.endswith("/" + tail.lower())).select("path").orderBy("path").limit(limit)


def normal_kind(kind: Column) -> Column:
    """Upper-cased, with spaces and hyphens as underscores; None for a kind that the model doesn't store."""
    k = F.upper(F.regexp_replace(F.trim(kind), "[ -]+", "_"))
    return F.when(k.isin(*EDGE_KINDS), k)


def edges_to(edges: DataFrame, target: str) -> DataFrame:
    hit = (F.col("target") == target) | (F.col("resolved_target") == target)
    return edges.where(hit).select("source_fqn", normal_kind(F.col("kind")).alias("kind")).where("kind is not null").distinct().orderBy("source_fqn", "kind")


def edges_from(edges: DataFrame, source: str) -> DataFrame:
    found = edges.where(F.col("source_fqn") == source).select(F.coalesce("resolved_target", "target").alias("target"), normal_kind(F.col("kind")).alias("kind"))
    return found.where("kind is not null").distinct().orderBy("target", "kind")


def importers(edges: DataFrame, target: str, resolved: bool = False) -> DataFrame:
    column = "resolved_target" if resolved else "target"
    return edges.where((F.col("kind") == "IMPORTS") & (F.col(column) == target)).select("source_fqn").distinct().orderBy("source_fqn")


def owned_by(edges: DataFrame, owner: str) -> DataFrame:
    return edges.where((F.col("kind") == "OWNS") & (F.col("source_fqn") == owner)).select(F.coalesce("resolved_target", "target").alias("fqn"))


def owners_of(edges: DataFrame, fqn: str) -> DataFrame:
    return edges.where((F.col("kind") == "OWNS") & (F.coalesce("resolved_target", "target") == fqn)).select(F.col("source_fqn").alias("fqn"))


def references(refs: DataFrame, name: str | None = None, fqn: str | None = None, kind: str | None = None, limit: int = 200) -> DataFrame:
    found = refs
    for column, value in (("symbol_name", name), ("symbol_fqn", fqn), ("ref_kind", kind)):
        if value is not None:
            found = found.where(F.col(column) == value)
    return found.orderBy("path", "line", "context_fqn").limit(limit)


def unchanged(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Paths whose stored hash equals the one just seen."""
    return files.alias("f").join(seen.alias("s"), "path").where(F.col("f.content_hash").eqNullSafe(F.col("s.content_hash"))).select("path")


def matches_symbol(fqn: Column, query: str) -> Column:
    """Whether a name, a qualified tail or a whole FQN is meant; argument lists and arities don't count."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"\(.*\)$|/[0-9]+$", ""), "::", ".")
    want = plain(F.lit(query))
    have = plain(fqn)
    return (have == want) | have.endswith(F.concat(F.lit("."), want)) | have.endswith(F.concat(F.lit("/"), want))


def texts_by_file(chunks: DataFrame) -> DataFrame:
    """The texts of each file in order of their lines, joined by line feeds."""
    parts = F.array_sort(F.collect_list(F.struct("start_line", "scope", "text")))
    return chunks.groupBy("path").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def changed_since(files: DataFrame, cutoff: Column, limit: int = 50) -> DataFrame:
    """Files whose content changed after an instant, newest first."""
    return files.where(F.col("content_changed_at") > cutoff).orderBy(F.desc("content_changed_at"), "path").limit(limit)


def tier_consistency(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """For each tier the number of chunk rows and of vectors, and whether they agree."""
    a, b = chunks.groupBy("tier").agg(F.count("*").alias("rows")), vectors.groupBy("tier").agg(F.count("*").alias("vectors"))
    both = a.join(b, "tier", "full").select("tier", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("vectors", F.lit(0)).alias("vectors"))
    return both.withColumn("consistent", F.col("rows") == F.col("vectors"))


def stats(**tables: DataFrame) -> DataFrame:
    """The number of rows of each table, in one job."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def file_record(files: DataFrame, path: str) -> DataFrame:
    """The stored row of exactly this path."""
    return files.where(F.col("path") == path)


def has_files(files: DataFrame) -> DataFrame:
    """One row: whether any file is stored; reads one row at most."""
    return files.limit(1).agg((F.count("*") > 0).alias("has_files"))


def meta_get(meta: DataFrame, key: str, default: str | None = None) -> DataFrame:
    """One row: the value under a key, else the default."""
    return meta.where(F.col("key") == key).agg(F.coalesce(F.max("value"), F.lit(default).cast("string")).alias("value"))


def meta_set(meta: DataFrame, fresh: DataFrame) -> DataFrame:
    """The key-value table with the fresh rows in place of those under the same keys."""
    return meta.join(fresh.select("key").distinct(), "key", "left_anti").select("key", "value").unionByName(fresh.select("key", "value"))


def resolve_paths(files: DataFrame, asked: DataFrame, root: str = "") -> DataFrame:
    """What stored file each ``asked.file`` means: file, outcome, path, candidates.

    Either separator, a leading ``./`` and an absolute path below ``root`` are accepted. ``exact`` if that path
    is stored, ``tail`` if just one path ends in it (ignoring case), ``ambiguous`` with all that do, else
    ``missing`` with the paths of the same file name; ``empty`` where nothing was asked. Paths meet by their last part.
    """
    p = F.regexp_replace(F.trim(F.coalesce("file", F.lit(""))), r"\\", "/")
    if root:
        top = root.replace("\\", "/").rstrip("/") + "/"
        p = F.when(F.lower(p).startswith(top.lower()), F.substring(p, len(top) + 1, 1 << 30)).otherwise(p)
    want = F.regexp_replace(F.regexp_replace(p, r"^(\./)+", ""), "^/+|/+$", "")
    last = lambda c: F.lower(F.substring_index(c, "/", -1))
    wanted = asked.select("file").distinct().select("file", want.alias("want")).withColumn("last", last("want"))
    have = files.select("path").distinct().withColumn("last", last("path"))
    low, tail = F.lower("path"), F.lower("want")
    ends = (low == tail) | low.endswith(F.concat(F.lit("/"), tail))
    near = F.array_sort(F.collect_list("path"))
    met = wanted.join(have, "last", "left").groupBy("file", "want").agg(F.max(F.when(F.col("path") == F.col("want"), F.col("path"))).alias("exact"), F.array_sort(F.collect_list(F.when(ends, F.col("path")))).alias("tails"), near.alias("near"))
    outcome = F.when(F.col("want") == "", "empty").when(F.col("exact").isNotNull(), "exact").when(F.size("tails") == 1, "tail").when(F.size("tails") > 1, "ambiguous").otherwise("missing")
    path = F.when(outcome == "exact", F.col("exact")).when(outcome == "tail", F.col("tails")[0])
    others = F.when(outcome == "ambiguous", F.col("tails")).when((outcome == "missing") & F.col("want").contains("/"), F.col("near")).otherwise(F.array().cast("array<string>"))
    return met.select("file", outcome.alias("outcome"), path.alias("path"), others.alias("candidates"))
