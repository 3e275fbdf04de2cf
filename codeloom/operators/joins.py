"""Joins between relations of the code model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def target_of(edges: DataFrame) -> Column:
    return F.coalesce(edges["resolved_target"], edges["target"])


def valid_edges(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Edges whose target is a known symbol or file."""
    known = symbols.select(F.col("fqn").alias("node")).unionByName(files.select(F.col("path").alias("node"))).distinct()
    rows = edges.withColumn("node", F.coalesce("resolved_target", "target"))
    return rows.join(known, "node", "left_semi").select("source_fqn", F.col("node").alias("target"), "kind")


def bind_heritage(edges: DataFrame, symbols: DataFrame, kinds: tuple[str, ...] = ("class", "interface", "struct", "record", "partial_class")) -> DataFrame:
    """Binds EXTENDS and IMPLEMENTS targets that are bare names: to the only type of that name in the
    source's file, else to the only one anywhere; ambiguous ones stay out."""
    loose = edges.where(F.col("kind").isin("EXTENDS", "IMPLEMENTS") & F.col("resolved_target").isNull())
    loose = loose.join(symbols.select(F.col("fqn").alias("target")), "target", "left_anti")
    home = symbols.select(F.col("fqn").alias("source_fqn"), F.col("path").alias("source_path"))
    types = symbols.where(F.col("kind").isin(*kinds)).select(F.col("name").alias("target"), F.col("fqn").alias("type_fqn"), F.col("path").alias("type_path"))
    # types are counted a name, and a name and file, before edges meet them: common names would give edges x types rows
    by_file = types.groupBy("target", F.col("type_path").alias("source_path")).agg(F.count("*").alias("n_near"), F.max("type_fqn").alias("near"))
    by_name = types.groupBy("target").agg(F.count("*").alias("n"), F.max("type_fqn").alias("only"))
    met = loose.join(home, "source_fqn", "left").join(by_name, "target").join(by_file, ["target", "source_path"], "left")
    told = met.groupBy("source_fqn", "target", "kind").agg(F.sum(F.coalesce("n_near", F.lit(0))).alias("n_near"), F.max("near").alias("near"), F.sum("n").alias("n"), F.max("only").alias("only"))
    bound = F.when(F.col("n_near") == 1, F.col("near")).when((F.col("n_near") == 0) & (F.col("n") == 1), F.col("only"))
    return told.select("source_fqn", bound.alias("target"), "kind").where("target is not null")


def graph_edges(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """All edges of the whole graph: those with a known target and the heritage that can be bound."""
    return valid_edges(edges, symbols, files).unionByName(bind_heritage(edges, symbols)).distinct()


def missing(left: DataFrame, right: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of ``left`` without a partner: missing locations, orphans, cache misses, stale rows."""
    return left.join(right, key, "left_anti")


def three_way_diff(disk: DataFrame, stored: DataFrame) -> DataFrame:
    """Columns path and status: new, modified or deleted; hashes compare null-safe."""
    d, s = disk.select("path", F.col("content_hash").alias("now")), stored.select("path", F.col("content_hash").alias("before"))
    both = d.withColumn("on_disk", F.lit(True)).join(s.withColumn("in_store", F.lit(True)), "path", "full")
    status = F.when(F.col("in_store").isNull(), "new").when(F.col("on_disk").isNull(), "deleted").when(~F.col("now").eqNullSafe(F.col("before")), "modified")
    return both.select("path", status.alias("status")).where("status is not null")


def reconcile_vectors(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Ids that rows ask for and vectors lack (missing), and the reverse (surplus)."""
    need, have = expected.select("vec_id", "path").distinct(), actual.select("vec_id").distinct()
    lacking = need.join(have, "vec_id", "left_anti").select("vec_id", "path", F.lit("missing").alias("status"))
    extra = have.join(need.select("vec_id"), "vec_id", "left_anti").select("vec_id", F.lit(None).cast("string").alias("path"), F.lit("surplus").alias("status"))
    return lacking.unionByName(extra)


def corroborate(calls: DataFrame, imports: DataFrame) -> DataFrame:
    """Whether a call's caller file imports the callee's file or is that file."""
    seen = imports.select(F.col("source_path"), F.col("target_path")).distinct().withColumn("imported", F.lit(True))
    both = calls.join(seen, ["source_path", "target_path"], "left")
    return both.withColumn("corroborated", F.col("imported").isNotNull() | (F.col("source_path") == F.col("target_path"))).drop("imported")


def containing(points: DataFrame, intervals: DataFrame, key: str = "path", point: str = "line", start: str = "start_line", stop: str = "end_line", name: str = "fqn", innermost: bool = False, width: int = 64) -> DataFrame:
    """Range join: for each point the first interval around it (or the innermost, by start).

    Of equal intervals only the name that would win takes part, and each place (key and point) is looked up once, however
    many points lie there. Intervals are laid on a grid of ``width`` and met by an equi-join on key and cell, so neither
    a cross join nor a whole key in one task is needed; an interval longer than a cell stands in several.
    """
    named = F.struct(F.col(name).alias("name"))
    spans = intervals.groupBy(F.col(key).alias("__key"), F.col(start).alias("__start"), F.col(stop).alias("__stop")).agg((F.max(named) if innermost else F.min(named))["name"].alias("__name"))
    cells = spans.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__start") / width), F.floor(F.col("__stop") / width))))
    at = points.select(F.col(key).alias("__at"), F.col(point).alias("__point")).distinct().withColumn("__cell", F.floor(F.col("__point") / width))
    inside = (at["__at"] == cells["__key"]) & (at["__cell"] == cells["__cell"]) & at["__point"].between(cells["__start"], cells["__stop"])
    best = F.max_by("__name", F.struct("__start", "__name")) if innermost else F.min_by("__name", F.struct("__start", "__name"))
    found = at.join(cells, inside).groupBy("__at", "__point").agg(best.alias("enclosing"))
    return points.join(found, (points[key] == found["__at"]) & (points[point] == found["__point"]), "left").drop("__at", "__point")


def hunk_overlap(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols that a diff touches: a changed range meets their lines outside nested symbols, or a
    deletion point p lies with start <= p < end. ``hunks`` has path, ranges (array of struct a, b) and points.

    The innermost symbol changes only where one starts or has ended, so of a range only its first line and
    such lines within it are looked up, however long it is.
    """
    own = symbols.select("fqn", "path", "start_line", "end_line")
    ranges = hunks.select("path", F.explode("ranges").alias("r")).select("path", "r.a", "r.b").distinct()
    bounds = own.select("path", F.explode(F.array("start_line", F.col("end_line") + 1)).alias("line")).distinct()
    turns = containing(bounds, ranges, start="a", stop="b", name="a").where("enclosing is not null").select("path", "line")
    lines = ranges.select("path", F.col("a").alias("line")).unionByName(turns).distinct()
    owner = containing(lines, own, innermost=True).where("enclosing is not null").select(F.col("enclosing").alias("fqn"))
    points = hunks.select("path", F.explode("points").alias("p"))
    cut = points.join(own, "path").where((F.col("start_line") <= F.col("p")) & (F.col("p") < F.col("end_line"))).select("fqn")
    return owner.unionByName(cut).distinct().join(own, "fqn")


def rekey(cache: DataFrame, mapping: DataFrame) -> DataFrame:
    """Copies cache rows to new keys; rows that already stand under the new key win."""
    moved = cache.join(mapping, cache["text_hash"] == mapping["old_key"]).select(F.col("new_key").alias("text_hash"), "summary")
    first = moved.groupBy("text_hash").agg(F.min("summary").alias("summary"))
    return cache.unionByName(first.join(cache, "text_hash", "left_anti"))


def distant_calls(calls: DataFrame, vectors: DataFrame, most: float) -> DataFrame:
    """Resolved calls, each unordered pair once, whose ends' texts are no more alike than ``most``."""
    pair = F.array_sort(F.array("source", "target"))
    pairs = calls.select(pair[0].alias("a"), pair[1].alias("b")).where("a <> b").distinct()
    va, vb = (vectors.select(F.col("node").alias(k), F.col("embedding").alias(f"v{k}")) for k in ("a", "b"))
    both = pairs.join(va, "a").join(vb, "b")
    return both.withColumn("cosine", cosine(F.col("va"), F.col("vb"))).where(F.col("cosine") <= most).select("a", "b", "cosine")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key (replace on write); the order must be total."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")
