"""Aggregation, distinct, dedupe and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bare_name(fqn: Column) -> Column:
    """What follows the last ``::`` and then the last dot."""
    return F.substring_index(F.substring_index(fqn, "::", -1), ".", -1)


def reference_density(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """How often each symbol's bare name is referred to."""
    counts = refs.groupBy(F.col("symbol_name").alias("bare")).agg(F.count("*").alias("n_refs"))
    return symbols.select("fqn", bare_name(F.col("fqn")).alias("bare")).join(counts, "bare", "left").select("fqn", F.coalesce("n_refs", F.lit(0)).alias("n_refs"))


def keep_last(rows: DataFrame, key: list[str], pos: str = "pos") -> DataFrame:
    """One row a key; the last wins and keeps its place."""
    last = F.max_by(F.struct(*rows.columns), F.col(pos)).alias("row")
    return rows.groupBy(*(F.col(k).alias(f"__{k}") for k in key)).agg(last).select("row.*")


def keep_first(rows: DataFrame, key: list[str], pos: str = "pos") -> DataFrame:
    first = F.min_by(F.struct(*rows.columns), F.col(pos)).alias("row")
    return rows.groupBy(*(F.col(k).alias(f"__{k}") for k in key)).agg(first).select("row.*")


def dedupe_texts(ranking: DataFrame) -> DataFrame:
    """Text twins: of equal (path, text) the most specific tier stays, at the group's best place and
    with its best score; empty texts are never twins. Columns path, text, tier, pos, score, item."""
    alone = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", F.col("pos"))
    kept = F.min_by(F.struct("item", "tier", "text"), F.struct("tier", "pos"))
    groups = ranking.groupBy("path", F.col("text").alias("__text"), alone.alias("__alone")).agg(kept.alias("k"), F.min("pos").alias("pos"), F.max("score").alias("score"))
    return groups.select("k.item", "path", "k.tier", "k.text", "pos", "score")


def dedupe_parts(ranking: DataFrame) -> DataFrame:
    """Parts of one scope (``_part_N``) in a file: the first stays."""
    base = F.regexp_replace("scope", r"_part_[0-9]+$", "")
    return keep_first(ranking.withColumn("base", base), ["path", "base"]).drop("base")


def merge_adjacent(rows: DataFrame, group: list[str], pos: str, same: list[str]) -> DataFrame:
    """Runs of consecutive rows with equal ``same`` columns become one: least start, greatest end,
    texts in order with a blank line between (gaps and islands)."""
    w = Window.partitionBy(*group).orderBy(pos)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    marked = rows.withColumn("__new", F.when(F.row_number().over(w) == 1, 1).otherwise(changed.cast("int")))
    runs = marked.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("text").alias("t"))))
    return runs.groupBy(*group, *same, "__run").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("text"), F.count("*").alias("n_merged")).drop("__run")


def insert_new(existing: DataFrame, incoming: DataFrame, key: list[str], pos: str) -> DataFrame:
    """Insert or ignore: what stands wins, and of the incoming the first of each key."""
    fresh = keep_first(incoming, key, pos).join(existing, key, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def insert_replace(existing: DataFrame, incoming: DataFrame, key: list[str], pos: str) -> DataFrame:
    """Insert or replace: the last of the incoming wins over what stands."""
    fresh = keep_last(incoming, key, pos)
    return existing.join(fresh, key, "left_anti").unionByName(fresh.select(*existing.columns))


def deletion_guard(diff: DataFrame, stored: DataFrame, confirmed: bool = False, least: int = 50, share: float = 0.2) -> DataFrame:
    """Drops the deletions of a diff if they are more than max(least, share of all files) and not confirmed."""
    if confirmed:
        return diff
    n_deleted = diff.agg(F.count_if(F.col("status") == "deleted").alias("n_deleted"))
    limit = stored.agg(F.greatest(F.lit(least), F.floor(F.count("*") * share)).alias("most"))
    held = n_deleted.join(F.broadcast(limit))  # one row each
    return diff.join(F.broadcast(held)).where((F.col("status") != "deleted") | (F.col("n_deleted") <= F.col("most"))).select(*diff.columns)


def most_common(rows: DataFrame, column: str, n: int) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)
