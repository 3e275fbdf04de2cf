"""Incremental maintenance: diffs applied to snapshots, stamps, reuse, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import reconcile_vectors, three_way_diff
from .sets import deletion_guard


def upsert(table: DataFrame, fresh: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    """Replaces all rows of the keys in ``fresh`` or ``gone``."""
    touched = fresh.select(key).unionByName(gone.select(key)).distinct()
    return table.join(touched, key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def delete_shared(symbols: DataFrame, locations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deletes files: a symbol goes only when no other file holds it."""
    left = locations.join(gone.select("path"), "path", "left_anti")
    return symbols.join(left.select("fqn").distinct(), "fqn", "left_semi"), left


def content_stamps(diff: DataFrame, stored: DataFrame, git: DataFrame, now) -> DataFrame:
    """content_changed_at of each file: new and dirty now, new and tracked the commit's time, modified now, else as stored.
    ``git`` has path, committed_at and dirty."""
    rows = stored.select("path", "content_changed_at").join(diff, "path", "full").join(git, "path", "left").where(F.coalesce("status", F.lit("")) != "deleted")
    new = F.when(F.coalesce("dirty", F.lit(False)), now).otherwise(F.col("committed_at"))
    return rows.select("path", F.when(F.col("status") == "new", new).when(F.col("status") == "modified", now).otherwise(F.col("content_changed_at")).alias("content_changed_at"))


def reuse_vectors(wanted: DataFrame, old: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors that stay: same id and text hash; rows to embed). ``wanted`` and ``old`` have vec_id and text_hash."""
    same = wanted.join(old, ["vec_id", "text_hash"], "left_semi")
    return vectors.join(same.select("vec_id"), "vec_id", "left_semi"), wanted.join(same.select("vec_id"), "vec_id", "left_anti")


def purge_stale(vectors: DataFrame, rows: DataFrame) -> DataFrame:
    return vectors.join(rows.select("vec_id").distinct(), "vec_id", "left_semi")


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str = "text_hash") -> DataFrame:
    """Different texts to summarise, longest first."""
    new = wanted.join(cache, key, "left_anti").groupBy(key).agg(F.min("text").alias("text"))
    return new.orderBy(F.desc(F.length("text")), key)


def plan_run(disk: DataFrame, stored: DataFrame, expected: DataFrame, vectors: DataFrame, confirmed: bool = False) -> dict[str, DataFrame]:
    """What an incremental run has to do: the guarded diff, and vectors to heal or drop."""
    diff = deletion_guard(three_way_diff(disk, stored), stored, confirmed)
    return {"diff": diff, "vectors": reconcile_vectors(expected, vectors)}


def apply_run(disk: DataFrame, stored: DataFrame, confirmed: bool = False) -> DataFrame:
    """The stored table after a run: path, content_hash, action. New and modified files take the disk's hash, files
    that went leave the table unless the deletion guard holds them back (``held``), the others are ``kept``."""
    diff = deletion_guard(three_way_diff(disk, stored), stored, confirmed)
    now, before = disk.select("path", F.col("content_hash").alias("now")), stored.select("path", F.col("content_hash").alias("before"), F.lit(True).alias("in_store"))
    rows = before.join(now.withColumn("on_disk", F.lit(True)), "path", "full").join(diff, "path", "left").where("status IS NULL OR status <> 'deleted'")
    held = F.col("on_disk").isNull()
    action = F.when(held, "held").otherwise(F.coalesce("status", F.lit("kept")))
    return rows.select("path", F.when(held, F.col("before")).otherwise(F.col("now")).alias("content_hash"), action.alias("action"))


def reindex(snapshots, disk: DataFrame, build, confirmed: bool = False) -> str:
    """One run over a snapshot folder: diff, guard, rebuild of what changed, commit of the whole as a new version.

    ``disk`` has path, content_hash and what ``build`` needs; ``build`` makes rows (with path) of changed files.
    Whatever fails before the commit leaves the version before it; a run without changes publishes nothing.
    """
    spark, at = disk.sparkSession, snapshots.current()
    stored = spark.read.parquet(f"{at}/files") if at else spark.createDataFrame([], "path string, content_hash string")
    state = apply_run(disk, stored, confirmed)
    changed = disk.join(state.where("action IN ('new', 'modified')").select("path"), "path", "left_semi")
    gone = stored.join(state, "path", "left_anti")
    if at and changed.isEmpty() and gone.isEmpty():
        return at
    rows = build(changed)
    if at:
        rows = upsert(spark.read.parquet(f"{at}/rows"), rows, changed.select("path").unionByName(gone.select("path")))
    return snapshots.publish({"files": state.select("path", "content_hash"), "rows": rows})


def migrate(table: DataFrame, schema: str) -> DataFrame:
    """Additive, idempotent: columns that are new are null, the others stay."""
    from pyspark.sql.types import _parse_datatype_string

    have = set(table.columns)
    fields = _parse_datatype_string(schema).fields
    return table.select(*table.columns, *(F.lit(None).cast(f.dataType).alias(f.name) for f in fields if f.name not in have))


def token_batches(sizes: list[int], budget: int, most: int = 48) -> list[list[int]]:
    """Adaptive batching's plan: longest first, batches of like length whose padded size keeps to a token budget."""
    out: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if out and len(out[-1]) < most and (len(out[-1]) + 1) * sizes[out[-1][0]] <= budget:
            out[-1].append(i)
        else:
            out.append([i])
    return out
