"""Change ingestion: debounced file events and snapshot upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import upsert
from ..sources.files import Snapshots


def debounce(events: DataFrame, key: str, gap: str = "3 seconds", time: str = "ts", late: str | None = "1 minute") -> DataFrame:
    """One row a burst: events of a key less than ``gap`` apart are one (session window). Works on batch and
    streaming frames; a stream gets a watermark of ``late``."""
    if events.isStreaming and late:
        events = events.withWatermark(time, late)
    out = events.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n_events"))
    return out.select(key, F.col("w.start").alias("first_at"), F.col("w.end").alias("quiet_at"), "n_events")


def watch(spark: SparkSession, folder: str, schema: str, apply: Callable[[DataFrame, int], None], checkpoint: str, trigger: str = "3 seconds", once: bool = False):
    """A file stream whose micro-batches go to ``apply``; the trigger is the debounce, the checkpoint the single writer's lock."""
    writer = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=trigger)).start()


def upsert_batches(snapshots: Snapshots, table: str, key: str = "path", deleted: str = "deleted") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` body: rows replace those of their key in the newest snapshot; rows marked deleted take them away.
    The batch number is kept, so a batch that comes again after a crash changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = snapshots.current()
        meta = {r.key: r.value for r in spark.read.parquet(f"{at}/meta").collect()} if at else {}
        if int(meta.get("batch", -1)) >= number:
            return
        rows = batch.drop(deleted)
        gone = batch.where(F.col(deleted)).select(key)
        fresh = batch.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted).dropDuplicates([key])
        old = spark.read.parquet(f"{at}/{table}") if at else rows.limit(0)
        snapshots.publish({table: upsert(old, fresh, gone, key)}, {"batch": number})

    return run


def poll_ref(repo: str, indexed: str | None, ref: str = "HEAD") -> str | None:
    """The commit that a ref names, if it isn't the one indexed."""
    import subprocess

    out = subprocess.run(["git", "-C", repo, "rev-parse", ref], capture_output=True, text=True)
    now = out.stdout.strip() if out.returncode == 0 else None
    return now if now and now != indexed else None
