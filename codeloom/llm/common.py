"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java form of the ASCII white space that separates words, [\x20\x09-\x0D].
WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset on a
    single machine (tests) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='codeloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files behind a stashed frame that nothing reads any more; others stay."""
    spark = df.sparkSession
    bare = lambda path: re.sub(r"^[a-z][a-z0-9+.-]*:/*", "/", path)  # noqa: E731  file:/x and file:///x are one
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if bare(path).startswith(bare(shared_dir(spark)) + "/"):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stash_alone(df: DataFrame, name: str) -> DataFrame:
    """``stash``, after which Spark deletes the plan's shuffle files at once; else they stay until the driver collects garbage."""
    conf, setting = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(setting)
    conf.set(setting, "true")
    try:
        return stash(df, name)
    finally:
        conf.set(setting, before)


def give_back() -> None:
    """Return to the system what this process has freed: Python workers outlive their tasks, and later stages use them again."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str, setup: Callable[[], Callable] | None = None) -> DataFrame:
    """``mapInArrow`` of a function from one record batch to a dict of columns.

    ``setup`` (instead of ``fn``) runs once in each task and gives that function.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = setup() if setup else fn
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(f(batch), schema=arrow)
        give_back()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def fold(key: str | Column, n: int) -> Column:
    """crc32 of a key as text, modulo ``n``; a null key counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def words(text: Column) -> Column:
    """Array of the maximal runs of bytes outside ASCII white space; null is empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")
