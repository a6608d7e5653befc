"""Session helpers that the operators of this subpackage have in common."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that setting is missing a session of one process gets a temporary folder; on a
    cluster, where executors wouldn't see it, that is an error.
    """
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and cut the lineage; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, *folders: str) -> None:
    """Deletes intermediate folders that nothing reads any more."""
    for at in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def batches_of(spark: SparkSession, rows: int, size: str = "8m"):
    """Within it, jobs that start hand Arrow batches of at most so many rows and, but for one long row, bytes to Python."""
    new = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    old = {k: spark.conf.get(k) for k in new}
    try:
        for k, v in new.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def give_back() -> None:
    """Returns freed memory of this process to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(kernel: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The kernel, giving its freed memory back at its end: workers are kept for later stages."""

    @wraps(kernel)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def training_ids(docs: DataFrame, labels: DataFrame, column: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids of ``docs`` for training: (doc_id, label).

    Only rows whose crc32 of the id as text leaves a remainder by 5 take part.  Ids are
    taken in the order of their hash, so the sample is the same in every run and
    independent of layout; rows with a null or conflicting label are left out.  Labels of other
    documents don't count towards the limit.
    """
    crc = F.crc32(F.col("doc_id").cast("string"))
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & (crc % 5 != 0))
        .groupBy("doc_id")
        .agg(F.min(column).alias("label"), F.max(column).alias("other"))
        .where("label = other")
    )
    rows = rows.join(docs.select("doc_id"), "doc_id", "left_semi")
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("doc_id", F.col("label").cast("int").alias("label"))


def held_out(doc_id="doc_id"):
    """Column: is this row kept out of training?"""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0
