"""Small helpers the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch. Texts can be long, so a batch is kept far below Spark's default of 10,000 rows; a
#: longer text is a batch by itself.
ROWS_PER_BATCH, BYTES_PER_BATCH = 512, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of each Arrow batch that Python workers get. It holds for the session from then on, as the
    frames that operators return run later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def tidy(spark: SparkSession) -> None:
    """For operators of many jobs: shuffle files are deleted when a job ends, as steps hand on written tables, and the
    driver keeps short plan texts."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.maxPlanStringLength", "20000")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores after it as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a session in one process (master local) gets a temporary folder; any other is refused, as a
    folder of one machine would lose rows.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written below the shared folder and read again: it survives lost executors and is computed once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Deletes the files of written frames that nothing is going to read any more, so that an operator of many steps takes
    no more of the shared folder than its current ones."""
    for frame in frames:
        spark = frame.sparkSession
        for folder in {file.rpartition("/")[0] for file in frame.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def give_back() -> None:
    """Hands what a finished task has freed back to the system. Python workers outlive tasks and stages; else the most
    that each of them ever held would add up on an executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows."""
    return (b for b in frames if b.num_rows)
