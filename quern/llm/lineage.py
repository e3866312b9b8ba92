"""Cutting lineage in storage that all executors share, bounded Arrow batches, and column names of one's own."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch of rows on their way to Python, where the session leaves the bound at Spark's default.
BATCH_BYTES = 2 << 20
#: Stored tables in local folders get no checksum files, and no table a success marker: without Hadoop's native library each file made costs a `chmod` process.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
#: Rows of a file, in tables whose number of rows is about known: without Hadoop's native library each file, and each task that writes one, costs a process.
FILE_ROWS = 1 << 14
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, on one machine, a new local folder, set for the session.

    On a cluster a local folder would be another one on each machine, so the setting is required there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH_BYTES, unless it has a bound of its own.

    A batch lies outside the heap, once in the executor and once in Python, and each may
    hold twice its bytes while it grows; by Spark's default of 64 MiB, batches of long
    texts take hundreds of megabytes a core. A text above the bound is a batch alone.
    """
    if spark.conf.get(_BATCH) in {f"{_BATCH_DEFAULT}b", str(_BATCH_DEFAULT)}:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def in_few(df: DataFrame, rows: int) -> DataFrame:
    """The same rows in no more partitions than one for each FILE_ROWS of `rows`, about how many there are.

    The partitions put together are computed one after the other, so a task holds no more at once.
    """
    return df.coalesce(max(1, -(-rows // FILE_ROWS)))


def stored(df: DataFrame, instead_of: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """The frame written to the shared folder and read again: its lineage ends there, and a lost executor loses none of it.

    The files are removed when the application ends, or with a later table stored
    `instead_of` this one; Parquet keeps column pruning and compression, which RDD
    checkpoints lack. Where it is known about how many `rows` there are, they are written
    in few files; all of them are, whatever their number.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    (df if rows is None else in_few(df, rows)).write.options(**PLAIN).parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_in = where
    if instead_of is not None and getattr(instead_of, "stored_in", None):
        files.delete(instead_of.stored_in, True)
    return out


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores as make it differ from all that are taken, letter case aside."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def refuse_clash(doc_id: str, outputs: Iterable[str]) -> None:
    """An id column may not have the name of another column of the result."""
    if doc_id.lower() in {c.lower() for c in outputs}:
        raise ValueError(f"the id column is named {doc_id!r}, as another column of the result is; rename it first")
