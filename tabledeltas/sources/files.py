"""Directory operations on whatever file system a path names."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class NotSharedError(RuntimeError):
    """Executors cannot see a folder they would have to work in."""


def _resolve(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _resolve(spark, path)
    return fs.exists(p)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system; a catalog would read a bare one as its own."""
    fs, p = _resolve(spark, path)
    return fs.makeQualified(p).toString()


def bare(spark: SparkSession, path: str) -> str:
    """The path without its file system."""
    fs, p = _resolve(spark, path)
    return fs.makeQualified(p).toUri().getPath()


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a directory; deleting one that is gone is not an error."""
    fs, p = _resolve(spark, path)
    return fs.delete(p, True)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of the files below ``path``."""
    fs, p = _resolve(spark, path)
    return fs.getContentSummary(p).getLength()


def child_directories(spark: SparkSession, path: str) -> list[str]:
    """Names of the directories directly below ``path``; none if it does not exist."""
    fs, p = _resolve(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())


def oldest_first(spark: SparkSession, pattern: str) -> list[str]:
    """Files that match a glob, by the time they were last written."""
    fs, p = _resolve(spark, pattern)
    found = [(s.getModificationTime(), s.getPath().toString()) for s in fs.globStatus(p) or []]
    return [path for _, path in sorted(found)]


def rows(spark: SparkSession, values: Sequence[tuple], columns: str) -> DataFrame:
    """A few rows as a frame of their own, from literals: no Python worker reads them."""
    names = [c.strip() for c in columns.split(",")]
    literals = [F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in values]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*literals)))


def append_rows(spark: SparkSession, values: Sequence[tuple], schema: T.StructType, path: str) -> None:
    """Append a few rows as one file, so that readers see all of them or none."""
    literals = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema.fields)])
        for row in values
    ]
    appended = spark.range(1, numPartitions=1).select(F.inline(F.array(*literals)))
    appended.write.mode("append").parquet(path)


def assert_shared(path: str, master: str) -> None:
    """Refuse a folder of one machine where executors may run on others."""
    if path.startswith("file:") and not master.startswith("local"):
        raise NotSharedError(
            f"{path} is a folder of the driver's machine; name one that all executors share in "
            "spark.checkpoint.dir"
        )


def scratch_directory(spark: SparkSession) -> str:
    """A new folder for the working tables of one call, dropped when Spark ends.

    It lies in the shared folder the session names in ``spark.checkpoint.dir``; where that is
    unset, below the session's warehouse directory, unless executors cannot share that.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_working"
        assert_shared(qualified(spark, shared), spark.sparkContext.master)
    path = f"{shared.rstrip('/')}/tabledeltas-{uuid.uuid4().hex}"
    fs, p = _resolve(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path
