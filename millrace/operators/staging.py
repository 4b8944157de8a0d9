"""Tables and files written between passes, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The session's checkpoint folder. A folder of our own where there is none, and only in a session without other machines."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="millrace-stage-")
    return _OWN[app]


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        files, target = _files(spark, path)
        files.delete(target, True)


def folder(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, removed when the application ends."""
    path = f"{root(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def keep(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write df and reread it: lineage ends here, and a lost executor costs no earlier pass."""
    spark, path = df.sparkSession, folder(df.sparkSession, label)
    out = df.write.mode("overwrite").option("compression", "zstd")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_parts(spark: SparkSession, parts: str, target: str, header: str = "", footer: str = "", encoding: str = "UTF-8") -> None:
    """One file of all part files in their order, between a header and a footer: copied by the file system, no row goes through Python."""
    files, source = _files(spark, parts)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    store, path = _files(spark, target)
    names = sorted(s.getPath().getName() for s in files.listStatus(source) if s.getPath().getName().startswith("part-"))
    part = jvm.org.apache.hadoop.fs.Path(f"{target}.{uuid.uuid4().hex}")
    out = store.create(part, True)
    try:
        for text in (header, *names, footer):
            if text in names:
                given = files.open(jvm.org.apache.hadoop.fs.Path(source, text))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(given, out, conf, False)
                given.close()
            elif text:
                out.write(bytearray(text.encode(encoding)))
    finally:
        out.close()
    store.delete(path, True)
    store.rename(part, path)


def count_parts(spark: SparkSession, path: str) -> int:
    files, target = _files(spark, path)
    return sum(s.getPath().getName().startswith("part-") for s in files.listStatus(target)) if files.exists(target) else 0


def replace(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write df beside the path, then put it in its place."""
    files, target = _files(spark, path)
    beside = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(beside)
    files.delete(target, True)
    files.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(beside), target)
