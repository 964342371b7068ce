"""Small files wherever Spark's paths lie: one machine's disk, a shared folder or a store."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, store = _at(spark, path)
    return store.exists(where)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as UTF-8 text."""
    where, store = _at(spark, path)
    stream = store.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, content: str, path: str) -> None:
    """A small file that is there whole or not at all: written beside its place, then renamed, replacing what was there."""
    where, store = _at(spark, path)
    parent = where.getParent()
    store.mkdirs(parent)
    beside, _ = _at(spark, f"{parent.toString()}/.{where.getName()}.{uuid.uuid4().hex}")
    stream = store.create(beside, True)
    try:
        stream.write(bytearray(content.encode("utf-8")))
    finally:
        stream.close()
    if not store.rename(beside, where):  # some stores don't rename onto a file
        store.delete(where, False)
        if not store.rename(beside, where):
            raise OSError(f"could not write {path}")


def tree_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder."""
    where, store = _at(spark, path)
    return store.getContentSummary(where).getLength()
