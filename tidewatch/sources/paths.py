"""Path tests through Hadoop's file system API, so that any URI Spark reads works (local
paths, file://, hdfs://, object stores)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def has_children(spark: SparkSession, path: str, prefix: str) -> bool:
    """Whether the folder holds an entry whose name starts with ``prefix``."""
    fs, p = _at(spark, path)
    return fs.exists(p) and any(s.getPath().getName().startswith(prefix) for s in fs.listStatus(p))
