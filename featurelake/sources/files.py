"""Small helpers over the Hadoop file system, so they work on any store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _located(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = _located(spark, path)
    return fs.exists(target)


def remove_path(spark: SparkSession, path: str) -> None:
    fs, target = _located(spark, path)
    fs.delete(target, True)


def child_names(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, change time in milliseconds) of what lies in a folder; nothing if there is no such folder."""
    fs, target = _located(spark, path)
    if not fs.exists(target):
        return []
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(target)]


def matching_paths(spark: SparkSession, pattern: str) -> list[str]:
    fs, target = _located(spark, pattern)
    return [s.getPath().toString() for s in fs.globStatus(target) or []]


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _located(spark, path)
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole content, or find that another writer has; never both.

    The content is written under another name first and then renamed without overwriting, which HDFS does as one step. On a
    local disk a hard link does. A store without such a rename needs one behind its Hadoop file system.
    """
    jvm = spark.sparkContext._jvm
    fs, target = _located(spark, path)
    fs.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_draft-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if fs.getUri().getScheme() == "file":
            paths = [jvm.java.nio.file.Path.of(jvm.java.net.URI("file://" + p.toUri().getPath().replace(" ", "%20"))) for p in (target, draft)]
            jvm.java.nio.file.Files.createLink(*paths)
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
            options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            context.rename(draft, target, options)
        return True
    except Exception as error:  # noqa: BLE001  a Java exception, told apart by its class
        cause = getattr(error, "java_exception", None)
        if cause is None or "FileAlreadyExists" not in cause.getClass().getName():
            raise
        return False
    finally:
        fs.delete(draft, False)


def read_or_empty(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """Table at a path; one that was never written is empty."""
    if path_exists(spark, path):
        return spark.read.schema(schema).format(fmt).load(path)
    return spark.createDataFrame([], schema)
