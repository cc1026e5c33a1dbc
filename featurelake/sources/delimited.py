"""Delimited entity tables from any Hadoop file system."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

DELIMITED_SUFFIXES = (".csv",)
OBJECT_STORE_SCHEMES = ("s3", "s3a")


def resolve_source(uri: str) -> str:
    """Validated path for the reader; an object-store URI must name a bucket and a key."""
    parsed = urlparse(uri)
    if parsed.scheme in OBJECT_STORE_SCHEMES:
        if not parsed.netloc or not parsed.path.strip("/"):
            raise ValueError(f"object URI needs a bucket and a key: {uri!r}")
        return f"s3a://{parsed.netloc}{parsed.path}"
    return uri


def read_delimited(spark: SparkSession, path: str, schema: StructType | str | None = None,
                   sep: str = ";") -> DataFrame:
    """Semicolon table with a header.

    Give a schema in production: inference reads the files twice.
    """
    source = resolve_source(path)
    if not source.rstrip("/").lower().endswith(DELIMITED_SUFFIXES):
        raise ValueError(f"unsupported file format: {path!r}")
    reader = spark.read.option("sep", sep).option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(source)
