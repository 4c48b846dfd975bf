"""Small files that appear whole or not at all: ledgers of batches and manifests of versions, in any file system of Spark."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _opened(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def put(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file under another name and rename it; false, and nothing changed, if it is there already. One writer at a time."""
    files, where = _opened(spark, path)
    if files.exists(where):
        return False
    files.mkdirs(where.getParent())
    draft = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}.{uuid.uuid4().hex}")
    out = files.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return bool(files.rename(draft, where))


def there(spark: SparkSession, path: str) -> bool:
    files, where = _opened(spark, path)
    return bool(files.exists(where))


def get(spark: SparkSession, path: str) -> str:
    files, where = _opened(spark, path)
    size, stream = files.getFileStatus(where).getLen(), files.open(where)
    try:
        # a marker is one small JSON text, read as lines
        reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8"), max(1, size))
        lines = []
        while (line := reader.readLine()) is not None:
            lines.append(line)
        return "\n".join(lines)
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names of a folder's files in order, drafts left out; none if there is no folder."""
    files, where = _opened(spark, folder)
    if not files.exists(where):
        return []
    return sorted(n for s in files.listStatus(where) if not (n := s.getPath().getName()).startswith("."))


def remove(spark: SparkSession, path: str) -> None:
    files, where = _opened(spark, path)
    files.delete(where, True)
