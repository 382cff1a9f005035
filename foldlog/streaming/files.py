"""Small files through Hadoop's interface: read, and create so that only one of several writers succeeds."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def at(spark: SparkSession, path: str):
    """The JVM, the path, and its file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    _, where, fs = at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def times(spark: SparkSession, folder: str) -> list[tuple[str, float]]:
    """Names in a folder and when each was written."""
    _, where, fs = at(spark, folder)
    return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(where)] if fs.exists(where) else []


def read(spark: SparkSession, path: str) -> str | None:
    """The file's text; None if there is no such file."""
    jvm, where, fs = at(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a whole file under a name that nobody has taken; False if somebody has.

    The text is written under a name of its own first, so no reader sees a part of it. On local disks, whose rename
    overwrites, it is then linked; elsewhere it is renamed, which HDFS refuses if the name is taken.
    """
    folder, _, name = path.rpartition("/")
    jvm, draft, fs = at(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    fs.mkdirs(draft.getParent())
    out = fs.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        final = jvm.org.apache.hadoop.fs.Path(path)
        if fs.getUri().getScheme() == "file":
            local = lambda p: jvm.java.io.File(fs.makeQualified(p).toUri().getPath()).toPath()
            try:
                jvm.java.nio.file.Files.createLink(local(final), local(draft))
                return True
            except Exception:
                if fs.exists(final):
                    return False
                raise
        return not fs.exists(final) and bool(fs.rename(draft, final))
    finally:
        fs.delete(draft, False)


def remove(spark: SparkSession, path: str) -> None:
    _, where, fs = at(spark, path)
    fs.delete(where, True)
