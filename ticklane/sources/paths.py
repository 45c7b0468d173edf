"""Small files on whatever file system Spark reaches by a path."""

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    files, at = _at(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _at(spark, path)
    return files.exists(at)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """The whole file or none: written under another name, then renamed. An old one is replaced."""
    files, at = _at(spark, path)
    draft = at.suffix(f".{uuid.uuid4().hex}.draft")
    out = files.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(at, False)
    if not files.rename(draft, at):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    files, at = _at(spark, path)
    stream = files.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    files, at = _at(spark, path)
    files.delete(at, True)
