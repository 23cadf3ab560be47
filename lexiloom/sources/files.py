"""Files of any file system that Spark reaches: listing, reading and writing of small ones on the driver, single-file output."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder."""
    fs, where = _at(spark, path)
    return fs.exists(where)


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether there is a regular file."""
    fs, where = _at(spark, path)
    return fs.exists(where) and fs.getFileStatus(where).isFile()


def files_in(spark: SparkSession, path: str) -> list[str]:
    """Addresses of a file or of the regular files right inside of a folder, sorted by name; names that Spark hides (``_``, ``.``) are left out."""
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return []
    found = [s.getPath() for s in fs.listStatus(where) if s.isFile()]
    return [p.toUri().toString() for p in sorted(found, key=lambda p: p.getName()) if not p.getName().startswith(("_", "."))]


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """The content of a small file. Raises FileNotFoundError if there is none."""
    if not is_file(spark, path):
        raise FileNotFoundError(path)
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file; folders are made, an old file is replaced."""
    fs, where = _at(spark, path)
    stream = fs.create(where, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def read_json(spark: SparkSession, path: str) -> object:
    """The content of a JSON file."""
    return json.loads(read_bytes(spark, path).decode("utf-8"))


def write_json(spark: SparkSession, data: object, path: str, ascii_only: bool = False) -> None:
    """A JSON file in UTF-8, indented by 2; with ``ascii_only`` by 4 and other characters escaped."""
    write_bytes(spark, path, json.dumps(data, indent=4 if ascii_only else 2, ensure_ascii=ascii_only).encode("utf-8"))


def write_single(df: DataFrame, path: str, kind: str = "text", **options: object) -> None:
    """``df`` as one file in the order of its rows; for tables that one task can write."""
    spark = df.sparkSession
    folder = f"{path}-{uuid.uuid4().hex}"
    df.coalesce(1).write.format(kind).options(**options).save(folder)
    fs, where = _at(spark, path)
    parts = files_in(spark, folder)
    fs.mkdirs(where.getParent())
    if fs.exists(where):
        fs.delete(where, False)
    if parts:
        fs.rename(_at(spark, parts[0])[1], where)
    else:
        write_bytes(spark, path, b"")
    fs.delete(_at(spark, folder)[1], True)
