"""Small files beside tables: claims and manifests, in whatever file system the tables are in."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if it is not there."""
    place, fs = _place(spark, folder)
    return sorted(status.getPath().getName() for status in fs.listStatus(place)) if fs.exists(place) else []


def exists(spark: SparkSession, path: str) -> bool:
    place, fs = _place(spark, path)
    return fs.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    place, fs = _place(spark, path)
    fs.delete(place, True)


def read_text(spark: SparkSession, path: str) -> str:
    place, fs = _place(spark, path)
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _write(stream, text: str) -> None:
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file that must not exist yet; False if it does.

    Of several callers one gets True.  The file system decides that in one step;
    for local paths, whose Hadoop client looks first and creates then, the
    operating system's exclusive creation is used.
    """
    place, fs = _place(spark, path)
    if fs.getUri().getScheme() == "file":
        local = unquote(urlparse(place.toUri().toString()).path)
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            with open(local, "x", encoding="utf-8") as out:
                out.write(text)
        except FileExistsError:
            return False
        return True
    try:
        stream = fs.create(place, False)
    except Exception:
        if fs.exists(place):
            return False
        raise
    _write(stream, text)
    return True


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Write a file so that readers see all of it or nothing; one that is there already is replaced."""
    place, fs = _place(spark, path)
    hidden, _ = _place(spark, f"{place.getParent()}/.{place.getName()}-{uuid.uuid4().hex}")
    _write(fs.create(hidden, True), text)
    files = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(getattr(files, "Options$Rename"), 1)
    options[0] = getattr(files, "Options$Rename").OVERWRITE
    files.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(hidden, place, options)
