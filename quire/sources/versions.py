"""Versioned manifests of a table folder, on any file system Spark can write.

``path/_versions/<number>.json`` says what the table is made of; the highest number
counts.  A version is written aside and renamed, and a rename never replaces a version
that is there: of two writers of one number the second fails and may try again.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession


class ConcurrentWrite(RuntimeError):
    """Another writer published this version first."""


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def latest(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """``(version, content)`` of the current version; ``(-1, None)`` where there is none."""
    fs, make = _hadoop(spark, path)
    folder = make(f"{path.rstrip('/')}/_versions")
    if not fs.exists(folder):
        return -1, None
    numbers = [int(m[1]) for s in fs.listStatus(folder)
               if (m := re.fullmatch(r"(\d+)\.json", s.getPath().getName()))]
    if not numbers:
        return -1, None
    stream = fs.open(make(f"{path.rstrip('/')}/_versions/{max(numbers):010d}.json"))
    try:
        content = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()
    return max(numbers), json.loads(content)


def publish(spark: SparkSession, path: str, version: int, content: dict) -> None:
    """Make ``content`` version ``version``, if no one else has."""
    fs, make = _hadoop(spark, path)
    folder = f"{path.rstrip('/')}/_versions"
    aside, final = make(f"{folder}/_{uuid.uuid4().hex}"), make(f"{folder}/{version:010d}.json")
    out = fs.create(aside, False)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    if fs.exists(final) or not fs.rename(aside, final):
        fs.delete(aside, False)
        raise ConcurrentWrite(f"{path}: version {version} exists")


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that no version names any more."""
    for path in paths:
        fs, make = _hadoop(spark, path)
        fs.delete(make(path), True)
