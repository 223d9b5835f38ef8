"""Versions of a set of tables: a version is a small table of facts about the parts it is made of.

Parts are folders that never change once written. A version names its parts and
is written last, as one folder whose rename makes it visible at once, so readers
see one version or another and never half of one; a writer that dies leaves
parts that no version names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, path: str) -> list[int]:
    """All versions at ``path``, oldest first."""
    where, fs = _fs(spark, f"{path}/versions")
    if not fs.exists(where):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(where) if s.getPath().getName().isdigit())


def read(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """What version ``version`` (the newest, if none is named) says."""
    known = numbers(spark, path)
    version = known[-1] if version is None and known else version
    if version not in known:
        raise ValueError(f"no version {version} at {path}")
    return json.loads(spark.read.text(f"{path}/versions/{version}").first()[0])


def publish(spark: SparkSession, path: str, about: dict, after: int) -> int:
    """Makes ``about`` the version after ``after``; a writer that comes second fails and has changed nothing."""
    number = after + 1
    own = f"{path}/pending-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(about | {"version": number}),)], "value string").coalesce(1).write.text(own)
    source, fs = _fs(spark, own)
    target, _ = _fs(spark, f"{path}/versions/{number}")
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)
        raise ValueError(f"version {number} of {path} is taken: another writer was first")
    return number


def part(path: str, kind: str) -> str:
    """A new folder for a part."""
    return f"{path}/{kind}-{uuid.uuid4().hex}"
