"""Folders for tables that outlive a job, and conversions of imported rows."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one (``spark.checkpoint.dir``); where none is set, a temporary one, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="mnemoria-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in a new folder, so that what several steps read is worked out once and outlives an executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ensure(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, made empty if it isn't there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def next_ids(rows: DataFrame, key: Column) -> DataFrame:
    """Ids from a natural key, so that a retried batch gives the same ones."""
    return rows.withColumn("id", F.xxhash64(key))


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda t: t != "")


def id_list(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ","), lambda t: F.trim(t) != ""), lambda t: t.cast("long"))


def entity_list(json: Column) -> Column:
    return F.from_json(json, "array<struct<name:string,type:string>>")


def seed_if_absent(rows: DataFrame, seed: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` and those of ``seed`` whose key isn't among them."""
    return rows.unionByName(seed.join(rows.select(key), key, "left_anti"), allowMissingColumns=True)


def decode_vector(blob: Column) -> Column:
    """Little-endian float32 bytes to an array; null if the length isn't a multiple of four. For imports only."""
    @pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))

    return run(blob)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
