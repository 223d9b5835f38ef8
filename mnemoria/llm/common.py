"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folder of a local session without one.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset, one of the machine's own, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _own:
            _own["dir"] = "file://" + tempfile.mkdtemp(prefix="mnemoria-")
        base = _own["dir"]
    return base.rstrip("/")


#: Bytes of an Arrow batch between Spark and Python, where the session keeps Spark's default of 64 MB.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches: long texts, sets and trees make rows of many kilobytes. This setting stays, as results are lazy."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64m", "67108864"):
        spark.conf.set(key, f"{BATCH_BYTES}b")


def write_table(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/mnemoria/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table of :func:`write_table` that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def plain(docs: DataFrame, *own: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, ... but for those of ``own``, so that no name can clash, and what each was called, in order."""
    names = {c if c in own else f"c{i}": c for i, c in enumerate(docs.columns)}
    return docs.toDF(*names), names


def replacing(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` without columns that an operator is about to add (an input column of that name gives way)."""
    taken = {n.lower() for n in names}
    return docs.drop(*[c for c in docs.columns if c.lower() in taken])


def with_fields(df: DataFrame, **fields: str) -> T.StructType:
    """The schema of ``df`` and these further columns."""
    return T.StructType(df.schema.fields + [f for n, kind in fields.items() for f in T.StructType.fromDDL(f"`{n}` {kind}").fields])


def sha256_of(text) -> F.Column:
    """Lowercase hex SHA-256 of a text's UTF-8 bytes; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def parallelism(spark: SparkSession, least: int = 8) -> int:
    """Partitions for a repartition by key: what the session uses for shuffles."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
