"""Summaries that refresh as facts come in: a micro-batch of facts is an epoch, with a refresh at its end.

An epoch writes its facts, then the new states and what they cover, and its mark
last. Readers and later epochs look only at epochs with a mark, and at none
after their own, so an epoch that was cut off or comes twice gives the same.
Of a fact that comes again the newest epoch's row counts, so a fact can become
obsolete; a summary that has read it keeps its line until it is written in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import summaries as S

FACTS = "id long, scope long, created_at timestamp, atomic_text string, is_obsolete boolean"
TABLES = {"facts": FACTS, "states": S.STATES, "covered": S.COVERED}


def rows(spark: SparkSession, target: str, kind: str, before: int | None = None) -> DataFrame:
    """Rows of one table in finished epochs, those before ``before`` if it is given."""
    own = spark.read.schema(f"{TABLES[kind]}, epoch int").option("ignoreMissingFiles", "true").parquet(f"{target}/{kind}")
    done = spark.read.schema("done int, epoch int").parquet(f"{target}/epochs").select("epoch").distinct()
    done = done if before is None else done.filter(F.col("epoch") < before)
    return own.join(F.broadcast(done), "epoch", "left_semi")  # a number for each epoch


def known(spark: SparkSession, target: str, kind: str, before: int) -> DataFrame:
    """As :func:`rows`; an empty table where no epoch is there yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/epochs")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], f"{TABLES[kind]}, epoch int")
    return rows(spark, target, kind, before)


def write_epoch(batch: DataFrame, epoch: int, target: str, now: Column, **rules) -> None:
    """Facts (FACTS) of one epoch and the refresh after them; ``rules`` go to :func:`mnemoria.operators.summaries.refresh`."""
    spark = batch.sparkSession
    where = {k: f"{target}/{k}/epoch={epoch}" for k in (*TABLES, "epochs")}
    names = [f.split()[0] for f in FACTS.split(", ")]
    batch.select(*names).write.mode("overwrite").parquet(where["facts"])
    new = spark.read.schema(FACTS).parquet(where["facts"]).withColumn("epoch", F.lit(epoch))
    every = known(spark, target, "facts", epoch).select(*names, "epoch").unionByName(new)
    rest = [c for c in every.columns if c not in ("id", "scope")]
    facts = every.groupBy("id", "scope").agg(F.max_by(F.struct(*rest), F.struct("epoch", "created_at", "atomic_text", "is_obsolete")).alias("r")).select("id", "scope", "r.*")
    states, covers = S.refresh(facts, known(spark, target, "states", epoch), known(spark, target, "covered", epoch), now, scope="scope", **rules)
    states.write.mode("overwrite").parquet(where["states"])
    covers.write.mode("overwrite").parquet(where["covered"])
    spark.range(1).select(F.lit(epoch).alias("done")).coalesce(1).write.mode("overwrite").parquet(where["epochs"])


def refresh_stream(spark: SparkSession, source: str, target: str, checkpoint: str, now: Column, every: str | None = None, files_per_batch: int = 1, **rules) -> StreamingQuery:
    """Facts from new files below ``source``; a refresh for each micro-batch, every ``every`` (say "5 minutes") or until all is read."""
    facts = spark.readStream.schema(FACTS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    when = {"processingTime": every} if every else {"availableNow": True}
    return facts.writeStream.foreachBatch(lambda batch, epoch: write_epoch(batch, epoch, target, now, **rules)).option("checkpointLocation", checkpoint).trigger(**when).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """(scope, summary, version, updated_at) of each scope."""
    return S.latest(rows(spark, target, "states")).select("scope", S.text_of(F.col("lines")).alias("summary"), "version", "updated_at")
