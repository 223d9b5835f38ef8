"""Conversation ingest: turns in, facts with their entities, relations and episodes out, each turn once.

A micro-batch is an epoch. It writes the rows of each table into the epoch's own
folder, which a second try overwrites, and its mark last; readers look only at
epochs with a mark, so they see all of an epoch or nothing. Keys are natural (a
fact is its conversation and turn), so a turn that comes again in a later epoch
is the same fact: the first epoch's row counts.

Without a model each turn is one fact: its text with relative times resolved,
category ``other``, importance 0.5. Entities come from the text as said,
relations from the resolved one; texts under ``LEAST`` bytes are kept as they
are and give neither. Null contents are empty; null roles too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..operators import extract, graph

LEAST = 10
FACTS = "id long, conv_id long, turn long, atomic_text string, category string, importance double, created_at timestamp, encoded boolean"
MENTIONS = "fact_id long, name string, entity_type string"
EDGES = "fact_id long, source string, target string, relation_type string, confidence double"
TABLES = {"facts": FACTS, "mentions": MENTIONS, "edges": EDGES}


def encoded(turns: DataFrame, now: Column) -> DataFrame:
    """(FACTS and said): a fact for each turn (conv_id, turn, role, content, created_at)."""
    said = F.trim(F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("content", F.lit("")), F.lit("\n")), F.lit(" \t\n\r\f"))
    rows = turns.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", F.col("turn").cast("long").alias("turn"), "created_at", said.alias("said"))
    long = F.octet_length("said") >= LEAST
    text = F.when(long, extract.anchor_times(F.col("said"), now)).otherwise(F.col("said"))
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", text.alias("atomic_text"), F.lit("other").alias("category"), F.lit(0.5).alias("importance"), "created_at", long.alias("encoded"), "said")


def write_epoch(turns: DataFrame, epoch: int, target: str, now: Column) -> None:
    """All tables of one epoch, then its mark; trying again gives the same."""
    spark = turns.sparkSession
    facts = encoded(turns, now)
    where = {k: f"{target}/{k}/epoch={epoch}" for k in (*TABLES, "epochs")}
    facts.write.mode("overwrite").parquet(where["facts"])
    facts = spark.read.schema(f"{FACTS}, said string").parquet(where["facts"]).filter("encoded")
    extract.entities(facts.select(F.col("id").alias("fact_id"), "said"), "said").select("fact_id", "name", "entity_type").write.mode("overwrite").parquet(where["mentions"])
    extract.relations(facts.select(F.col("id").alias("fact_id"), "atomic_text"), "atomic_text").select("fact_id", "source", "target", "relation_type", "confidence").write.mode("overwrite").parquet(where["edges"])
    spark.range(1).select(F.lit(epoch).alias("done")).coalesce(1).write.mode("overwrite").parquet(where["epochs"])


def ingest_conversations(spark: SparkSession, source: str, schema, target: str, checkpoint: str, now: Column, files_per_batch: int = 1) -> StreamingQuery:
    """Turns from new files below ``source`` into the tables below ``target``; goes on where it ended."""
    turns = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return turns.writeStream.foreachBatch(lambda batch, epoch: write_epoch(batch, epoch, target, now)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rows(spark: SparkSession, target: str, kind: str) -> DataFrame:
    """The rows of one table in epochs that are complete, with their epoch."""
    done = spark.read.schema("done int, epoch int").parquet(f"{target}/epochs").select("epoch").distinct()
    return spark.read.schema(f"{TABLES[kind]}, epoch int").parquet(f"{target}/{kind}").join(F.broadcast(done), "epoch", "left_semi")  # a number for each epoch


def facts(spark: SparkSession, target: str) -> DataFrame:
    own = rows(spark, target, "facts")
    rest = [c for c in own.columns if c not in ("id", "epoch")]
    return own.groupBy("id").agg(F.min_by(F.struct(*rest, "epoch"), "epoch").alias("r")).select("id", "r.*")


def _of_facts(spark: SparkSession, target: str, kind: str) -> DataFrame:
    """Rows of the epoch that a fact counts from."""
    kept = facts(spark, target).select(F.col("id").alias("fact_id"), "epoch", "created_at")
    return rows(spark, target, kind).join(kept, ["fact_id", "epoch"])


def entities(spark: SparkSession, target: str) -> DataFrame:
    """(normalized_name, name, entity_type, mention_count): the first spelling and type; a fact names an entity once."""
    named = _of_facts(spark, target, "mentions").withColumn("normalized_name", X.normalize_name(F.col("name")))
    first = F.struct("created_at", "fact_id", "name")
    return named.groupBy("normalized_name").agg(F.min_by("name", first).alias("name"), F.min_by("entity_type", first).alias("entity_type"), F.count("*").alias("mention_count"))


def relations(spark: SparkSession, target: str) -> DataFrame:
    """(source, target, relation_type, confidence, fact_id): by names, the greatest confidence and the first fact."""
    edges = _of_facts(spark, target, "edges").select(X.normalize_name(F.col("source")).alias("source"), X.normalize_name(F.col("target")).alias("target"), "relation_type", "confidence", "fact_id", F.struct("created_at", "fact_id").alias("seq"))
    return graph.merge_relations(edges)


def episodes(spark: SparkSession, target: str) -> DataFrame:
    """(conv_id, started_at, ended_at, fact_count, n_entities): an episode is a conversation."""
    named = _of_facts(spark, target, "mentions").select("fact_id", X.normalize_name(F.col("name")).alias("entity"))
    own = facts(spark, target)
    mentioned = own.join(named, own["id"] == named["fact_id"]).groupBy("conv_id").agg(F.count_distinct("entity").alias("n_entities"))
    spans = own.groupBy("conv_id").agg(F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at"), F.count("*").alias("fact_count"))
    return spans.join(mentioned, "conv_id", "left").fillna(0, ["n_entities"])
