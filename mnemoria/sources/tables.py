"""The engine's tables, derived from the tables at hand; every derivation is deterministic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.wordlists import CATEGORIES

NOW = "2024-02-01 00:00:00"
FACT_SCHEMA = (
    "id long, fact_text string, atomic_text string, category string, importance double, embedding array<float>, keywords array<string>, timestamp_anchor timestamp, location string, "
    "entities array<struct<name:string,type:string>>, episode_id long, turn_id string, created_at timestamp, last_accessed timestamp, access_count int, is_obsolete boolean, superseded_by long"
)
MEMORY_SCHEMA = "id long, text string, summary string, role string, embedding array<float>, token_count int, created_at timestamp, compressed boolean, parent_id long, importance_score double"
TURN_SCHEMA = "id long, role string, content string, created_at timestamp"
ENTITY_SCHEMA = "id long, name string, normalized_name string, entity_type string, embedding array<float>, created_at timestamp, fact_ids array<long>, mention_count int"
RELATION_SCHEMA = "id long, source_entity_id long, target_entity_id long, relation_type string, fact_id long, confidence double, created_at timestamp, is_obsolete boolean"
EPISODE_SCHEMA = "id long, session_id string, started_at timestamp, ended_at timestamp, summary string, fact_count int, entity_mentions array<string>"
SUMMARY_SCHEMA = "id long, summary string, source_fact_ids array<long>, pending_fact_ids array<long>, updated_at timestamp"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def minutes_after(n: Column, start: str = "2024-01-01 00:00:00") -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + n * 60)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per turn: hours by conversation, minutes by turn."""
    c = read(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", "role", F.col("text").alias("content"), minutes_after(F.col("conv_id") * 60 + F.col("turn")).alias("created_at"))


def facts(spark: SparkSession, sf_dir: str, with_vectors: bool = False) -> DataFrame:
    docs, labels, events = (read(spark, sf_dir, n) for n in ("documents", "labels", "events"))
    access = events.groupBy("user_id").agg(F.count("*").cast("int").alias("access_count"), F.max("ts").alias("last_ts"))
    created = minutes_after(F.col("doc_id"))
    out = docs.join(labels, "doc_id", "left").join(access, F.col("doc_id") == F.col("user_id"), "left").select(
        F.col("doc_id").alias("id"), F.col("text").alias("fact_text"), F.col("text").alias("atomic_text"),
        F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("doc_id") % 8 + 1).cast("int")).alias("category"),
        F.when(F.col("quality") == 1, 0.8).when(F.col("quality") == 0, 0.3).otherwise(0.5).alias("importance"),
        created.alias("created_at"), F.coalesce(F.col("last_ts").cast("timestamp"), created).alias("last_accessed"), F.coalesce("access_count", F.lit(0)).alias("access_count"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("is_obsolete"), (F.col("doc_id") % 50).alias("episode_id"))
    if with_vectors:
        out = out.join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id")
    return out


#: The same table as SQL text, for the oracle.
FACTS_SQL = f"""facts AS (
  SELECT d.doc_id AS id, d.text AS atomic_text, list_extract([{', '.join(f"'{c}'" for c in CATEGORIES)}], CAST(d.doc_id % 8 AS INTEGER) + 1) AS category,
         CASE WHEN l.quality = 1 THEN 0.8e0 WHEN l.quality = 0 THEN 0.3e0 ELSE 0.5e0 END AS importance,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id) AS created_at,
         coalesce(e.t, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id)) AS last_accessed,
         coalesce(e.n, 0) AS access_count, coalesce(l.toxic, 0) = 1 AS is_obsolete, d.doc_id % 50 AS episode_id
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN (SELECT user_id, count(*) AS n, max(ts) AS t FROM events GROUP BY user_id) e ON e.user_id = d.doc_id)"""


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector memory: a row per fact that has a vector; every seventh is already compressed."""
    f = facts(spark, sf_dir, with_vectors=True)
    return f.select("id", F.col("atomic_text").alias("text"), "embedding", X.tokens_floor_chars(F.col("atomic_text")).alias("token_count"), "created_at", (F.col("id") % 7 == 0).alias("compressed"), F.col("importance").alias("importance_score"))


MEMORIES_SQL = FACTS_SQL + """, memories AS (
  SELECT f.id, f.atomic_text AS text, CAST(v.embedding AS DOUBLE[]) AS embedding, length(f.atomic_text) // 4 AS token_count, f.created_at, f.id % 7 = 0 AS compressed, f.importance AS importance_score
  FROM facts f JOIN embeddings v ON v.vec_id = f.id)"""


def graph(spark: SparkSession, sf_dir: str, orders: str = "o_orderkey % 10 = 1") -> tuple[DataFrame, DataFrame]:
    """(entities, relations) from nations, regions, customers, suppliers and who bought from whom in ``orders``, a tenth or (:func:`whole_graph`) all of them."""
    nation, region, customer, supplier = (read(spark, sf_dir, n) for n in ("nation", "region", "customer", "supplier"))
    node = lambda df, kind, key, name: df.select(F.concat(F.lit(kind + ":"), F.col(key).cast("string")).alias("entity"), F.col(name).alias("name"), F.lit(kind).alias("entity_type"))
    entities = node(nation, "nation", "n_nationkey", "n_name").unionByName(node(region, "region", "r_regionkey", "r_name")).unionByName(node(customer, "customer", "c_custkey", "c_name")).unionByName(node(supplier, "supplier", "s_suppkey", "s_name"))
    edge = lambda df, s, sk, t, tk, kind, conf: df.select(F.concat(F.lit(s + ":"), F.col(sk).cast("string")).alias("source"), F.concat(F.lit(t + ":"), F.col(tk).cast("string")).alias("target"), F.lit(kind).alias("relation_type"), F.lit(conf).alias("confidence"))
    bought = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).filter(orders).select("o_custkey", "l_suppkey").distinct()
    relations = (
        edge(customer, "customer", "c_custkey", "nation", "c_nationkey", "lives_in", 0.8).unionByName(edge(nation, "nation", "n_nationkey", "region", "n_regionkey", "member_of", 0.75))
        .unionByName(edge(supplier, "supplier", "s_suppkey", "nation", "s_nationkey", "lives_in", 0.8)).unionByName(edge(bought, "customer", "o_custkey", "supplier", "l_suppkey", "knows", 0.7))
    )
    return entities, relations


def whole_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return graph(spark, sf_dir, "true")


GRAPH_SQL = """entities AS (
  SELECT 'nation:' || n_nationkey AS entity, n_name AS name, 'nation' AS entity_type FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, r_name, 'region' FROM region
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'customer' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'supplier' FROM supplier),
relations AS (
  SELECT 'customer:' || c_custkey AS source, 'nation:' || c_nationkey AS target, 'lives_in' AS relation_type, 0.8e0 AS confidence FROM customer
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'member_of', 0.75e0 FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'lives_in', 0.8e0 FROM supplier
  UNION ALL SELECT DISTINCT 'customer:' || o_custkey, 'supplier:' || l_suppkey, 'knows', 0.7e0 FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 10 = 1)"""


def entity_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, fact_id): each fact belongs to one customer."""
    n = read(spark, sf_dir, "customer").agg(F.count("*").alias("n"))
    return read(spark, sf_dir, "documents").crossJoin(F.broadcast(n)).select(F.concat(F.lit("customer:"), (F.col("doc_id") % F.col("n") + 1).cast("string")).alias("entity"), F.col("doc_id").alias("fact_id"))


ENTITY_FACTS_SQL = "entity_facts AS (SELECT 'customer:' || (doc_id % (SELECT count(*) FROM customer) + 1) AS entity, doc_id AS fact_id FROM documents)"


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("operation"), F.round(F.col("value") * 1000).cast("long").alias("duration_us"), "event_id")
