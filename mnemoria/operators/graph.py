"""Entity graph: upserts, edges, neighbours, paths, scores and name resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring as R
from ..functions import text as X


def upsert_entities(mentions: DataFrame) -> DataFrame:
    """By normalised name: first spelling and type, every mention counted, distinct facts. ``mentions``: seq, name, entity_type, fact_id."""
    named = mentions.withColumn("normalized_name", X.normalize_name(F.col("name")))
    return named.groupBy("normalized_name").agg(F.min_by("name", "seq").alias("name"), F.min_by("entity_type", "seq").alias("entity_type"), F.count("*").alias("mention_count"), F.collect_set("fact_id").alias("fact_ids"))


def upsert_entities_by_type(mentions: DataFrame) -> DataFrame:
    """As above, but one name of two types is two entities, and facts are not kept."""
    named = mentions.withColumn("normalized_name", X.normalize_name(F.col("name")))
    return named.groupBy("normalized_name", "entity_type").agg(F.min_by("name", "seq").alias("name"), F.count("*").alias("mention_count"))


def merge_relations(edges: DataFrame) -> DataFrame:
    """Active edges by (source, target, type): greatest confidence, first fact. ``edges``: seq and those."""
    return edges.groupBy("source", "target", "relation_type").agg(F.max("confidence").alias("confidence"), F.min_by("fact_id", "seq").alias("fact_id"))


def latest_relations(edges: DataFrame) -> DataFrame:
    """As above, but a later fact takes the place of an earlier one."""
    return edges.groupBy("source", "target", "relation_type").agg(F.max("confidence").alias("confidence"), F.max_by("fact_id", "seq").alias("fact_id"))


def mark_obsolete(relations: DataFrame, gone: DataFrame) -> DataFrame:
    """Relations with is_obsolete, true for those whose (source, target, relation_type) is in ``gone``."""
    key = ["source", "target", "relation_type"]
    flags = gone.select(*key).distinct().withColumn("is_obsolete", F.lit(True))
    return relations.drop("is_obsolete").join(flags, key, "left").fillna(False, ["is_obsolete"])


def neighbors(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """One hop in both directions from ``nodes`` (entity), as two equi-joins; a self-loop counts once, as outgoing."""
    out = relations.join(nodes, F.col("source") == F.col("entity")).select("entity", F.col("target").alias("neighbor"), "relation_type", "confidence", F.lit("outgoing").alias("direction"))
    back = relations.filter("source <> target").join(nodes, F.col("target") == F.col("entity")).select("entity", F.col("source").alias("neighbor"), "relation_type", "confidence", F.lit("incoming").alias("direction"))
    return out.unionByName(back)


def edges_of(relations: DataFrame, entities: DataFrame, nodes: DataFrame, outgoing: bool = True) -> DataFrame:
    """Edges that leave (or reach) ``nodes``, with the other end's name."""
    here, there = ("source", "target") if outgoing else ("target", "source")
    own = relations.join(nodes, F.col(here) == nodes["entity"]).drop("entity")
    return own.join(entities.select(F.col("entity").alias(there), F.col("name").alias("other_name")), there)


def facts_of(entity_facts: DataFrame, nodes: DataFrame) -> DataFrame:
    return entity_facts.join(nodes, "entity").select("fact_id").distinct()


def graph_score(relations: DataFrame, entity_facts: DataFrame, nodes: DataFrame, boost: float = 0.2) -> DataFrame:
    """(query_id, fact_id, ...): 1 for a query entity's own fact, half an edge's confidence for a neighbour's, held to 1. ``nodes``: query_id, entity."""
    own = nodes.join(entity_facts, "entity").select("query_id", "fact_id", F.lit(1.0).alias("w"))
    near = neighbors(relations, nodes.select("entity").distinct()).join(nodes, "entity").select("query_id", F.col("neighbor").alias("entity"), "confidence")
    via = near.join(entity_facts, "entity").select("query_id", "fact_id", (F.col("confidence") * 0.5).alias("w"))
    both = own.unionByName(via)
    if "fact_id" in relations.columns:
        edge = neighbors_with_fact(relations, nodes).select("query_id", "fact_id", (F.col("confidence") * 0.3).alias("w"))
        both = both.unionByName(edge)
    score = both.groupBy("query_id", "fact_id").agg(F.least(F.lit(1.0), F.sum("w")).alias("entity_boost"))
    return score.withColumns({"graph_score": F.col("entity_boost") * boost, "relation_boost": F.col("entity_boost") * 0.5})


def neighbors_with_fact(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """The facts that established the edges around ``nodes``."""
    known = relations.filter("fact_id > 0")
    out = known.join(nodes, F.col("source") == F.col("entity")).select("query_id", "fact_id", "confidence")
    back = known.filter("source <> target").join(nodes, F.col("target") == F.col("entity")).select("query_id", "fact_id", "confidence")
    return out.unionByName(back)


def bfs_hops(relations: DataFrame, start: DataFrame, hops: int = 5) -> DataFrame:
    """(entity, hops): the fewest outgoing edges from ``start`` (entity); the frontier alone is joined in each step."""
    seen = start.select("entity", F.lit(0).alias("hops"))
    frontier = seen
    for h in range(1, hops + 1):
        step = frontier.join(relations, F.col("entity") == F.col("source")).select(F.col("target").alias("entity")).distinct()
        frontier = step.join(seen, "entity", "left_anti").withColumn("hops", F.lit(h))
        seen = seen.unionByName(frontier)
    return seen


def path_boosts(relations: DataFrame, entity_facts: DataFrame, start: DataFrame, hops: int = 2) -> DataFrame:
    """(fact_id, hops, boost): facts of entities around ``start`` in either direction, by the fewest edges to one of theirs."""
    both = relations.select("source", "target").unionByName(relations.select(F.col("target").alias("source"), F.col("source").alias("target")))
    near = bfs_hops(both, start, hops).join(entity_facts, "entity").groupBy("fact_id").agg(F.min("hops").alias("hops"))
    return near.withColumn("boost", R.path_boost(F.col("hops")))


def bfs_paths(relations: DataFrame, start: DataFrame, hops: int = 3) -> DataFrame:
    """(path, hops, confidence) along outgoing edges with a visited set for all: a node belongs to its best first path.

    Emits paths at the hop limit or at a sink; a node all of whose targets are
    visited emits none.
    """
    visited = start.select("entity")
    frontier = start.select("entity", F.array("entity").alias("path"), F.lit(1.0).alias("confidence"))
    has_out = relations.select(F.col("source").alias("entity")).distinct()
    done = []
    for h in range(hops):
        sinks = frontier.join(has_out, "entity", "left_anti").filter(F.size("path") > 1)
        done.append(sinks)
        step = frontier.join(relations.withColumnRenamed("confidence", "c"), F.col("entity") == F.col("source")).join(visited.select(F.col("entity").alias("target")), "target", "left_anti")
        best = Window.partitionBy("target").orderBy(F.desc("c"), "path")
        frontier = step.withColumn("r", F.row_number().over(best)).filter("r = 1").select(F.col("target").alias("entity"), F.concat("path", F.array("target")).alias("path"), (F.col("confidence") * F.col("c")).alias("confidence"))
        visited = visited.unionByName(frontier.select("entity"))
    done.append(frontier)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("path", (F.size("path") - 1).alias("hops"), "confidence")


def resolve(names: DataFrame, entities: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(name, entity): the exact name, else the best trigram match among those that begin alike."""
    own = names.select("name", X.normalize_name(F.col("name")).alias("n"), F.left(X.normalize_name(F.col("name")), F.lit(3)).alias("p"))
    known = entities.select("entity", X.normalize_name(F.col("name")).alias("k"), F.left(X.normalize_name(F.col("name")), F.lit(3)).alias("p"))
    scored = own.join(known, "p").withColumn("similarity", X.trigram_similarity(F.col("n"), F.col("k"))).filter(F.col("similarity") >= threshold)
    best = Window.partitionBy("name").orderBy(F.desc("similarity"), "entity")
    return scored.withColumn("r", F.row_number().over(best)).filter("r = 1").select("name", "entity", "similarity")
