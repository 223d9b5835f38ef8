"""Entity graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G
from ..sources import tables as T
from .registry import ORACLES, QUERIES, query, whole

GRAPH = T.GRAPH_SQL
SOME = " WHERE o_orderkey % 10 = 1"


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "entity string")


MENTIONS = "m AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN upper(c_name) ELSE '  ' || c_name END AS name, CASE WHEN o_orderkey % 5 = 0 THEN 'other' ELSE 'person' END AS entity_type, o_orderkey // 3 AS fact_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey <= 4000)"


def mentions(spark, sf, some="o_orderkey <= 4000"):
    o = T.read(spark, sf, "orders").filter(some).join(T.read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    name = F.when(F.col("o_orderkey") % 2 == 0, F.upper("c_name")).otherwise(F.concat(F.lit("  "), F.col("c_name")))
    return o.select(F.col("o_orderkey").alias("seq"), name.alias("name"), F.when(F.col("o_orderkey") % 5 == 0, "other").otherwise("person").alias("entity_type"), F.floor(F.col("o_orderkey") / 3).alias("fact_id"))


@query(f"""WITH {MENTIONS} SELECT lower(trim(name)) AS normalized_name, arg_min(name, seq) AS name, arg_min(entity_type, seq) AS entity_type, count(*) AS mention_count, count(DISTINCT fact_id) AS n_facts FROM m GROUP BY 1""")
def entity_upsert(spark, sf, some="o_orderkey <= 4000"):
    return G.upsert_entities(mentions(spark, sf, some)).select("normalized_name", "name", "entity_type", "mention_count", F.size("fact_ids").cast("long").alias("n_facts"))


@query("""WITH m AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS seq, l_suppkey AS source, l_partkey % 20 AS target, l_returnflag AS relation_type, l_discount AS confidence, l_orderkey AS fact_id FROM lineitem WHERE l_orderkey <= 2000)
SELECT source, target, relation_type, max(confidence) AS confidence, arg_min(fact_id, seq) AS fact_id FROM m GROUP BY ALL""")
def relation_merge(spark, sf, some="l_orderkey <= 2000"):
    e = T.read(spark, sf, "lineitem").filter(some)
    e = e.select(F.struct("l_orderkey", "l_linenumber").alias("seq"), F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 20).alias("target"), F.col("l_returnflag").alias("relation_type"), F.col("l_discount").alias("confidence"), F.col("l_orderkey").alias("fact_id"))
    return G.merge_relations(e)


@query(f"""WITH {GRAPH}, n AS (SELECT 'nation:' || n_nationkey AS entity FROM nation WHERE n_nationkey < 6)
SELECT entity, target AS neighbor, relation_type, confidence, 'outgoing' AS direction FROM relations JOIN n ON source = entity UNION ALL SELECT entity, source, relation_type, confidence, 'incoming' FROM relations JOIN n ON target = entity WHERE source <> target""")
def one_hop_neighbors(spark, sf, graph=T.graph, some="n_nationkey < 6"):
    _, r = graph(spark, sf)
    return G.neighbors(r, T.read(spark, sf, "nation").filter(some).select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("entity")))


def _edges(out: bool):
    here, there = ("source", "target") if out else ("target", "source")
    sql = f"WITH {GRAPH} SELECT r.{here} AS entity, r.{there} AS other, e.name AS other_name, relation_type, confidence FROM relations r JOIN entities e ON e.entity = r.{there} WHERE r.{here} IN ('nation:3', 'customer:7', 'supplier:2')"

    def run(spark, sf, graph=T.graph):
        e, r = graph(spark, sf)
        return G.edges_of(r, e, nodes(spark, "nation:3", "customer:7", "supplier:2"), out).select(F.col(here).alias("entity"), F.col(there).alias("other"), "other_name", "relation_type", "confidence")

    run.__name__ = "outgoing_edges" if out else "incoming_edges"
    query(sql)(run)
    whole(run, SOME, T.whole_graph)


_edges(True)
_edges(False)


@query(f"WITH {T.ENTITY_FACTS_SQL} SELECT DISTINCT fact_id FROM entity_facts WHERE entity IN ('customer:1', 'customer:2', 'customer:30')")
def facts_for_entities(spark, sf):
    return G.facts_of(T.entity_facts(spark, sf), nodes(spark, "customer:1", "customer:2", "customer:30"))


@query(f"""WITH {GRAPH}, {T.ENTITY_FACTS_SQL}, n AS (SELECT * FROM (VALUES (1, 'customer:1'), (1, 'supplier:2'), (2, 'nation:3')) t(query_id, entity)),
nb AS (SELECT query_id, target AS entity, confidence FROM relations JOIN n ON source = entity UNION ALL SELECT query_id, source, confidence FROM relations JOIN n ON target = entity WHERE source <> target),
w AS (SELECT query_id, fact_id, 1e0 AS w FROM n JOIN entity_facts USING (entity) UNION ALL SELECT query_id, fact_id, 0.5e0 * confidence FROM nb JOIN entity_facts USING (entity))
SELECT query_id, fact_id, round(least(1e0, sum(w)), 6) AS entity_boost, round(least(1e0, sum(w)) * 0.2e0, 6) AS graph_score, round(least(1e0, sum(w)) * 0.5e0, 6) AS relation_boost FROM w GROUP BY query_id, fact_id""")
def graph_score(spark, sf, graph=T.graph):
    _, r = graph(spark, sf)
    n = spark.createDataFrame([(1, "customer:1"), (1, "supplier:2"), (2, "nation:3")], "query_id int, entity string")
    return G.graph_score(r, T.entity_facts(spark, sf), n).select("query_id", "fact_id", *[F.round(c, 6).alias(c) for c in ("entity_boost", "graph_score", "relation_boost")])


@query(f"""WITH RECURSIVE {GRAPH}, b AS (SELECT 'customer:1' AS entity, 0 AS hops UNION SELECT r.target, b.hops + 1 FROM b JOIN relations r ON r.source = b.entity WHERE b.hops < 4)
SELECT entity, min(hops) AS hops FROM b GROUP BY entity""")
def bfs_hops(spark, sf, graph=T.graph):
    _, r = graph(spark, sf)
    return G.bfs_hops(r, nodes(spark, "customer:1"), 4)


@query()
def bfs_paths(spark, sf):
    _, r = T.whole_graph(spark, sf)
    return G.bfs_paths(r, nodes(spark, "customer:1", "customer:4"), 3).select(F.array_join("path", ">").alias("path"), "hops", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {GRAPH}, q AS (SELECT n_name || 'X' AS name FROM nation), g AS (SELECT q.name, e.entity, lower(q.name) AS a, lower(e.name) AS b FROM q JOIN entities e ON left(lower(q.name), 3) = left(lower(e.name), 3)),
t AS (SELECT name, entity, list_distinct(list_transform(range(1, length(a) - 1), lambda i: substr(a, i, 3))) AS x, list_distinct(list_transform(range(1, length(b) - 1), lambda i: substr(b, i, 3))) AS y FROM g),
s AS (SELECT name, entity, len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE) AS similarity FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY similarity DESC, entity) AS rn FROM s WHERE similarity >= 0.6e0) SELECT name, entity, round(similarity, 6) AS similarity FROM r WHERE rn = 1""")
def entity_resolution(spark, sf):
    e, _ = T.graph(spark, sf)
    q = T.read(spark, sf, "nation").select(F.concat(F.col("n_name"), F.lit("X")).alias("name"))
    return G.resolve(q, e, 0.6).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {GRAPH} SELECT 'entity' AS what, entity_type AS kind, count(*) AS n FROM entities GROUP BY 2 UNION ALL SELECT 'relation', relation_type, count(*) FROM relations GROUP BY 2")
def graph_stats(spark, sf, graph=T.graph):
    e, r = graph(spark, sf)
    return e.groupBy(F.lit("entity").alias("what"), F.col("entity_type").alias("kind")).agg(F.count("*").alias("n")).unionByName(r.groupBy(F.lit("relation").alias("what"), F.col("relation_type").alias("kind")).agg(F.count("*").alias("n")))


@query(f"""WITH {GRAPH} SELECT entity, name FROM entities WHERE contains(lower(name), '00000000') ORDER BY lower(name) = '00000000' DESC, entity LIMIT 10""")
def name_search(spark, sf):
    e, _ = T.graph(spark, sf)
    hit = e.filter(X.normalize_name(F.col("name")).contains("00000000"))
    return hit.orderBy(F.desc(X.normalize_name(F.col("name")) == "00000000"), "entity").limit(10).select("entity", "name")


@query(f"WITH {GRAPH} SELECT entity, name FROM entities WHERE starts_with(lower(name), left(lower('Supplier#1'), 3)) ORDER BY entity LIMIT 10")
def name_prefix(spark, sf):
    e, _ = T.graph(spark, sf)
    return e.filter(X.normalize_name(F.col("name")).startswith("sup")).orderBy("entity").limit(10).select("entity", "name")


@query(f"""WITH {GRAPH}, m AS (SELECT source, target, relation_type, confidence, source LIKE '%7' AS gone FROM relations) SELECT relation_type, count(*) AS n, count(*) FILTER (WHERE NOT gone) AS active FROM m GROUP BY 1""")
def active_relations(spark, sf, graph=T.graph):
    _, r = graph(spark, sf)
    return r.withColumn("gone", F.col("source").endswith("7")).groupBy("relation_type").agg(F.count("*").alias("n"), F.count_if(~F.col("gone")).alias("active"))


for _f in (graph_score, bfs_hops, graph_stats, active_relations):
    whole(_f, SOME, T.whole_graph)
whole(entity_upsert, " WHERE o_orderkey <= 4000", "true")
whole(relation_merge, " WHERE l_orderkey <= 2000", "true")
QUERIES["one_hop_neighbors"] = lambda spark, sf: one_hop_neighbors(spark, sf, T.whole_graph, "true")
ORACLES["one_hop_neighbors"] = ORACLES["one_hop_neighbors"].replace(SOME, "").replace(" WHERE n_nationkey < 6", "")
