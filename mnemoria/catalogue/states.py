"""Summary state, episodes, boosts, graph writes and other small reads and writes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import metrics
from ..functions import scoring as R
from ..functions import text as X
from ..operators import episodes, graph, lifecycle, summaries
from ..sources import tables as T
from ..sources.store import stored
from .graphs import MENTIONS, SOME, mentions, nodes
from .lives import FACTS, HOURS, MEMORIES
from .registry import query

GRAPH = T.GRAPH_SQL.replace(SOME, "")


@query(f"""WITH {FACTS}, n AS (SELECT count(*) AS n_active, count(*) FILTER (WHERE id % 4 = 0) AS n_pending FROM facts WHERE NOT is_obsolete),
s AS (SELECT 'summary ' || id AS summary, created_at FROM facts WHERE id % 100 = 0 ORDER BY created_at DESC, id DESC LIMIT 1)
SELECT summary, n_active, n_pending, n_pending > 0 AS dirty, n_active >= 3 AS needed, {HOURS.format(c='created_at')} > 2 AS stale, n_pending > 0 AND n_pending * 2 < n_active AS incremental FROM n, s""")
def summary_state(spark, sf):
    f = T.facts(spark, sf)
    states = f.filter("id % 100 = 0").select("id", F.concat(F.lit("summary "), F.col("id").cast("string")).alias("summary"), F.col("created_at").alias("updated_at"))
    return lifecycle.summary_state(f, states, f.filter("id % 4 <> 0").select(F.col("id").alias("fact_id")), T.now())


@query(f"""WITH {FACTS}, a AS (SELECT id, episode_id AS scope, created_at, coalesce(atomic_text, '') AS t, id % 3 <> 0 AS early FROM facts WHERE NOT is_obsolete),
c AS (SELECT scope, count(*) FILTER (WHERE early) AS n1, count(*) AS n FROM a GROUP BY scope),
r AS (SELECT a.*, n1, n, row_number() OVER (PARTITION BY scope, early ORDER BY created_at DESC, id DESC) AS back, row_number() OVER (PARTITION BY scope, early ORDER BY created_at, id) AS forth, row_number() OVER (PARTITION BY scope ORDER BY created_at DESC, id DESC) AS back_of_all FROM a JOIN c USING (scope)),
l AS (SELECT scope, n1, n, CASE WHEN early OR n1 < 5 THEN 0 ELSE 1 END AS part, created_at, id, t FROM r WHERE CASE WHEN n1 >= 5 THEN (early AND back <= 8) OR (NOT early AND n - n1 >= 5 AND forth <= 8) ELSE n >= 5 AND back_of_all <= 8 END),
k AS (SELECT *, n1 >= 5 AND n - n1 >= 5 AS incremental FROM l QUALIFY row_number() OVER (PARTITION BY scope ORDER BY part DESC, created_at DESC, id DESC) <= 8)
SELECT scope, CAST(CASE WHEN incremental THEN 2 ELSE 1 END AS INTEGER) AS version, incremental, CAST(CASE WHEN incremental THEN least(8, n - n1) WHEN n1 >= 5 THEN n1 ELSE n END AS BIGINT) AS n_new, string_agg('- ' || t, chr(10) ORDER BY part, created_at, id) AS summary FROM k GROUP BY scope, incremental, n1, n""")
def summary_refresh(spark, sf):
    """Two refreshes of all episodes: after two thirds of the facts, and after all of them."""
    f = T.facts(spark, sf)
    none = spark.createDataFrame([], summaries.STATES), spark.createDataFrame([], summaries.COVERED)
    first = [stored(t, "summaries") for t in summaries.refresh(f.filter("id % 3 <> 0"), *none, T.now(), newest=8)]
    second, _ = summaries.refresh(f, *first, T.now(), newest=8)
    return summaries.latest(first[0].unionByName(second)).select("scope", "version", "incremental", "n_new", summaries.text_of(F.col("lines")).alias("summary"))


@query(f"WITH {FACTS} SELECT episode_id, CAST(epoch(min(created_at)) AS BIGINT) AS started_s, CAST(epoch(max(created_at)) AS BIGINT) AS ended_s, count(*) AS n FROM facts GROUP BY episode_id ORDER BY min(created_at) DESC, episode_id DESC LIMIT 10")
def recent_episodes(spark, sf):
    out = episodes.newest(episodes.by_id(T.facts(spark, sf), "episode_id"), "episode_id")
    return out.select("episode_id", F.unix_timestamp("started_at").alias("started_s"), F.unix_timestamp("ended_at").alias("ended_s"), "n")


@query("SELECT conv_id, min(conv_id * 3600 + turn * 60) + 1704067200 AS started_s, max(conv_id * 3600 + turn * 60) + 1704067200 AS ended_s, count(*) AS n FROM conversations GROUP BY conv_id")
def episodes_by_id(spark, sf):
    out = episodes.by_id(T.turns(spark, sf), "conv_id")
    return out.select("conv_id", F.unix_timestamp("started_at").alias("started_s"), F.unix_timestamp("ended_at").alias("ended_s"), "n")


@query(f"WITH {MEMORIES} SELECT id, compressed FROM memories WHERE NOT compressed UNION ALL (SELECT id, compressed FROM memories WHERE compressed ORDER BY created_at DESC, id DESC LIMIT 10)")
def prune_compressed(spark, sf):
    return lifecycle.prune_compressed(T.memories(spark, sf), 10).select("id", "compressed")


@query(f"WITH {FACTS} SELECT id, category FROM facts WHERE category IN ('event', 'belief')")
def category_set_filter(spark, sf):
    return lifecycle.in_categories(T.facts(spark, sf), ["event", "belief"]).select("id", "category")


@query(f"WITH {FACTS} SELECT id, CASE WHEN id % 3 = 0 THEN atomic_text ELSE 'merged ' || id END AS merged FROM facts")
def merged_fact_text(spark, sf):
    reply = F.when(F.col("id") % 3 == 0, "   ").otherwise(F.concat(F.lit("  merged "), F.col("id").cast("string"), F.lit(" ")))
    return T.facts(spark, sf).select("id", lifecycle.merged_text(reply, F.col("atomic_text")).alias("merged"))


@query(f"""WITH {FACTS}, found AS (SELECT episode_id AS query_id, id FROM facts WHERE importance > 0.7e0 AND episode_id % 3 = 0), r AS (SELECT id FROM facts ORDER BY created_at DESC, id DESC LIMIT 5)
SELECT query_id, id, false AS fallback FROM found UNION ALL SELECT q.query_id, r.id, true FROM (SELECT DISTINCT episode_id AS query_id FROM facts WHERE episode_id NOT IN (SELECT query_id FROM found)) q, r""")
def recents_fallback(spark, sf):
    f = T.facts(spark, sf)
    found = f.filter("importance > 0.7 and episode_id % 3 = 0").select(F.col("episode_id").alias("query_id"), "id")
    return lifecycle.with_fallback(found, f.select(F.col("episode_id").alias("query_id")), f, 5)


@query("""WITH m AS (SELECT * FROM (""" + MENTIONS.split(" AS (", 1)[1][:-1].replace(" WHERE o_orderkey <= 4000", "") + """))
SELECT lower(trim(name)) AS normalized_name, entity_type, arg_min(name, seq) AS name, count(*) AS mention_count FROM m GROUP BY 1, 2""")
def entity_upsert_by_type(spark, sf):
    return graph.upsert_entities_by_type(mentions(spark, sf, "true"))


@query("""WITH m AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS seq, l_suppkey AS source, l_partkey % 20 AS target, l_returnflag AS relation_type, l_discount AS confidence, l_orderkey AS fact_id FROM lineitem)
SELECT source, target, relation_type, max(confidence) AS confidence, arg_max(fact_id, seq) AS fact_id FROM m GROUP BY ALL""")
def relation_latest(spark, sf):
    e = T.read(spark, sf, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("seq"), F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 20).alias("target"), F.col("l_returnflag").alias("relation_type"), F.col("l_discount").alias("confidence"), F.col("l_orderkey").alias("fact_id"))
    return graph.latest_relations(e)


@query(f"WITH {GRAPH} SELECT source, target, relation_type, source LIKE '%7' AND relation_type = 'lives_in' AS is_obsolete FROM relations")
def edges_marked_obsolete(spark, sf):
    _, r = T.whole_graph(spark, sf)
    return graph.mark_obsolete(r, r.filter("source like '%7' and relation_type = 'lives_in'")).select("source", "target", "relation_type", "is_obsolete")


@query(f"""WITH RECURSIVE {GRAPH}, {T.ENTITY_FACTS_SQL}, both_ways AS (SELECT source AS a, target AS b FROM relations UNION SELECT target, source FROM relations),
w AS (SELECT 'customer:1' AS entity, 0 AS hops UNION SELECT b, hops + 1 FROM w JOIN both_ways ON a = entity WHERE hops < 2)
SELECT fact_id, min(hops) AS hops, round(0.3e0 / (min(hops) + 1), 6) AS boost FROM w JOIN entity_facts USING (entity) GROUP BY fact_id""")
def graph_path_boost(spark, sf):
    _, r = T.whole_graph(spark, sf)
    return graph.path_boosts(r, T.entity_facts(spark, sf), nodes(spark, "customer:1")).withColumn("boost", F.round("boost", 6))


@query(f"""WITH {FACTS}, {GRAPH} SELECT (SELECT count(*) FROM facts) AS facts, (SELECT count(*) FROM facts WHERE NOT is_obsolete) AS active, (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM relations) AS relations, (SELECT count(*) FROM relations WHERE source NOT LIKE '%7') AS active_relations""")
def retriever_stats(spark, sf):
    e, r = T.whole_graph(spark, sf)
    f = T.facts(spark, sf).agg(F.count("*").alias("facts"), F.count_if(~F.col("is_obsolete")).alias("active"))
    n = r.agg(F.count("*").alias("relations"), F.count_if(~F.col("source").endswith("7")).alias("active_relations"))
    return f.crossJoin(F.broadcast(e.agg(F.count("*").alias("entities")))).crossJoin(F.broadcast(n))


@query(f"""WITH {FACTS}, p AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY created_at DESC, id DESC) - 1 AS i, count(*) OVER (PARTITION BY episode_id) AS n FROM facts)
SELECT id, round(0.5e0 * importance + 0.3e0 * exp(-ln(2e0) * greatest({HOURS.format(c='created_at')}, 0e0) / 168e0) + 0.2e0 * (1 - i / CAST(n AS DOUBLE)), 6) AS weight FROM p WHERE importance >= 0.1e0""")
def compress_weights(spark, sf):
    by = Window.partitionBy("episode_id")
    f = T.facts(spark, sf).withColumns({"i": F.row_number().over(by.orderBy(F.desc("created_at"), F.desc("id"))) - 1, "n": F.count("*").over(by)}).filter("importance >= 0.1")
    return f.select("id", F.round(R.compress_weight(F.col("importance"), R.hours_between(T.now(), F.col("created_at")), F.col("i"), F.col("n")), 6).alias("weight"))


@query(f"""WITH {FACTS}, m AS (SELECT id, importance, access_count, max(importance) OVER (PARTITION BY episode_id) AS a, max(access_count) OVER (PARTITION BY episode_id) AS b FROM facts)
SELECT id, round(0.6e0 * CASE WHEN a > 0 THEN importance / a ELSE 0 END + 0.4e0 * CASE WHEN b > 0 THEN access_count / CAST(b AS DOUBLE) ELSE 0 END, 6) AS score FROM m""")
def max_normalised_fusion(spark, sf):
    own = ["episode_id"]
    return T.facts(spark, sf).select("id", F.round(R.max_normalised(F.col("importance"), own) * 0.6 + R.max_normalised(F.col("access_count"), own) * 0.4, 6).alias("score"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic")
def corpus_label_counts(spark, sf):
    return T.read(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def corpus_by_label(spark, sf):
    return T.read(spark, sf, "documents").join(T.read(spark, sf, "labels").filter("quality = 1").select("doc_id"), "doc_id").select("doc_id", "lang")


@query("SELECT doc_id, sha1(text) AS summary_key, sha256(text || source || lang) AS request_key FROM documents")
def cache_keys(spark, sf):
    t = F.col("text")
    return T.read(spark, sf, "documents").select("doc_id", X.summary_key(t).alias("summary_key"), X.request_key(t, F.col("source"), F.col("lang")).alias("request_key"))


@query("SELECT user_id, round(count(*) FILTER (WHERE event_type = 'view') / CAST(count(*) AS DOUBLE), 6) AS hit_rate FROM events GROUP BY user_id")
def cache_hit_rate(spark, sf):
    hit = F.col("event_type") == "view"
    return T.read(spark, sf, "events").groupBy("user_id").agg(F.round(metrics.hit_rate(F.count_if(hit), F.count_if(~hit)), 6).alias("hit_rate"))
