"""Life cycle, packing, sessions, streams and measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import metrics
from ..functions import scoring as R
from ..functions import text as X
from ..operators import episodes, lifecycle, pack, topk
from ..sources import tables as T
from ..streaming import ingest
from .registry import literal, query, whole

FACTS, MEMORIES = T.FACTS_SQL, T.MEMORIES_SQL
HOURS = "(epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch({c})) / 3600e0"


@query(f"WITH {FACTS} SELECT id, round(exp(-ln(2e0) * greatest({HOURS.format(c='last_accessed')}, 0e0) / 168e0), 6) AS recency, round(exp(-0.693e0 * {HOURS.format(c='created_at')} / 24e0), 6) AS decayed FROM facts")
def recency_decay(spark, sf):
    f = T.facts(spark, sf)
    return f.select("id", F.round(R.half_life(R.hours_between(T.now(), F.col("last_accessed"))), 6).alias("recency"), F.round(R.decay(R.hours_between(T.now(), F.col("created_at"))), 6).alias("decayed"))


@query(f"WITH {FACTS} SELECT id, round(CASE WHEN access_count <= 0 THEN 0e0 ELSE least(1e0, ln(1e0 + access_count) / ln(101e0)) END, 6) AS boost FROM facts")
def access_boost(spark, sf):
    return T.facts(spark, sf).select("id", F.round(R.access_boost(F.col("access_count")), 6).alias("boost"))


@query(f"""WITH {FACTS}, m AS (SELECT *, max(access_count) OVER () AS most FROM facts WHERE NOT is_obsolete)
SELECT id, round(0.25e0 * importance + 0.15e0 * power(0.5e0, {HOURS.format(c='created_at')} / 168e0) + 0.1e0 * access_count / greatest(most, 1), 6) AS score FROM m""")
def hybrid_score_a(spark, sf):
    f = T.facts(spark, sf).filter("not is_obsolete")
    most = F.broadcast(f.agg(F.max("access_count").alias("most")))
    age = R.hours_between(T.now(), F.col("created_at"))
    return f.crossJoin(most).select("id", F.round(F.col("importance") * 0.25 + F.pow(F.lit(0.5), age / 168) * 0.15 + F.col("access_count") * 0.1 / F.greatest(F.col("most"), F.lit(1)), 6).alias("score"))


@query(f"""WITH {FACTS}, s AS (SELECT id, sum(CAST(ceil(strlen(atomic_text) / 4e0) AS BIGINT)) OVER (PARTITION BY episode_id ORDER BY importance DESC, id ROWS UNBOUNDED PRECEDING) AS t FROM facts)
SELECT id, CAST(t AS BIGINT) AS running_tokens FROM s WHERE t <= 3000""")
def prefix_token_budget(spark, sf):
    return topk.within_budget(T.facts(spark, sf), X.tokens_ceil_bytes(F.col("atomic_text")), 3000, [F.desc("importance"), F.asc("id")], ["episode_id"]).select("id", "running_tokens")


@query("""WITH s AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS t FROM conversations)
SELECT conv_id, turn, CAST(t AS BIGINT) AS running FROM s WHERE t <= 800""")
def history_budget(spark, sf):
    return pack.history(T.turns(spark, sf), F.length("content"), 800, ["conv_id"], [F.desc("turn")]).select("conv_id", "turn", "running")


@query(f"""WITH RECURSIVE {FACTS}, r AS (SELECT episode_id, id, CAST(ceil(strlen(atomic_text) / 4e0) AS BIGINT) AS t, row_number() OVER (PARTITION BY episode_id ORDER BY importance DESC, id) AS rn FROM facts WHERE id < 500),
g AS (SELECT episode_id, rn, id, CASE WHEN t <= 1500 THEN t ELSE 0 END AS used, t <= 1500 AS taken FROM r WHERE rn = 1
  UNION ALL SELECT r.episode_id, r.rn, r.id, CASE WHEN g.used + r.t <= 1500 THEN g.used + r.t ELSE g.used END, g.used + r.t <= 1500 FROM g JOIN r ON r.episode_id = g.episode_id AND r.rn = g.rn + 1)
SELECT episode_id, id FROM g WHERE taken""")
def greedy_skip_pack(spark, sf, some="id < 500"):
    f = T.facts(spark, sf).filter(some)
    return pack.greedy_skip(f, "episode_id", F.struct((-F.col("importance")).alias("i"), "id"), X.tokens_ceil_bytes(F.col("atomic_text")), 1500, ["id"]).select("episode_id", "id")


whole(greedy_skip_pack, " WHERE id < 500", "true")


@query()
def near_dup_drop(spark, sf):
    f = T.facts(spark, sf)
    return pack.near_dup_drop(f, "episode_id", F.col("id"), F.array_distinct(X.fields(F.lower("atomic_text"))), ["id"]).select("episode_id", "id")


@query()
def shuffled_tail_pack(spark, sf):
    f = T.facts(spark, sf).select("episode_id", "id", F.col("importance").alias("score"), X.tokens_ceil_bytes(F.col("atomic_text")).alias("tokens"))
    return pack.shuffled_tail(f, "episode_id", "tokens", 3000)


@query("""WITH w AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) SELECT source, doc_id, CAST(rn AS INTEGER) AS rank FROM w WHERE rn <= 3""")
def top_n_chunks_per_source(spark, sf):
    return pack.first_n_per(T.read(spark, sf, "documents"), ["source"], [F.desc("n_chars"), F.asc("doc_id")], 3).select("source", "doc_id", "rank")


def log_of(spark, sf):
    """A log with two states of every third fact and a deletion of every tenth."""
    f = T.facts(spark, sf).select("id", "importance")
    first = f.select("id", F.col("id").alias("seq"), F.lit("insert").alias("op"), "importance")
    second = f.filter("id % 3 = 0").select("id", (F.col("id") + 1_000_000).alias("seq"), F.lit("update").alias("op"), (F.col("importance") / 2).alias("importance"))
    return first.unionByName(second).unionByName(f.filter("id % 10 = 0").select("id", (F.col("id") + 2_000_000).alias("seq"), F.lit("delete").alias("op"), "importance"))


@query(f"WITH {FACTS} SELECT id, CASE WHEN id % 3 = 0 THEN 'update' ELSE 'insert' END AS op, CASE WHEN id % 3 = 0 THEN importance / 2 ELSE importance END AS importance FROM facts WHERE id % 10 <> 0")
def latest_state_view(spark, sf):
    return lifecycle.latest(log_of(spark, sf)).select("id", "op", "importance")


RAW = [(1, "  a fact  ", None, "", -1.0), (2, "b", "  atom ", "event", 2.0), (3, "   ", None, None, 0.5), (4, "d", "", "belief", 0.25), (5, "e", "x", None, None)]


@query("""SELECT * FROM (VALUES (1, 'a fact', 'a fact', 'other', 0.5e0), (2, 'b', 'atom', 'event', 1e0), (4, 'd', 'd', 'belief', 0.25e0), (5, 'e', 'x', 'other', 0.5e0)) t(id, fact_text, atomic_text, category, importance)""")
def insert_normalize(spark, sf):
    return lifecycle.insert_rules(spark.createDataFrame(RAW, "id int, fact_text string, atomic_text string, category string, importance double"))


def normalized_facts(spark, sf):
    return lifecycle.insert_rules(T.facts(spark, sf).select("id", "fact_text", "atomic_text", "category", "importance"))


literal(insert_normalize, normalized_facts)


@query(f"WITH {FACTS} SELECT id, id % 7 = 0 AS is_obsolete, CASE WHEN id % 7 = 0 THEN id + 1 END AS superseded_by FROM facts")
def supersede_chain(spark, sf):
    f = T.facts(spark, sf).select("id")
    log = f.select("id", F.lit(1).cast("long").alias("seq"), F.lit("insert").alias("op"), F.lit(False).alias("is_obsolete"), F.lit(None).cast("long").alias("superseded_by"))
    changes = f.filter("id % 7 = 0").select(F.col("id").alias("old_id"), (F.col("id") + 1).alias("new_id"), F.lit(2).cast("long").alias("seq"))
    return lifecycle.latest(lifecycle.supersede(log, changes)).select("id", "is_obsolete", "superseded_by")


@query(f"""WITH {FACTS}, a AS (SELECT user_id * 2 AS fact_id, count(*) AS n, max(ts) AS t FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT f.id, CAST(f.access_count + coalesce(a.n, 0) AS BIGINT) AS access_count, CAST(floor(epoch(greatest(f.last_accessed, coalesce(a.t, f.last_accessed)))) AS BIGINT) AS last_s FROM facts f LEFT JOIN a ON a.fact_id = f.id""")
def access_rollup(spark, sf):
    log = T.read(spark, sf, "events").filter("event_type = 'view'").select((F.col("user_id") * 2).alias("fact_id"), F.col("ts").cast("timestamp").alias("ts"))
    return lifecycle.touch(T.facts(spark, sf), log).select("id", F.col("access_count").cast("long").alias("access_count"), F.unix_timestamp("last_accessed").alias("last_s"))


@query(f"""WITH {FACTS} (SELECT id, is_obsolete FROM facts WHERE is_obsolete ORDER BY created_at DESC, id DESC LIMIT 50) UNION ALL (SELECT id, is_obsolete FROM facts WHERE NOT is_obsolete ORDER BY importance DESC, access_count DESC, created_at DESC, id DESC LIMIT 200)""")
def prune_keep_set(spark, sf):
    return lifecycle.prune_keep(T.facts(spark, sf), 100, 200).select("id", "is_obsolete")


@query(f"""WITH {FACTS}, a AS (SELECT * FROM facts WHERE NOT is_obsolete), x AS (SELECT count(*) - 100 AS excess FROM a),
n AS (SELECT * FROM a QUALIFY row_number() OVER (ORDER BY created_at DESC, id DESC) <= 4 * (SELECT excess FROM x)),
w AS (SELECT id, importance, 0.5e0 * importance + 0.3e0 * exp(-ln(2e0) * greatest({HOURS.format(c='created_at')}, 0e0) / 168e0) + 0.2e0 * CASE WHEN access_count <= 0 THEN 0e0 ELSE least(1e0, ln(1e0 + access_count) / ln(101e0)) END AS weight FROM n),
r AS (SELECT * FROM w QUALIFY row_number() OVER (ORDER BY weight, id) <= (SELECT excess FROM x)) SELECT id, round(weight, 6) AS weight FROM r WHERE importance < 0.35e0""")
def soft_prune_set(spark, sf):
    return lifecycle.soft_prune(T.facts(spark, sf), T.now(), 100, 0.35).select("id", F.round("weight", 6).alias("weight"))


@query(f"""WITH {MEMORIES}, o AS (SELECT * FROM memories WHERE NOT compressed AND created_at < TIMESTAMP '2024-01-01 05:00:00' ORDER BY created_at, id LIMIT 100)
SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY created_at, id) AS ids, CAST(epoch(min(created_at)) AS BIGINT) AS start_s, CAST(epoch(max(created_at)) AS BIGINT) AS end_s, CAST(sum(token_count) AS BIGINT) AS token_count, string_agg(text, ' | ' ORDER BY created_at, id) AS summary FROM o HAVING count(*) >= 5""")
def compress_block(spark, sf):
    out = lifecycle.compress_block(T.memories(spark, sf), F.lit("2024-01-01 05:00:00").cast("timestamp"))
    return out.select(F.array_join("source_ids", ",").alias("ids"), F.unix_timestamp("time_range_start").alias("start_s"), F.unix_timestamp("time_range_end").alias("end_s"), "token_count", "summary")


@query(f"WITH {FACTS} SELECT count(*) AS total, count(*) FILTER (WHERE NOT is_obsolete) AS active, count(*) FILTER (WHERE is_obsolete) AS obsolete, count(DISTINCT episode_id) AS episodes, round(avg(importance) FILTER (WHERE NOT is_obsolete), 6) AS avg_importance FROM facts")
def fact_stats(spark, sf):
    return lifecycle.fact_stats(T.facts(spark, sf)).withColumn("avg_importance", F.round("avg_importance", 6))


@query(f"WITH {FACTS} SELECT category, count(*) AS n FROM facts WHERE NOT is_obsolete GROUP BY category")
def facts_by_category(spark, sf):
    return T.facts(spark, sf).filter("not is_obsolete").groupBy("category").agg(F.count("*").alias("n"))


@query(f"WITH {MEMORIES} SELECT count(*) AS total, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS tokens, count(*) FILTER (WHERE compressed) AS compressed, round(coalesce(avg(CASE WHEN compressed THEN 1e0 ELSE 0e0 END), 0), 6) AS compression_ratio FROM memories")
def memory_stats(spark, sf):
    return lifecycle.memory_stats(T.memories(spark, sf)).withColumn("compression_ratio", F.round("compression_ratio", 6))


@query(f"WITH {FACTS} SELECT id FROM facts WHERE category = 'event' AND NOT is_obsolete ORDER BY importance DESC, created_at DESC, id DESC LIMIT 20")
def category_filter(spark, sf):
    return T.facts(spark, sf).filter("category = 'event' and not is_obsolete").orderBy(F.desc("importance"), F.desc("created_at"), F.desc("id")).limit(20).select("id")


@query(f"WITH {FACTS} SELECT id FROM facts WHERE created_at BETWEEN TIMESTAMP '2024-01-01 01:00:00' AND TIMESTAMP '2024-01-01 03:00:00' ORDER BY created_at DESC, id DESC LIMIT 50")
def time_range_filter(spark, sf):
    return lifecycle.recent(T.facts(spark, sf).filter("created_at between timestamp '2024-01-01 01:00:00' and timestamp '2024-01-01 03:00:00'"), 50).select("id")


@query(f"WITH {FACTS} SELECT id FROM facts WHERE NOT is_obsolete ORDER BY created_at DESC, id DESC LIMIT 20")
def recent_facts(spark, sf):
    return lifecycle.recent(T.facts(spark, sf).filter("not is_obsolete"), 20).select("id")


@query(f"WITH {MEMORIES} SELECT id FROM memories ORDER BY created_at DESC, id DESC LIMIT 10")
def recent_memories(spark, sf):
    return lifecycle.recent(T.memories(spark, sf), 10).orderBy("created_at", "id").select("id")


@query(f"WITH {FACTS} SELECT id FROM facts WHERE episode_id = 7")
def episode_facts(spark, sf):
    return T.facts(spark, sf).filter("episode_id = 7").orderBy("created_at", "id").select("id")


@query(f"WITH {FACTS} SELECT id FROM facts WHERE id IN (3, 5, 8, 13, 21)")
def multi_get(spark, sf):
    return T.facts(spark, sf).filter(F.col("id").isin(3, 5, 8, 13, 21)).select("id")


@query(f"WITH {FACTS} SELECT id FROM facts WHERE NOT is_obsolete AND id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 = 0)")
def summary_pending(spark, sf):
    f = T.facts(spark, sf)
    return lifecycle.summary_pending(f, f.filter("id % 4 = 0").select(F.col("id").alias("fact_id"))).select("id")


@query(f"""WITH {FACTS}, n AS (SELECT * FROM facts WHERE NOT is_obsolete ORDER BY created_at DESC, id DESC LIMIT 50)
SELECT string_agg('- ' || atomic_text, chr(10) ORDER BY created_at, id) AS summary, count(*) AS n_facts FROM n""")
def rolling_summary(spark, sf):
    return lifecycle.rolling_summary(T.facts(spark, sf))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS started_us, CAST(epoch_us(max(ts)) AS BIGINT) AS ended_us, count(*) AS n FROM s GROUP BY user_id, sid""")
def episodes_30min(spark, sf):
    ev = T.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return episodes.sessions(ev).select("user_id", F.unix_micros("started_at").alias("started_us"), F.unix_micros("ended_at").alias("ended_us"), "n")


@query(f"WITH {T.ENTITY_FACTS_SQL} SELECT fact_id % 50 AS episode_id, entity, count(*) AS n FROM entity_facts GROUP BY ALL")
def episode_entity_mentions(spark, sf):
    return episodes.entity_mentions(T.entity_facts(spark, sf).withColumn("episode_id", F.col("fact_id") % 50))


@query(f"""WITH {FACTS} SELECT episode_id, count(*) AS n_facts, string_agg('- ' || coalesce(atomic_text, ''), chr(10) ORDER BY created_at, id) AS summary FROM facts GROUP BY episode_id""")
def episode_summary(spark, sf):
    return episodes.summaries(T.facts(spark, sf))


@query("WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) SELECT conv_id, turn FROM r WHERE back <= 3")
def turn_ring_last_n(spark, sf):
    return lifecycle.last_per_group(T.turns(spark, sf), ["conv_id"], [F.desc("turn")], 3).select("conv_id", "turn")


@query("""SELECT conv_id, string_agg(upper(left(role, 1)) || substr(role, 2) || ': ' || text, chr(10) ORDER BY turn) AS conversation FROM conversations GROUP BY conv_id""")
def conversation_format(spark, sf):
    return episodes.formatted(T.turns(spark, sf))


def _windowed(spark, sf, length, slide=None):
    ev = T.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.tumbling(ev, length, slide).select(F.unix_timestamp("w.start").alias("start_s"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, sf):
    return _windowed(spark, sf, "1 hour")


@query("""WITH w AS (SELECT CAST(epoch(time_bucket(INTERVAL 30 MINUTE, ts)) AS BIGINT) - 1800 * k AS start_s, event_type, value FROM events, (VALUES (0), (1)) o(k))
SELECT start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""")
def sliding_counts(spark, sf):
    return _windowed(spark, sf, "1 hour", "30 minutes")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)
SELECT user_id, CAST(sum(new) AS BIGINT) AS sessions FROM g GROUP BY user_id""")
def session_counts(spark, sf):
    ev = T.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return episodes.sessions(ev, gap="2 hours").groupBy("user_id").agg(F.count("*").alias("sessions"))


@query("""SELECT conv_id, turn, CAST(length(text) // 4 AS BIGINT) AS token_count, round(least(1e0, 0.5e0 + CASE WHEN contains(text, '?') THEN 0.1e0 ELSE 0 END + CASE WHEN strlen(text) > 200 THEN 0.1e0 ELSE 0 END + CASE WHEN role = 'assistant' THEN 0.1e0 ELSE 0 END
 + 0.05e0 * len(list_filter(['important', 'remember', 'key', 'critical', 'note', 'must'], lambda w: contains(lower(text), w)))), 6) AS importance_score FROM conversations WHERE trim(coalesce(text, '')) <> ''""")
def turn_importance(spark, sf):
    return ingest.prepared(T.turns(spark, sf)).select("conv_id", "turn", "token_count", "importance_score")


@query()
def stream_ingest_turns(spark, sf):
    """Turns through the streaming path: files in, micro-batches out, read back."""
    from ..sources.store import scratch

    base = scratch(spark, "turns")
    rows = T.turns(spark, sf)
    rows.write.mode("overwrite").parquet(f"{base}/in")
    ingest.ingest(spark, f"{base}/in", rows.schema, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("conv_id", "turn", "token_count", "importance_score")


M = "m AS (SELECT event_type AS operation, CAST(round(value * 1000) AS BIGINT) AS d FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY d) AS rn, count(*) OVER (PARTITION BY operation) AS n FROM m)"


def at_sql(place: str) -> str:
    return f"max(CASE WHEN rn = {place} THEN d END)"


@query(f"WITH {M} SELECT operation, max(n) AS n, round(avg(d), 4) AS mean, round(stddev_pop(d), 4) AS sd, {at_sql('least(n // 2, n - 1) + 1')} AS median, {at_sql('least(CAST(floor(n * 0.95e0) AS BIGINT), n - 1) + 1')} AS p95, {at_sql('least(CAST(floor(n * 0.99e0) AS BIGINT), n - 1) + 1')} AS p99 FROM r GROUP BY operation")
def latency_stats_upper(spark, sf):
    return metrics.upper(T.measurements(spark, sf)).withColumns({"mean": F.round("mean", 4), "sd": F.round("sd", 4)})


@query(f"WITH {M} SELECT operation, max(n) AS n, CAST(median(d) AS DOUBLE) AS median, {at_sql('CAST(ceil(n * 95 / 100e0) AS BIGINT)')} AS p95, {at_sql('CAST(ceil(n * 99 / 100e0) AS BIGINT)')} AS p99 FROM r GROUP BY operation")
def latency_stats_nearest_rank(spark, sf):
    return metrics.nearest_rank(T.measurements(spark, sf))


@query(f"WITH {M} SELECT operation, max(n) AS n, {at_sql('least(n * 50 // 100, n - 1) + 1')} AS p50, {at_sql('least(n * 95 // 100, n - 1) + 1')} AS p95, {at_sql('least(n * 99 // 100, n - 1) + 1')} AS p99 FROM r GROUP BY operation")
def latency_stats_integer(spark, sf):
    return metrics.integer(T.measurements(spark, sf))


@query("""SELECT CASE WHEN turn * 7 % 60 <= 10 THEN '0-10' WHEN turn * 7 % 60 <= 25 THEN '11-25' WHEN turn * 7 % 60 <= 50 THEN '26-50' ELSE '50+' END AS bucket, count(*) AS n, round(avg(CASE WHEN length(text) % 2 = 0 THEN 1e0 ELSE 0e0 END), 6) AS recall FROM conversations GROUP BY 1""")
def recall_by_distance(spark, sf):
    t = T.turns(spark, sf).select(metrics.distance_bucket(F.col("turn") * 7 % 60).alias("bucket"), (F.length("content") % 2 == 0).cast("int").alias("hit"))
    return t.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("recall"))


@query(f"""WITH {FACTS}, m AS (SELECT *, max({HOURS.format(c='created_at')}) OVER () AS top FROM facts) SELECT id, round(0.3e0 * (1 - {HOURS.format(c='created_at')} / top) + 0.7e0 * importance, 6) AS score FROM m""")
def sliding_rank(spark, sf):
    f = T.facts(spark, sf).withColumn("h", R.hours_between(T.now(), F.col("created_at")))
    top = F.broadcast(f.agg(F.when(F.max("h") == 0, 1.0).otherwise(F.max("h")).alias("top")))
    return f.crossJoin(top).select("id", F.round(R.sliding_rank(F.col("h"), F.col("top"), F.col("importance")), 6).alias("score"))


@query("""WITH r AS (SELECT conv_id, turn, length(text) AS score, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations), c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS rk FROM r WHERE score >= 150 OR back <= 2)
SELECT conv_id, turn FROM c WHERE rk <= 4""")
def relevant_turns(spark, sf):
    return pack.relevant_turns(T.turns(spark, sf).withColumn("score", F.length("content")), 150, 2, 4).select("conv_id", "turn")


@query("SELECT conv_id, right(string_agg(text, chr(10) ORDER BY turn), 400) AS transcript FROM conversations GROUP BY conv_id")
def transcript_cut(spark, sf):
    return pack.transcript(T.turns(spark, sf), 100)


@query(f"""WITH {FACTS}, s AS (SELECT id, episode_id, sum(strlen(atomic_text) // 4) OVER (PARTITION BY episode_id ORDER BY importance DESC, id ROWS UNBOUNDED PRECEDING) + 10 AS t FROM facts) SELECT episode_id, id, CAST(t AS BIGINT) AS used FROM s WHERE t <= 2000""")
def prompt_facts(spark, sf):
    return pack.prompt_facts(T.facts(spark, sf), "episode_id", [F.desc("importance"), F.asc("id")], 2000).select("episode_id", "id", "used")


@query("""SELECT event_type AS operation, count(*) AS runs, count(*) FILTER (WHERE value > 0) AS valid, count(*) FILTER (WHERE value <= 0) AS errors, round(count(*) FILTER (WHERE value <= 0) * 100e0 / count(*), 1) AS error_pct, round(avg(value) FILTER (WHERE value > 0), 4) AS mean FROM events GROUP BY 1""")
def run_summary(spark, sf):
    ev = T.read(spark, sf, "events").select(F.col("event_type").alias("operation"), "value")
    return metrics.summary(ev, "operation", "value")


@query("""WITH a AS (SELECT c.conv_id, c.turn, lower(c.text) AS t, b.words FROM conversations c, (SELECT ['the', 'of', 'thion', 'zzz'] AS words) b) SELECT conv_id, turn, contains(t, 'the of') AS exact, len(list_filter(words, lambda w: contains(t, w))) * 2 >= len(words) AS partial FROM a""")
def answer_match(spark, sf):
    answer = F.array(*[F.lit(w) for w in ("the", "of", "thion", "zzz")])
    return T.turns(spark, sf).select("conv_id", "turn", X.answer_contains(F.col("content"), F.lit("the of")).alias("exact"), X.answer_partial(F.col("content"), answer).alias("partial"))
