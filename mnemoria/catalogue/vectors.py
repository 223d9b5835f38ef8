"""Vector search, ANN and retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as R
from ..functions import text as X
from ..functions import vector as V
from ..operators import ann, lifecycle, pack, topk
from ..operators.vector_index import VectorIndex
from ..plans import retrieve
from ..sources import store
from ..sources import tables as T
from .registry import query, whole


def q_vec(spark, sf, vec_id=0):
    """The vector of one row as a literal."""
    row = T.read(spark, sf, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return F.array(*[F.lit(float(x)) for x in row[0]])


def q_table(spark, sf, cond="vec_id = 0"):
    return T.read(spark, sf, "embeddings").filter(cond).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def emb(spark, sf):
    return T.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
E_SQL = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE {cond})"


def scored_sql(cond: str, score: str, order: str, k: int, where: str = "true", keep: str = "query_id, id, score, rank") -> str:
    return f"""WITH {E_SQL.format(cond=cond)}, s AS (SELECT query_id, id, label, round({score}, 6) AS score, {score} AS raw FROM e, q),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {order}, id) AS INTEGER) AS rank FROM s WHERE {where}) SELECT {keep} FROM r WHERE rank <= {k}"""


CLAMP = "greatest(0e0, least(1e0, " + COS.format(a="v", b="qv") + "))"


@query(scored_sql("vec_id = 0", CLAMP, "raw DESC", 10, keep="id AS vec_id, label, score"))
def semantic_topk(spark, sf):
    out = topk.exact_topk(emb(spark, sf), q_table(spark, sf), 10)
    return out.select(F.col("id").alias("vec_id"), "label", F.round("score", 6).alias("score"))


@query(scored_sql("vec_id % 25 = 0", CLAMP, "raw DESC", 10))
def semantic_topk_batch(spark, sf):
    return topk.exact_topk(emb(spark, sf).drop("label"), q_table(spark, sf, "vec_id % 25 = 0"), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(scored_sql("vec_id < 5", COS.format(a="v", b="qv"), "raw DESC", 15))
def cosine_unclamped_topk(spark, sf, asked="vec_id < 5"):
    return topk.exact_topk(emb(spark, sf).drop("label"), q_table(spark, sf, asked), 15, V.cosine).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


whole(cosine_unclamped_topk, "vec_id < 5", "vec_id % 100 = 0", "vec_id % 100 = 0")


@query(scored_sql("vec_id < 5", COS.format(a="v", b="qv"), "raw DESC", 1000000, "score >= 0.2e0", "query_id, id, score"))
def cosine_both_norms_min_score(spark, sf, asked="vec_id < 5"):
    e, q, most = emb(spark, sf).drop("label"), q_table(spark, sf, asked), 1_000_000
    ranked = e.count() > most  # else no query can have more
    out = topk.exact_topk(e, q, most, V.cosine, 0.2, digits=6) if ranked else topk.within(e, q, 0.2, V.cosine, digits=6)
    return out.select("query_id", "id", "score")


whole(cosine_both_norms_min_score, "vec_id < 5", "vec_id % 100 = 0", "vec_id % 100 = 0")


@query(scored_sql("vec_id < 5", "list_sum(list_transform(list_zip(v, qv), lambda p: (p[1] - p[2]) * (p[1] - p[2])))", "raw", 10))
def l2_topk(spark, sf, asked="vec_id < 5"):
    return topk.exact_topk(emb(spark, sf).drop("label"), q_table(spark, sf, asked), 10, V.l2_squared, ascending=True).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


whole(l2_topk, "vec_id < 5", "vec_id % 100 = 0", "vec_id % 100 = 0")


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS l FROM e)
SELECT vec_id, round(l, 6) AS norm, round(v[1] / l, 6) AS x1, round(v[2] / l, 6) AS x2 FROM n""")
def normalize_vectors(spark, sf):
    n = V.normalize(F.col("embedding"))
    return T.read(spark, sf, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(F.get(n, F.lit(0)), 6).alias("x1"), F.round(F.get(n, F.lit(1)), 6).alias("x2"))


def pool_sql(pool: int, k: int, minimum: str = "-2e0") -> str:
    return f"""WITH {T.FACTS_SQL}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = 0),
    p AS (SELECT f.id, f.importance, f.created_at, CAST(v.embedding AS DOUBLE[]) AS v FROM facts f JOIN embeddings v ON v.vec_id = f.id WHERE NOT is_obsolete ORDER BY importance DESC, created_at DESC, id DESC LIMIT {pool}),
    s AS (SELECT id, {COS.format(a='v', b='qv')} AS raw FROM p, q) SELECT id, round(raw, 6) AS score FROM s WHERE raw >= {minimum} ORDER BY raw DESC, id LIMIT {k}"""


@query(pool_sql(50, 10))
def prefiltered_knn(spark, sf):
    f = T.facts(spark, sf, True).filter("not is_obsolete")
    return topk.prefiltered_topk(f, q_vec(spark, sf), 10, 50).select("id", F.round("score", 6).alias("score"))


@query(pool_sql(100, 10, "0.1e0"))
def importance_first_knn(spark, sf):
    f = T.facts(spark, sf, True).filter("not is_obsolete")
    return topk.prefiltered_topk(f, q_vec(spark, sf), 10, 100, min_score=0.1).select("id", F.round("score", 6).alias("score"))


PAGED_SQL = f"""WITH {T.MEMORIES_SQL}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = 0),
r AS (SELECT id, text, token_count, embedding, row_number() OVER (ORDER BY created_at DESC, id DESC) AS rn FROM memories WHERE NOT compressed),
s AS (SELECT id, text, token_count, rn, (rn - 1) // 200 AS page, {COS.format(a='embedding', b='qv')} AS raw FROM r, q WHERE rn <= 1000),
h AS (SELECT page, count(*) FILTER (WHERE raw >= 0.1e0) AS hits FROM s GROUP BY page),
b AS (SELECT page, coalesce(sum(hits) OVER (ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h),
t AS (SELECT s.id, s.token_count, s.raw FROM s JOIN b USING (page) WHERE before < 3 * {{k}} AND raw >= 0.1e0 ORDER BY raw DESC, id LIMIT {{k}})
"""


@query(PAGED_SQL.format(k=5) + "SELECT id, round(raw, 6) AS score FROM t")
def paged_recent_knn(spark, sf):
    return topk.paged_recent(T.memories(spark, sf), q_vec(spark, sf), 5, 0.1).select("id", F.round("score", 6).alias("score"))


@query(PAGED_SQL.format(k=50) + ", u AS (SELECT *, sum(token_count) OVER (ORDER BY raw DESC, id ROWS UNBOUNDED PRECEDING) AS total FROM t) SELECT id, round(raw, 6) AS score, CAST(total AS BIGINT) AS running_tokens FROM u WHERE total <= 5000")
def knn_token_budget(spark, sf):
    near = topk.paged_recent(T.memories(spark, sf), q_vec(spark, sf), 50, 0.1)
    return topk.within_budget(near, F.col("token_count"), 5000, [F.desc("score"), F.asc("id")]).select("id", F.round("score", 6).alias("score"), "running_tokens")


@query("""WITH x AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)
SELECT CAST(label AS INTEGER) AS label, CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS mean FROM x GROUP BY label, dim""")
def label_centroids(spark, sf):
    return topk.label_centroids(emb(spark, sf)).select("label", "dim", F.round("mean", 6).alias("mean"))


CENTROID_SQL = """x AS (SELECT label, generate_subscripts(embedding, 1) AS dim, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
m AS (SELECT label, dim, avg(x) AS mean FROM x GROUP BY label, dim), c AS (SELECT CAST(label AS INTEGER) AS cluster, list(mean ORDER BY dim) AS cv FROM m GROUP BY label)"""


@query(f"""WITH {CENTROID_SQL}, s AS (SELECT vec_id AS id, cluster, greatest(0e0, least(1e0, {COS.format(a='CAST(embedding AS DOUBLE[])', b='cv')})) AS score FROM embeddings, c),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, cluster) AS rn FROM s) SELECT id, cluster, round(score, 6) AS score FROM r WHERE rn = 1""")
def nearest_centroid_assign(spark, sf):
    c = topk.centroid_arrays(emb(spark, sf)).select(F.col("label").cast("int").alias("cluster"), "centroid")
    return ann.assign(emb(spark, sf).drop("label"), c).select("id", "cluster", F.round("score", 6).alias("score"))


def seed_rows(spark, sf):
    return emb(spark, sf).filter("id % 50 = 0 and id < 400").select((F.col("id") / 50).cast("int").alias("cluster"), F.transform("embedding", lambda x: x.cast("double")).alias("centroid"))


SEED_SQL = "c AS (SELECT CAST(vec_id // 50 AS INTEGER) AS cluster, CAST(embedding AS DOUBLE[]) AS cv FROM embeddings WHERE vec_id % 50 = 0 AND vec_id < 400), " + f"""
s AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, cluster, greatest(0e0, least(1e0, {COS.format(a='CAST(embedding AS DOUBLE[])', b='cv')})) AS score FROM embeddings, c),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, cluster) AS rn FROM s), p AS (SELECT id, v, cluster, score FROM r WHERE rn = 1)"""


@query(f"WITH {SEED_SQL} SELECT id, cluster, round(score, 6) AS score FROM p")
def ivf_assign_fixed_seeds(spark, sf):
    return ann.assign(emb(spark, sf).drop("label"), seed_rows(spark, sf)).select("id", "cluster", F.round("score", 6).alias("score"))


PROBE_SQL = SEED_SQL + f""", q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 40 = 1),
n AS (SELECT query_id, qv, cluster, row_number() OVER (PARTITION BY query_id ORDER BY {COS.format(a='qv', b='cv')} DESC, cluster) AS rn FROM q, c),
z AS (SELECT query_id, id, round(greatest(0e0, least(1e0, {COS.format(a='v', b='qv')})), 6) AS score FROM p JOIN n USING (cluster) WHERE n.rn <= 3),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM z)"""


def _probe(spark, sf):
    e, c = emb(spark, sf).drop("label"), seed_rows(spark, sf)
    postings = e.join(ann.assign(e, c).select("id", "cluster"), "id")
    return ann.probe(postings, c, q_table(spark, sf, "vec_id % 40 = 1"), 3, 10)


@query(f"WITH {PROBE_SQL} SELECT query_id, id, score, rank FROM t WHERE rank <= 10")
def ivf_probe_topk(spark, sf):
    return _probe(spark, sf).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {PROBE_SQL}, x AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(greatest(0e0, least(1e0, {COS.format(a='v', b='qv')})), 6) DESC, id) AS INTEGER) AS rank FROM p, q)
SELECT x.query_id, round(avg(CASE WHEN t.id IS NULL THEN 0e0 ELSE 1e0 END), 6) AS recall, max(CASE WHEN x.rank = 1 AND t.rank = 1 THEN 1 ELSE 0 END) AS top1
FROM x LEFT JOIN (SELECT * FROM t WHERE rank <= 10) t ON t.query_id = x.query_id AND t.id = x.id WHERE x.rank <= 10 GROUP BY x.query_id""")
def ivf_recall_vs_exact(spark, sf):
    exact = topk.exact_topk(emb(spark, sf).drop("label"), q_table(spark, sf, "vec_id % 40 = 1"), 10, digits=6)
    return ann.recall(_probe(spark, sf), exact).select("query_id", F.round("recall", 6).alias("recall"), "top1")


@query()
def ivf_trained_topk(spark, sf):
    """Lloyd rounds from evenly spaced seeds, then a probe: iterative, so rows only."""
    e = emb(spark, sf).drop("label")
    c = ann.train(e, 16, 4)
    postings = e.join(ann.assign(e, c).select("id", "cluster"), "id")
    return ann.probe(postings, c, q_table(spark, sf, "vec_id % 40 = 1"), 4, 10)


@query()
def pq_encode(spark, sf):
    e = emb(spark, sf).drop("label")
    codes = ann.encode(e, ann.codebook(e, 8, 4), 8)
    return codes.select("id", F.array_join(F.transform("codes", lambda x: x.cast("string")), ",").alias("codes"), F.round("distortion", 6).alias("distortion"))


@query()
def pq_adc_topk(spark, sf):
    e = emb(spark, sf).drop("label")
    book = ann.codebook(e, 8, 4)
    scored = ann.adc_score(ann.encode(e, book, 8), book, q_table(spark, sf).select("query"), 8)
    return scored.orderBy(F.desc("score"), "id").limit(10).select("id", F.round("score", 6).alias("score"))


def _two_stages(spark, sf):
    """An index of two thirds of the vectors, the others upserted; a search probes as many lists as each query needs."""
    e = emb(spark, sf).drop("label")
    index = VectorIndex.create(spark, store.scratch(spark, "vector-index"), e.filter("id % 3 <> 0"), train_min=256)
    return index.upsert(e.filter("id % 3 = 0")).search(q_table(spark, sf, "vec_id % 40 = 1"), 10)


@query()
def ann_two_stage_topk(spark, sf):
    """Trained centroids and codes, so rows only; tests hold it to a recall of 0.9."""
    return _two_stages(spark, sf).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query()
def ann_two_stage_recall(spark, sf):
    exact = topk.exact_topk(emb(spark, sf).drop("label"), q_table(spark, sf, "vec_id % 40 = 1"), 10, digits=6)
    return ann.recall(_two_stages(spark, sf), exact).select("query_id", F.round("recall", 6).alias("recall"), "top1")


@query(f"WITH {SEED_SQL} SELECT cluster, count(*) AS n FROM p GROUP BY cluster")
def ann_index_stats(spark, sf):
    return ann.index_stats(ann.assign(emb(spark, sf).drop("label"), seed_rows(spark, sf)))


UPDATE_SQL = f"""WITH {E_SQL.format(cond='vec_id % 60 = 7')}, s AS (SELECT query_id, id, {CLAMP} AS score FROM e, q WHERE id % 60 <> 7), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM s)
SELECT query_id AS fact_id, id AS best_id, round(score, 6) AS best_score, CASE WHEN score < 0.5e0 THEN 'ADD' WHEN score >= 0.85e0 THEN 'UPDATE' ELSE 'COMPARE' END AS decision FROM r WHERE rn = 1"""


@query(UPDATE_SQL)
def update_decision_candidates(spark, sf):
    e = emb(spark, sf).drop("label")
    out = lifecycle.update_decisions(e.filter("id % 60 = 7"), e.filter("id % 60 <> 7"))
    return out.select("fact_id", "best_id", F.round("best_score", 6).alias("best_score"), "decision")


def bench_queries(spark, sf, some="true"):
    """Query texts from the benchmark table, each with the vector of the same number."""
    b = T.read(spark, sf, "benchmark").filter(some)
    return b.join(T.read(spark, sf, "embeddings"), F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), "text", F.col("embedding").alias("query"))


@query(f"""WITH {T.FACTS_SQL}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = 0),
p AS (SELECT f.*, CAST(v.embedding AS DOUBLE[]) AS v FROM facts f JOIN embeddings v ON v.vec_id = f.id WHERE NOT is_obsolete ORDER BY importance DESC, created_at DESC, id DESC LIMIT 200),
s AS (SELECT id, importance, created_at, access_count, {COS.format(a='v', b='qv')} AS sem FROM p, q ORDER BY sem DESC, id LIMIT 40),
t AS (SELECT id, round(sem * 0.5e0 + importance * 0.25e0 + 0.15e0 * power(0.5e0, (epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(created_at)) / 3600e0 / 168e0) + 0.1e0 * access_count / greatest(max(access_count) OVER (), 1), 6) AS score FROM s)
SELECT id, score FROM t WHERE score >= 0.3e0 ORDER BY score DESC, id LIMIT 20""")
def hybrid_retrieve_a(spark, sf):
    return retrieve.hybrid_a(T.facts(spark, sf, True), q_vec(spark, sf), T.now()).select("id", "score")


@query()
def rag_hybrid_retrieve(spark, sf):
    docs = T.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text").join(emb(spark, sf).drop("label"), "id")
    return retrieve.rag(docs, bench_queries(spark, sf), min_score=-1.0)


@query()
def mmr_select(spark, sf):
    rows = topk.exact_topk(emb(spark, sf).drop("label"), q_table(spark, sf, "vec_id % 100 = 0"), 30, V.cosine).withColumn("semantic", F.col("score"))
    return pack.mmr(rows.select("query_id", "id", "score", "semantic"), "query_id", 8)


@query(f"""WITH {T.MEMORIES_SQL}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = 0),
a AS (SELECT id, created_at, greatest(0.3e0, 1e0 - (row_number() OVER (ORDER BY {COS.format(a='embedding', b='qv')} DESC, id) - 1) * 0.1e0) AS rel FROM memories, q QUALIFY row_number() OVER (ORDER BY {COS.format(a='embedding', b='qv')} DESC, id) <= 10),
b AS (SELECT id, created_at, 0.5e0 AS rel FROM memories ORDER BY created_at DESC, id DESC LIMIT 10),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a))
SELECT id, round(rel * 0.7e0 + 0.3e0 / (1 + (epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(created_at)) / 3600e0), 6) AS score FROM u ORDER BY score DESC, id LIMIT 12""")
def merge_recent_and_retrieved(spark, sf):
    m = T.memories(spark, sf)
    near = topk.exact_topk(m.select("id", "embedding"), q_table(spark, sf), 10, V.cosine).select("id", "rank").join(m.select("id", "created_at"), "id")
    return retrieve.merge_recent(lifecycle.recent(m, 10), near, T.now(), 12).select("id", "score")


HYBRID_SQL = f"""WITH {T.FACTS_SQL}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = 0), s AS (
SELECT f.id, f.importance, f.access_count, (epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(f.last_accessed)) / 3600e0 AS h, greatest(0e0, least(1e0, {COS.format(a='CAST(v.embedding AS DOUBLE[])', b='qv')})) AS sem FROM facts f JOIN embeddings v ON v.vec_id = f.id, q WHERE NOT is_obsolete)
SELECT id, round(greatest(0e0, least(1e0, sem * 0.5e0 + importance * 0.15e0 + exp(-ln(2e0) * greatest(h, 0e0) / 168e0) * 0.1e0 + CASE WHEN access_count <= 0 THEN 0e0 ELSE least(1e0, ln(1e0 + access_count) / ln(101e0)) END * 0.05e0)), 6) AS score FROM s"""


@query(HYBRID_SQL)
def hybrid_score_b(spark, sf):
    f = T.facts(spark, sf, True).filter("not is_obsolete")
    sem = V.cosine_clamped(q_vec(spark, sf), F.col("embedding"))
    zero = F.lit(0.0)
    return f.select("id", F.round(R.hybrid_b(sem, zero, zero, zero, F.col("importance"), R.half_life(R.hours_between(T.now(), F.col("last_accessed"))), R.access_boost(F.col("access_count"))), 6).alias("score"))


@query(f"""WITH d AS (SELECT doc_id AS id, text FROM documents), q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = 0),
s AS (SELECT d.id, d.text, {COS.format(a='CAST(v.embedding AS DOUBLE[])', b='qv')} AS sem FROM d JOIN embeddings v ON v.vec_id = d.id, q),
w AS (SELECT id, sem, list_filter(regexp_split_to_array(lower(text), '[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'), lambda t: t <> '') AS words FROM s),
x AS (SELECT id, sem, len(words) AS n, list_transform(words, lambda t: trim(t, '.,!?;:"''()[]{{}}')) AS bare FROM w),
k AS (SELECT id, sem, n, len(list_filter(bare, lambda t: t = 'then')) AS a, len(list_filter(bare, lambda t: t = 'que')) AS b FROM x)
SELECT id, round(0.7e0 * sem + 0.2e0 * ((CASE WHEN a > 0 THEN a * 2.5e0 / (a + 1.5e0 * (0.25e0 + 0.75e0 * n / 100)) ELSE 0 END + CASE WHEN b > 0 THEN b * 2.5e0 / (b + 1.5e0 * (0.25e0 + 0.75e0 * n / 100)) ELSE 0 END) / 2) + 0.05e0, 6) AS score FROM k""")
def rag_combined_score(spark, sf):
    docs = T.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text").join(emb(spark, sf).drop("label"), "id")
    keyword = R.saturated_tf(F.array(F.lit("then"), F.lit("que")), F.col("text"))
    return docs.select("id", F.round(R.rag_combined(V.cosine(q_vec(spark, sf), F.col("embedding")), keyword), 6).alias("score"))


@query(f"""WITH {E_SQL.format(cond='vec_id < 20')}, s AS (SELECT query_id, id, {CLAMP} AS a, list_dot_product(v, qv) AS b FROM e, q),
x AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, id) AS ra, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, id) AS rb FROM s)
SELECT query_id, count(*) FILTER (WHERE ra <= 10 AND rb <= 10) / 10e0 AS overlap FROM x GROUP BY query_id""")
def overlap_at_k(spark, sf, asked="vec_id < 20"):
    e, q = emb(spark, sf).drop("label"), q_table(spark, sf, asked)
    a, b = topk.exact_topk(e, q, 10).select("query_id", "id"), topk.exact_topk(e, q, 10, V.dot).select("query_id", "id")
    return a.join(b.withColumn("hit", F.lit(1)), ["query_id", "id"], "left").groupBy("query_id").agg((F.count("hit") / 10).alias("overlap"))


whole(overlap_at_k, "vec_id < 20", "vec_id % 100 = 0", "vec_id % 100 = 0")


@query(f"WITH {T.FACTS_SQL} SELECT id, CAST(ceil(strlen(atomic_text) / 4e0) AS BIGINT) AS ceil_bytes, CAST(length(atomic_text) // 4 AS BIGINT) AS floor_chars, CAST(strlen(atomic_text) // 4 AS BIGINT) AS floor_bytes FROM facts")
def token_estimates(spark, sf):
    t = F.col("atomic_text")
    return T.facts(spark, sf).select("id", X.tokens_ceil_bytes(t).alias("ceil_bytes"), X.tokens_floor_chars(t).alias("floor_chars"), X.tokens_floor_bytes(t).alias("floor_bytes"))
