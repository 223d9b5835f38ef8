"""The driver's queries over the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import code_compression, line_dedup, mixing, ngram_join, packing, panes, quality_classifier, quality_rules, secret_scan, sharding, simhash_join, suffix_dedup, topk_search
from .common import read_table, sha256_of


def op1_soft_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of the labels table: poor (quality 0), toxic and good; as many tokens in all as there are."""
    labels = read_table(spark, sf_dir, "labels")
    domain = F.when(F.col("quality") == 0, "poor").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    targets = {"good": 0.9, "toxic": 0.04, "poor": 0.06}
    out = mixing.mix(docs, labels.select("doc_id", domain.alias("domain")), targets)
    return out.select("doc_id", "n_tokens", *[F.get("posterior", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(sorted(targets))], "rate", "copies")


def op2_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), path="source")


def op3_risk_controlled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = quality_rules.apply_rules(docs, read_table(spark, sf_dir, "labels"), alpha=0.03, delta=0.05, stratum="lang")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


def op4_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"), length=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_fourier_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_classifier.score_documents(docs, read_table(spark, sf_dir, "labels"), threshold=0.3)


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.assign_shards(docs, n_shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op7_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk_search.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5, scale=256.0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.drop_common_lines(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", sha256_of(F.col("text")).alias("kept_sha256"))


def op9_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"), window=1024)


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE k IN (SELECT k FROM common)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE k NOT IN (SELECT k FROM common)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id
"""

def op10_divide_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(read_table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, num=85, den=100)


def op11_byte_index_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_join.components(read_table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, max_bits=3)


def op12_segment_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return code_compression.compress(vectors, scale=1024.0, parts=4, entries=256, rounds=4)


def op13_pane_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panes.panes_with_revisions(read_table(spark, sf_dir, "clicks"), n_batches=12, due_hours=2, closed_hours=72)


def _op12_sql(rounds: int = 4) -> str:
    """A step for each round: assign parts to entries, then floor the means. Sums and products stay under 2**53, so doubles are exact."""
    steps = [r"""
kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, label, p, x, CAST(x AS DOUBLE[]) AS dx
  FROM (SELECT vec_id, label, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM kept, (SELECT unnest(range(4)) AS p))),
book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < 256)"""]
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
  SELECT vec_id, label, p, x, m % 256 AS e, m // 256 AS dist
  FROM (SELECT vec_id, any_value(label) AS label, parts.p, any_value(x) AS x,
               min(CAST(list_inner_product(dx, dx) - 2 * list_inner_product(dx, CAST(c AS DOUBLE[])) + list_inner_product(CAST(c AS DOUBLE[]), CAST(c AS DOUBLE[])) AS BIGINT) * 256 + e) AS m
        FROM parts JOIN book{r} ON parts.p = book{r}.p GROUP BY vec_id, parts.p))""")
        if r < rounds:
            steps.append(f"""
book{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c
  FROM book{r} b LEFT JOIN (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
    FROM (SELECT p, e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM near{r}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS i) GROUP BY p, e, i)
    GROUP BY p, e) m ON b.p = m.p AND b.e = m.e)""")
    return "WITH" + ",".join(steps) + f""",
coded AS (SELECT vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', CAST(e AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id),
said AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded, said
"""


OP12_SQL = _op12_sql()

#: CRC-32 is worked out bit by bit from the digits of the id.
OP13_SQL = r"""
WITH once AS (SELECT click_id, min({'ts': ts, 'arrived_at': coalesce(arrived_at, ts), 'kind': kind, 'value': value}) AS r FROM clicks WHERE ts IS NOT NULL GROUP BY click_id),
crc AS (
  SELECT click_id, r, xor(list_reduce(
      list_transform(string_split(CAST(click_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
      lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, z: xor(b >> 1, 3988292384 * (b & 1))), 4294967295), 4294967295) AS crc,
    date_diff('day', DATE '1970-01-01', CAST(r.arrived_at AS DATE)) AS d
  FROM once),
fed AS MATERIALIZED (
  SELECT click_id, least(11, d % 12 + greatest(0, crc % 30 - 23)) AS batch, epoch_us(r.ts) - (d - d % 12) * 86400000000 AS event,
    coalesce(r.kind, 'none') AS kind, CAST(coalesce(floor(100 * r.value + 0.5), 0) AS BIGINT) AS cents
  FROM crc),
batches AS (SELECT unnest(range(12)) AS batch),
marks AS MATERIALIZED (SELECT b.batch, max(f.event) AS w FROM batches b LEFT JOIN fed f ON f.batch < b.batch GROUP BY b.batch),
timed AS MATERIALIZED (
  SELECT f.*, CAST(floor(event / 3600000000.0) AS BIGINT) AS hour, w FROM fed f JOIN marks USING (batch)),
split AS MATERIALIZED (SELECT *, coalesce(w >= (hour + 73) * 3600000000, false) AS late FROM timed),
sums AS (SELECT hour, kind, batch, count(*) AS n, sum(cents) AS c FROM split WHERE NOT late GROUP BY ALL),
first_due AS (SELECT hour, kind, min(batch) AS seen FROM sums GROUP BY ALL),
emits AS MATERIALIZED (
  SELECT p.hour, p.kind, (SELECT min(m.batch) FROM marks m WHERE m.w >= (p.hour + 3) * 3600000000 AND m.batch >= p.seen) AS at FROM first_due p),
totals AS MATERIALIZED (
  SELECT *, sum(n) OVER w AS tn, sum(c) OVER w AS tc FROM sums WINDOW w AS (PARTITION BY hour, kind ORDER BY batch)),
out AS (
  SELECT batch, hour, click_id, 1 AS n_rows, cents, 'late' AS record, kind FROM split WHERE late
  UNION ALL
  SELECT coalesce(e.at, 11), e.hour, -1, sum(s.n), sum(s.c), CASE WHEN e.at IS NULL THEN 'final' ELSE 'emit' END, e.kind
  FROM emits e JOIN sums s ON e.hour = s.hour AND e.kind = s.kind AND (e.at IS NULL OR s.batch <= e.at) GROUP BY ALL
  UNION ALL
  SELECT t.batch, t.hour, -1, unnest([t.tn - t.n, t.tn]), unnest([t.tc - t.c, t.tc]), unnest(['retract', 'replace']), t.kind
  FROM totals t JOIN emits e ON e.hour = t.hour AND e.kind = t.kind AND t.batch > e.at)
SELECT CAST(batch AS BIGINT) AS batch, hour, click_id, CAST(n_rows AS BIGINT) AS n_rows, CAST(cents AS BIGINT) AS cents, record, kind FROM out
"""


QUERIES = {
    "op1_soft_mixture": op1_soft_mixture,
    "op2_forest_secrets": op2_forest_secrets,
    "op3_risk_controlled": op3_risk_controlled,
    "op4_prefix_free_parsing": op4_prefix_free_parsing,
    "op5_fourier_ridge": op5_fourier_ridge,
    "op6_virtual_slots": op6_virtual_slots,
    "op7_ball_tree": op7_ball_tree,
    "op8_line_dedup": op8_line_dedup,
    "op10_divide_skip": op10_divide_skip,
    "op9_min_bin_slack": op9_min_bin_slack,
    "op11_byte_index_simhash": op11_byte_index_simhash,
    "op12_segment_means": op12_segment_means,
    "op13_pane_revisions": op13_pane_revisions,
}
ORACLES = {"op7_ball_tree": OP7_SQL, "op8_line_dedup": OP8_SQL, "op12_segment_means": OP12_SQL, "op13_pane_revisions": OP13_SQL}
