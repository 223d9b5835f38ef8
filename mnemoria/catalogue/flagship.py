"""Adaptive retrieval with all its views, its ablations, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import PRESETS
from ..functions import wordlists as W
from ..operators import graph
from ..plans import retrieve
from ..sources import tables as T
from .lexicals import STEM, STOPPED, quoted
from .registry import query
from .texts import COMPLEX_SQL, esc
from .vectors import COS, bench_queries


def nodes(spark, sf):
    """(query_id, entity): benchmark texts name no entity of the graph, so each query stands for a customer and a nation by its number."""
    n = T.read(spark, sf, "customer").agg(F.count("*").alias("n"))
    asked = bench_queries(spark, sf).select("query_id").crossJoin(F.broadcast(n))
    names = F.array(F.concat(F.lit("customer:"), (F.col("query_id") % F.col("n") + 1).cast("string")), F.concat(F.lit("nation:"), (F.col("query_id") % 25).cast("string")))
    return asked.select("query_id", F.explode(names).alias("entity"))


def _adaptive(preset: str):
    def run(spark, sf):
        settings = PRESETS[preset]
        relations, known, own = T.whole_graph(spark, sf)[1], T.entity_facts(spark, sf), nodes(spark, sf)
        named = own.join(known, "entity").select("query_id", "fact_id").distinct()
        boosts = graph.graph_score(relations, known, own, settings.graph_boost)
        return retrieve.adaptive(T.facts(spark, sf, True), bench_queries(spark, sf), T.now(), settings, boosts, named)

    return run


def _facets(rows: str, key: str) -> str:
    every = lambda p, g=0: f"regexp_extract_all(text, '{esc(p)}', {g})"
    return f"""
  SELECT id, kind, value, count(*) AS n FROM (
    SELECT id, unnest([0, 1, 2, 3]) AS kind, unnest([times, list_transform(places, lambda v: lower(v)), list_transform(list_filter(names, lambda v: NOT contains(v, ' ')), lambda v: lower(v)), list_transform(list_filter(names, lambda v: contains(v, ' ')), lambda v: lower(v))]) AS vs
    FROM (SELECT id, times, places, list_filter({every(W.PROPER, 1)}, lambda v: lower(v) NOT IN ({quoted(W.COMMON_WORDS)}) AND NOT list_contains(places, v)) AS names
      FROM (SELECT {key} AS id, text, list_concat(list_concat({every(W.DATE_YMD)}, {every(W.DATE_MDY)}), {every(W.DATE_WRITTEN)}) AS times, list_distinct(list_concat(list_concat({every(W.CITY, 2)}, {every(W.COUNTRY)}), {every(W.STATE)})) AS places FROM {rows}))
  ), unnest(vs) AS t(value) GROUP BY ALL"""


def _sql(preset: str) -> str:
    s = PRESETS[preset]
    total = sum(s.weights)
    k = f"least({s.max_k}, CAST(floor({s.k} * (1 + 2 * c) + 0.5e0) AS INTEGER))" if s.adaptive else str(s.k)
    return f"""WITH {T.FACTS_SQL}, q AS (SELECT item_id AS id, text FROM benchmark WHERE item_id IN (SELECT vec_id FROM embeddings)), {COMPLEX_SQL},
own AS (SELECT y.id AS query_id, text, {k} AS k, CAST(embedding AS DOUBLE[]) AS qv FROM y JOIN embeddings ON vec_id = y.id),
active AS MATERIALIZED (SELECT f.*, atomic_text AS text, CAST(e.embedding AS DOUBLE[]) AS v FROM facts f JOIN embeddings e ON e.vec_id = f.id WHERE NOT is_obsolete),
sem AS (SELECT query_id, id, greatest(0e0, least(1e0, {COS.format(a="v", b="qv")})) AS s FROM active, own),
d AS (SELECT id, {STOPPED.format(c="text")} AS ws FROM active), n AS (SELECT count(*) AS n, avg(len(ws)) AS av FROM d), dx AS (SELECT id, len(ws) AS len, unnest(ws) AS w FROM d),
tf AS (SELECT id, len, {STEM} AS term, count(*) AS tf FROM dx GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qx AS (SELECT query_id, unnest({STOPPED.format(c="text")}) AS w FROM own), qt AS (SELECT DISTINCT query_id, {STEM} AS term FROM qx),
lex AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len / av))) AS s FROM tf JOIN df USING (term) JOIN qt USING (term), n GROUP BY query_id, id),
ff AS ({_facets("active", "id")}), fq AS ({_facets("own", "query_id")}),
fk AS (SELECT DISTINCT id, kind FROM ff), qk AS (SELECT DISTINCT id, kind FROM fq),
shared AS (SELECT qk.id AS query_id, fk.id, count(*) AS kinds FROM qk JOIN fk USING (kind) GROUP BY ALL),
hits AS (SELECT fq.id AS query_id, ff.id, sum(fq.n) AS hits FROM fq JOIN ff ON fq.kind = ff.kind AND fq.value = ff.value GROUP BY ALL),
sym AS (SELECT query_id, id, hits / CAST(kinds AS DOUBLE) AS s FROM hits JOIN shared USING (query_id, id)),
{T.ENTITY_FACTS_SQL},
named AS (SELECT query_id, fact_id FROM own JOIN entity_facts ON entity = 'customer:' || (query_id % (SELECT count(*) FROM customer) + 1)),
weights AS (SELECT query_id, fact_id, 1e0 AS w FROM named UNION ALL SELECT query_id, fact_id, 0.4e0 FROM own JOIN customer ON c_nationkey = query_id % 25 JOIN entity_facts ON entity = 'customer:' || c_custkey),
boost AS (SELECT query_id, fact_id AS id, least(1e0, sum(w)) * {s.graph_boost}e0 AS g FROM weights GROUP BY ALL),
views AS (
  SELECT query_id, id, s AS sem, 0e0 AS lex, 0e0 AS sym, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM sem
  {f"UNION ALL SELECT query_id, id, 0e0, s, 0e0, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, id) FROM lex" if s.weights[1] else ""}
  {f"UNION ALL SELECT query_id, id, 0e0, 0e0, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) FROM sym UNION ALL SELECT query_id, fact_id, 0e0, 0e0, 0.5e0, 0 FROM named" if s.weights[2] else ""}),
merged AS (SELECT query_id, id, k, max(sem) AS sem, max(lex) AS lex, max(sym) AS sym FROM views JOIN own USING (query_id) WHERE r <= k * {s.over_fetch} GROUP BY ALL),
scored AS (SELECT query_id, id, k, strlen(atomic_text) AS bytes, round(greatest(0e0, least(1e0, {s.weights[0] / total}e0 * sem + {s.weights[1] / total}e0 * lex + {s.weights[2] / total}e0 * sym + {"coalesce(g, 0e0)" if s.graph else "0e0"} + 0.15e0 * importance
  + 0.1e0 * exp(-ln(2e0) * greatest(0e0, (epoch_us(TIMESTAMP '{T.NOW}') - epoch_us(last_accessed)) / 3.6e9) / {s.half_life_hours}e0) + 0.05e0 * CASE WHEN access_count <= 0 THEN 0e0 ELSE least(1e0, ln(1e0 + access_count) / ln(101e0)) END)), 6) AS score
  FROM merged JOIN active USING (id) LEFT JOIN boost USING (query_id, id)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored WHERE score >= {s.min_score}e0),
fit AS (SELECT *, sum(ceil(bytes / 4e0)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM ranked WHERE rank <= k)
SELECT query_id, id, score, rank FROM fit WHERE used <= {s.token_budget}"""


#: Presets that change nothing in a search (they switch off summaries, episodes or encoding) have no query of their own.
for _name in PRESETS:
    if _name not in ("no_summary", "no_episodes", "no_atomic_encoder"):
        _f = _adaptive(_name)
        _f.__name__ = "adaptive_retrieve" if _name == "full" else f"ablation_{_name}"
        query(_sql(_name))(_f)


@query()
def build_context(spark, sf):
    return retrieve.build_context(_adaptive("full")(spark, sf), T.facts(spark, sf), 600)
