"""Composite retrieval, for many queries at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Retrieval
from ..functions import scoring as R
from ..functions import text as X
from ..functions import vector as V
from ..operators import lexical, pack, symbolic, topk
from ..sources import store


def adaptive(facts: DataFrame, queries: DataFrame, now: Column, settings: Retrieval = Retrieval(), graph: DataFrame | None = None, named: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): semantic, lexical and symbolic views, merged by fact, boosted, scored, cut to k and to a token budget.

    ``queries`` has query_id, text, query (vector); ``facts`` those of the fact
    table with vectors; ``graph`` (query_id, fact_id, graph_score) and ``named``
    (query_id, fact_id: facts of entities that the query names), if any. Each
    view hands over 3 * k rows, k by the query's complexity; named facts enter
    at a symbolic score of a half. The lexical and symbolic views are
    not searched at weight 0.
    """
    complexity = R.complexity(F.col("text"))
    k = R.dynamic_k(complexity, settings.k, settings.max_k) if settings.adaptive else F.lit(settings.k)
    own = store.stored(queries.select("query_id", "text", "query", k.alias("k")), "asked")
    fetch = max(settings.k, settings.max_k) * settings.over_fetch
    active = facts.filter("not is_obsolete")

    def seen(rows: DataFrame, **scores) -> DataFrame:
        return rows.select("query_id", "id", *[scores.get(v, F.lit(0.0)).alias(v) for v in ("semantic", "lexical", "symbolic")], "rank")

    views = [seen(topk.exact_topk(active.select("id", "embedding"), own.select("query_id", "query"), fetch), semantic=F.col("score"))]
    if settings.weights[1]:
        views.append(seen(lexical.bm25(active, own.select("query_id", F.col("text").alias("query")), fetch), lexical=F.col("score")))
    if settings.weights[2]:
        views.append(seen(symbolic.view(symbolic.facets(active), symbolic.facets(own, "query_id", "text"), fetch), symbolic=F.col("score")))
        if named is not None:
            views.append(seen(named.select("query_id", F.col("fact_id").alias("id"), F.lit(0).alias("rank")), symbolic=F.lit(0.5)))
    every = reduce(DataFrame.unionByName, views).join(own.select("query_id", "k"), "query_id").filter(F.col("rank") <= F.col("k") * settings.over_fetch)
    merged = every.groupBy("query_id", "id", "k").agg(*[F.max(v).alias(v) for v in ("semantic", "lexical", "symbolic")])
    if graph is not None and settings.graph:
        merged = merged.join(graph.select("query_id", F.col("fact_id").alias("id"), "graph_score"), ["query_id", "id"], "left").fillna(0.0, ["graph_score"])
    else:
        merged = merged.withColumn("graph_score", F.lit(0.0))
    full = merged.join(active.select("id", "importance", "last_accessed", "access_count", "atomic_text"), "id")
    score = R.hybrid_b(F.col("semantic"), F.col("lexical"), F.col("symbolic"), F.col("graph_score"), F.col("importance"), R.half_life(R.hours_between(now, F.col("last_accessed")), settings.half_life_hours), R.access_boost(F.col("access_count")), settings.weights)
    scored = full.withColumn("score", F.round(score, 6)).filter(F.col("score") >= settings.min_score)
    order = [F.desc("score"), F.asc("id")]
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= F.col("k"))
    fit = topk.within_budget(ranked, X.tokens_ceil_bytes(F.col("atomic_text")), settings.token_budget, [F.asc("rank")], ["query_id"])
    return fit.select("query_id", "id", "score", "rank")


def hybrid_a(facts: DataFrame, query: Column, now: Column, k: int = 20, pool: int = 200, min_score: float = 0.3) -> DataFrame:
    """Fact memory A: the most important rows first, then similarity, and the formula of A; ages count from creation."""
    near = topk.prefiltered_topk(facts.filter("not is_obsolete"), query, 2 * k, pool)
    score = R.hybrid_a(F.col("score"), F.col("importance"), R.hours_between(now, F.col("created_at")), F.col("access_count"), F.lit(0.0))
    return near.withColumn("score", F.round(score, 6)).filter(F.col("score") >= min_score).orderBy(F.desc("score"), "id").limit(k)


def rag(chunks: DataFrame, queries: DataFrame, k: int = 5, min_score: float = 0.2, pool: int = 50, select: bool = True) -> DataFrame:
    """Chunk search, combined score, MMR, then near-duplicates dropped (so fewer than k may be left). ``chunks``: id long, text, embedding; ``queries``: query_id, text, query."""
    near = topk.exact_topk(chunks.select("id", "embedding"), queries.select("query_id", "query"), max(pool, 3 * k), V.cosine, min_score)
    full = near.join(chunks.select("id", F.col("text").alias("body")), "id").join(F.broadcast(queries.select("query_id", "text")), "query_id")
    scored = full.withColumn("semantic", F.col("score")).withColumn("score", R.rag_combined(F.col("score"), R.saturated_tf(X.rag_keywords(F.col("text")), F.col("body"))))
    if not select:
        return scored.select("query_id", "id", "semantic", "score")
    scored = store.stored(scored.select("query_id", "id", "body", "semantic", "score"), "rag-pool")  # k rounds of selection read it
    places = pack.mmr(scored.select("query_id", "id", "score", "semantic"), "query_id", k)
    chosen = store.stored(places, "rag-chosen").join(scored.select("query_id", "id", "body", "score"), ["query_id", "id"])
    return pack.near_dup_drop(chosen, "query_id", F.col("place"), F.array_distinct(X.fields(F.lower("body"))), ["id", "score"])


def merge_recent(recent: DataFrame, retrieved: DataFrame, now: Column, k: int) -> DataFrame:
    """Retrieved first, then recents that aren't among them; relevance 0.5 for a recent, falling with rank for a retrieved one."""
    a = retrieved.select("id", "created_at", F.greatest(F.lit(0.3), 1 - (F.col("rank") - 1) * 0.1).alias("relevance"), F.lit(0).alias("source"))
    b = recent.select("id", "created_at", F.lit(0.5).alias("relevance"), F.lit(1).alias("source"))
    one = a.unionByName(b).groupBy("id").agg(F.min_by("relevance", "source").alias("relevance"), F.min_by("created_at", "source").alias("created_at"))
    return one.withColumn("score", F.round(R.merge_rank(F.col("relevance"), R.hours_between(now, F.col("created_at"))), 6)).orderBy(F.desc("score"), "id").limit(k)


def build_context(ranked: DataFrame, facts: DataFrame, budget: int = 1000) -> DataFrame:
    """(query_id, context): what fits, best first, as a bullet list."""
    full = ranked.join(facts.select("id", "atomic_text"), "id")
    kept = pack.greedy_skip(full, "query_id", F.col("rank"), X.tokens_ceil_bytes(F.col("atomic_text")), budget, ["id", "atomic_text"])
    return pack.bullet_list(kept, "query_id", "atomic_text", "place")
