"""Queries cover their whole tables."""

import re

import pytest
from pyspark.sql import functions as F

from mnemoria.catalogue import QUERIES
from mnemoria.functions import text as X
from mnemoria.operators import pack
from mnemoria.sources import tables as T


@pytest.mark.parametrize("name,table", [("temporal_anchor", "documents"), ("metadata_flags", "documents"), ("truncate_tokens", "documents"), ("complexity_breakdown", "benchmark"), ("dynamic_k", "benchmark"), ("query_class", "benchmark"), ("rerank_features", "documents"), ("repeated_word_test", "documents"), ("parse_decisions", "documents")])
def test_texts_cover_tables(spark, data, name, table):
    assert QUERIES[f"{name}"](spark, data).count() == spark.read.parquet(f"{data}/{table}.parquet").count()


def test_texts_without_sql_cover_tables(spark, data):
    docs, turns = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "conversations"))
    assert QUERIES["specificity_score"](spark, data).count() == docs.count()
    assert QUERIES["coref_replace"](spark, data).count() == turns.count()
    named = {r["id"] for r in QUERIES["capitalised_entities"](spark, data).collect()}
    assert named <= {r["doc_id"] for r in docs.collect()} and len(named) > 10
    facts = QUERIES["parse_fact_lines"](spark, data)
    assert facts.count() == sum(1 for r in turns.collect() if re.sub(r"\s+", " ", r["text"] or "", flags=re.A).strip(" "))
    assert QUERIES["insert_normalize"](spark, data).count() == docs.filter(F.trim("text") != "").count()
    assert all(QUERIES[f"{n}"](spark, data).count() >= 0 for n in ("relation_regex", "entity_regex", "parse_entity_lines", "parse_relation_lines"))


def test_near_dup_drop_is_whole(spark):
    import random

    rng = random.Random(5)
    rows, base = [], [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 40))] for _ in range(25)]
    for i in range(300):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            if words:
                words[rng.randrange(len(words))] = f"w{rng.randrange(60)}"
        rows.append((i % 3, 1000 + i, " ".join(words) if i % 50 else None))
    want = []
    for k in range(3):
        kept = []
        for q, i, t in rows:
            w = None if t is None else set(t.split())
            near = lambda v: w is not None and v is not None and (not (w | v) or len(w & v) / len(w | v) > 0.85)  # noqa: B023, E731
            if q == k and not any(near(v) for _, v in kept):
                kept.append((i, w))
        want += [(k, p, i) for p, (i, _) in enumerate(kept)]
    df = spark.createDataFrame(rows, "q long, id long, t string")
    got = pack.near_dup_drop(df, "q", F.col("id"), F.array_distinct(X.fields(F.col("t"))), ["id"])
    assert sorted(tuple(r) for r in got.collect()) == want


def test_selections_pass_the_old_bounds(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    more = docs.limit(20).select((F.col("doc_id") + 100_000).alias("doc_id"), F.concat(F.lit("own "), F.col("doc_id").cast("string")).alias("text"), "lang", "source", "n_chars")
    for t in ("labels", "events"):
        spark.read.parquet(f"{data}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    new = {r["doc_id"] for r in more.collect()}
    assert new <= {r["id"] for r in QUERIES["near_dup_drop"](spark, str(tmp_path)).collect()}
    assert {r["id"] for r in QUERIES["greedy_skip_pack"](spark, str(tmp_path)).collect()} & new
    kept = {r["source"] for r in QUERIES["chunk_merge"](spark, str(tmp_path)).collect()}
    assert {str(s) for s in kept} & {str(i) for i in new}


def test_graph_is_whole(spark, data):
    orders, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("orders", "lineitem"))
    bought = {tuple(r) for r in orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_suppkey").distinct().collect()}
    assert {r["kind"]: r["n"] for r in QUERIES["graph_stats"](spark, data).collect()}["knows"] == len(bought)
    _, relations = T.whole_graph(spark, data)
    out = {}
    for r in relations.collect():
        out.setdefault(r["source"], []).append((r["target"], r["confidence"]))
    frontier, want = {s: [s] for s in ("customer:1", "customer:4")}, set()
    seen = set(frontier)
    for _ in range(3):
        want |= {">".join(p) for e, p in frontier.items() if e not in out and len(p) > 1}
        best = {}
        for e, p in frontier.items():
            for t, c in out.get(e, []):
                if t not in seen:
                    best[t] = min(best.get(t, (1, [])), (-c, p))
        frontier = {t: p + [t] for t, (_, p) in best.items()}
        seen |= set(frontier)
    assert {r["path"] for r in QUERIES["bfs_paths"](spark, data).collect()} == want | {">".join(p) for p in frontier.values()}


def test_all_benchmark_items_are_asked(spark, data):
    items = {r[0] for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id").collect()} & {r[0] for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id").collect()}
    assert len(items) > 10 and {r["query_id"] for r in QUERIES["rag_hybrid_retrieve"](spark, data).collect()} == items
