"""Operators against hand-computed cases and small independent loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoria import config, hooks, metrics
from mnemoria.functions import scoring as R
from mnemoria.functions import text as X
from mnemoria.operators import ann, extract, graph, lifecycle, pack, rag, topk
from mnemoria.sources import store
from mnemoria.streaming import ingest


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


@pytest.mark.parametrize("word,stem", [("organization", "organize"), ("running", "runn"), ("cats", "cat"), ("ing", "ing"), ("studies", "study"), ("is", "is")])
def test_stem(spark, word, stem):
    assert one(spark, X.stem(F.col("w")), w=word) == stem


def test_chunks_end_rule(spark):
    text = " ".join(map(str, range(10)))
    assert [c.split()[0] for c in one(spark, X.word_chunks(F.col("t"), 4, 1), t=text)] == ["0", "3", "6"]
    assert one(spark, X.word_chunks(F.col("t"), 4, 1), t="  ") == []


def test_scores(spark):
    assert one(spark, R.half_life(F.col("h")), h=168.0) == pytest.approx(0.5)
    assert one(spark, R.access_boost(F.col("n")), n=100) == pytest.approx(1.0)
    assert one(spark, R.dynamic_k(F.col("c")), c=1.0) == 15
    assert one(spark, R.query_class(F.col("q")), q="When did it rain") == "temporal"


@pytest.mark.parametrize("n,p,want", [(1, 95, 0), (5, 95, 4), (10, 50, 4), (100, 95, 94), (100, 99, 98), (20, 95, 18)])
def test_nearest_rank(n, p, want):
    assert math.ceil(n * p / 100) - 1 == want


def test_latency(spark):
    rows = spark.createDataFrame([("a", i) for i in range(20)], "operation string, duration_us long")
    got = metrics.nearest_rank(rows).first()
    assert (got["median"], got["p95"]) == (9.5, 18)


def test_ranks_by_counts_equal_sorted_lists(spark):
    rng = np.random.default_rng(9)
    groups = {"hot": np.floor(rng.lognormal(3, 2, 5000)).astype(int).tolist(), None: rng.integers(0, 3, 200).tolist(), "one": [7], "two": [4, 9]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("hot", None), ("none", None)], "operation string, duration_us long")
    by = [{r["operation"]: r for r in f(rows).collect()} for f in (metrics.upper, metrics.nearest_rank, metrics.integer)]
    assert all(set(b) == set(groups) for b in by)
    for g, vs in groups.items():
        s, n = sorted(vs), len(vs)
        u, m, i = (b[g] for b in by)
        assert (u["n"], u["median"], u["p95"], u["p99"]) == (n, s[n // 2], s[min(int(n * 0.95), n - 1)], s[min(int(n * 0.99), n - 1)])
        assert u["mean"] == pytest.approx(np.mean(s)) and u["sd"] == pytest.approx(np.std(s))
        assert (m["n"], m["median"], m["p95"], m["p99"]) == (n, np.median(s), s[math.ceil(n * 95 / 100) - 1], s[math.ceil(n * 99 / 100) - 1])
        assert (i["n"], i["p50"], i["p95"], i["p99"]) == (n, s[n * 50 // 100], s[min(n * 95 // 100, n - 1)], s[min(n * 99 // 100, n - 1)])


def test_month_overflow(spark):
    now = F.lit("2024-03-31").cast("timestamp")
    assert one(spark, extract.anchor_times(F.col("t"), now), t="1 month ago") == "March 2024"
    assert one(spark, extract.anchor_times(F.col("t"), now), t="Today and in 2 days") == "2024-03-31 and by 2024-04-02"


def test_greedy_and_mmr_equal_loops(spark):
    rng = np.random.default_rng(3)
    items = [(1, i, float(rng.random()), int(rng.integers(1, 40))) for i in range(30)]
    df = spark.createDataFrame(items, "q long, id long, score double, t long")
    got = [r["id"] for r in pack.greedy_skip(df, "q", -F.col("score"), F.col("t"), 200, ["id"]).orderBy("place").collect()]
    used, want = 0, []
    for _, i, _, t in sorted(items, key=lambda x: -x[2]):
        if used + t <= 200:
            used += t
            want.append(i)
    assert got == want
    got = [r["id"] for r in pack.mmr(df.withColumn("semantic", F.col("score")), "q", 5).orderBy("place").collect()]
    left, taken = sorted(items, key=lambda x: -x[2]), []
    while len(taken) < 5:
        worth = lambda x: x[2] if not taken else 0.7 * x[2] - 0.3 * max(1 - min(2 * abs(x[2] - y[2]), 1) for y in taken)
        taken.append(max((x for x in left if x not in taken), key=worth))
    assert got == [x[1] for x in taken]


def test_ann_orders_and_recalls(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 16))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, embedding array<float>")
    q = df.filter("id < 8").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    c = ann.train(df, 8, 2)
    post = df.join(ann.assign(df, c).select("id", "cluster"), "id")
    exact = topk.exact_topk(df, q, 5)
    full = ann.recall(ann.probe(post, c, q, 8, 5), exact).agg(F.avg("recall"), F.min("top1")).first()
    some = ann.recall(ann.probe(post, c, q, 4, 5), exact).agg(F.avg("recall"), F.min("top1")).first()
    assert full[0] == 1.0 and full[1] == 1 and 0.5 <= some[0] <= 1.0 and some[1] == 1
    assert topk.exact_topk(df, q, 5, block=3).count() == 40


def test_latest_and_store(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, "insert", 5), (1, 2, "update", 6), (2, 1, "insert", 7), (2, 3, "delete", 7)], "id long, seq long, op string, v int")
    assert [(r["id"], r["v"]) for r in lifecycle.latest(log).collect()] == [(1, 6)]
    assert store.ensure(spark, f"file://{tmp_path}/t", "id long").count() == 0
    seeded = store.seed_if_absent(spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(1,), (2,)], "id long"))
    assert seeded.count() == 2


def test_merge_adjacent(spark):
    rows = spark.createDataFrame([("s", i, "w" * 40, 0.1 * i) for i in (0, 1, 2, 5)], "source string, idx int, text string, score double")
    assert {(r["first"], r["last"]) for r in rag.merge_adjacent(rows).collect()} == {(0, 2), (5, 5)}


def test_files_and_index(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("one two three")
    (tmp_path / "docs/b.bin").write_text("no")
    build = lambda files: rag.chunks(files, "path", "text", 2, 0)
    first = rag.stored_index(spark, f"file://{tmp_path}/docs", f"file://{tmp_path}/index", build)
    again = rag.stored_index(spark, f"file://{tmp_path}/docs", f"file://{tmp_path}/index", lambda _: pytest.fail("rebuilt"))
    assert first.count() == again.count() == 2


def test_graph(spark):
    rel = spark.createDataFrame([("a", "b", "r", 0.5), ("b", "c", "r", 0.8), ("a", "a", "r", 1.0)], "source string, target string, relation_type string, confidence double")
    n = spark.createDataFrame([("a",)], "entity string")
    assert sorted(r["direction"] for r in graph.neighbors(rel, n).collect()) == ["outgoing", "outgoing"]
    assert {r["entity"]: r["hops"] for r in graph.bfs_hops(rel, n).collect()} == {"a": 0, "b": 1, "c": 2}
    assert [r["path"] for r in graph.bfs_paths(rel, n).collect()] == [["a", "b", "c"]]


def test_hooks_and_config(spark):
    df = spark.createDataFrame([("a b",), ("a b",), (None,)], "text string")
    out = hooks.embed(df, "text").collect()
    assert len(out) == 3 and len(out[0]["embedding"]) == 384
    assert set(config.PRESETS) >= {"full", "minimal", "fixed_k"}
    with pytest.raises(ValueError):
        config.Retrieval(weights=(0, 0, 0))


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, "user", f"text {i}?") for i in range(7)] + [(9, "user", " ")], "id long, role string, content string")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    ingest.ingest(spark, f"{tmp_path}/in", rows.schema, f"{tmp_path}/out", f"{tmp_path}/cp", 1).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select(rows.columns + ["token_count", "importance_score"])
    assert sorted(got.collect()) == sorted(ingest.prepared(rows).collect())


def test_stream_windows(spark, data):
    ev = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    live = spark.readStream.schema(spark.read.parquet(f"{data}/events.parquet").schema).parquet(f"{data}/events*").withColumn("ts", F.col("ts").cast("timestamp"))
    q = ingest.tumbling(live, "1 hour").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").count() == ingest.tumbling(ev, "1 hour").count()


def test_index_on_disk(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (3, [0.9, 0.1, 0.0, 0.0])], "id long, embedding array<float>")
    c = ann.train(df, 2, 1)
    post = df.join(ann.assign(df, c).select("id", "cluster"), "id")
    ann.save(f"file://{tmp_path}/ann", c, post, dimension=4)
    c2, p2 = ann.load(spark, f"file://{tmp_path}/ann", dimension=4)
    q = df.filter("id = 1").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    assert [r["id"] for r in ann.probe(p2, c2, q, 2, 3).orderBy("rank").collect()] == [1, 3, 2]
    assert ann.upsert(p2, c2, df.filter("id = 3")).count() == 3
    with pytest.raises(ValueError):
        ann.load(spark, f"file://{tmp_path}/ann", dimension=8)
    blob = spark.createDataFrame([(np.array([1, 2], "<f4").tobytes(),), (b"abc",)], "b binary")
    assert [r[0] for r in blob.select(store.decode_vector(F.col("b"))).collect()] == [[1.0, 2.0], None]
