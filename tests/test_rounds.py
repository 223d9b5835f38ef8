"""What a reviewer found, on small tables that show it."""

from pyspark.sql import functions as F

from mnemoria.catalogue.registry import ORACLES, QUERIES


def same_as_sql(spark, tmp_path, name, **tables):
    """The query and its SQL on tables of the given rows and schemas."""
    import duckdb
    from comparing import rows_of

    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got, want = QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
    return got


def test_length_counts_words_between_spaces(spark, tmp_path):
    items = [(1, "Where is the\nred house\nof the old king\nand his men."), (2, "noñco mayñana ifé"), (3, "is it  more ?")]
    for name in ("complexity_breakdown", "dynamic_k", "query_class"):
        same_as_sql(spark, tmp_path / name, name, benchmark=(items, "item_id long, text string"))


def test_negation_ends_at_letters_beyond_ascii(spark, tmp_path):
    docs = [(1, "noñco", "en", "s", 5), (2, "ciónos", "en", "s", 6), (3, "é5 of ñ7ü", "en", "s", 9), (4, "not 5%", "en", "s", 6), (5, None, "en", "s", 0)]
    same_as_sql(spark, tmp_path, "metadata_flags", documents=(docs, "doc_id long, text string, lang string, source string, n_chars long"))


def test_anchors_are_rewritten_once(spark, tmp_path):
    import time

    texts = ["I came Yesterday, 3 days ago, 2 weeks ago and in 2 weeks; tonight", "ñtodayñ and last week", "x" * 100_000 + " 3 days ago", None, "in 3 days, this morning, last night recently 3 days ago 3 days ago"]
    docs = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    began = time.perf_counter()
    got = same_as_sql(spark, tmp_path, "temporal_anchor", documents=(docs, "doc_id long, text string, lang string, source string, n_chars long"))
    assert len(got) == 5 and time.perf_counter() - began < 60


def test_episode_summary_has_all_facts(spark, tmp_path):
    docs = [(50 * i, f"fact {i}" * (i % 9), "en", "s", 1) for i in range(130)]
    label, event = ([(0, 1, 0)], "doc_id long, quality int, toxic int"), ([(0, None, 7)], "event_id long, ts timestamp, user_id long")
    got = same_as_sql(spark, tmp_path, "episode_summary", documents=(docs, "doc_id long, text string, lang string, source string, n_chars long"), labels=label, events=event)
    assert got["summary"][0].count("\n") == 129


def test_topk_equals_column_scores(spark):
    """By matrix products as by column expressions, with copies, zeros, nulls, other lengths and opposite vectors; no join of all pairs."""
    import random

    from mnemoria.functions import vector as V
    from mnemoria.operators import topk

    rng = random.Random(3)
    base = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(40)]
    rows = [(i, [float(x) for x in base[rng.randrange(40)]]) for i in range(300)]
    rows += [(300, None), (301, []), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, [float("nan")] * 6), (304, [0.0] * 6), (305, [1.0, 2.0]), (306, [float("inf")] + [0.0] * 5)]
    rows += [(400 + i, [-x for x in base[0]]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(0, base[0]), (1, base[7]), (2, [0.0] * 6), (3, [1.0, 0.0])], "query_id int, query array<float>")
    for score, up, digits, low in ((V.cosine_clamped, False, None, None), (V.cosine, False, 6, 0.1), (V.dot, False, None, None), (V.l2_squared, True, None, None), (V.cosine_clamped, False, 3, None)):
        for k in (1, 12, 10_000):
            got = topk.exact_topk(df, asked, k, score, low, up, digits=digits)
            assert k == 10_000 or "cosine" not in str(score) or "NestedLoopJoin" not in topk._pairs(df.filter("id < 300"), asked.filter("query_id < 3"), k, score, low, up, 10_000, digits)._jdf.queryExecution().toString()
            from pyspark.sql.window import Window

            pairs = topk._scored(df, asked, score, digits, low, 10_000, 4)
            want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc("score") if up else F.desc("score"), "id"))).filter(F.col("rank") <= k)
            key = lambda r: (r["query_id"], r["rank"], r["id"], repr(r["score"]))
            assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_all_pairs_are_whole(spark, tmp_path):
    """Copies, documents that share nothing and empty ones are pairs too."""
    texts = ["a red house", "a red house", "blue", "", " ", "A red boat of the old man", "houses housing house"] + [f"word{i % 7} word{i % 5} red" for i in range(40)]
    docs = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    got = same_as_sql(spark, tmp_path / "w", "word_jaccard_pairs", documents=(docs, schema))
    assert len(got) == len(texts) * (len(texts) - 1) // 2
    same_as_sql(spark, tmp_path / "k", "keyword_jaccard", documents=(docs, schema))
    names = [(1, "Supplier#1"), (2, "Supplier#1"), (3, "supplier#21"), (4, "aaaa"), (5, "aaaaa"), (6, "xyz")]
    same_as_sql(spark, tmp_path / "n", "trigram_name_similarity", supplier=(names, "s_suppkey long, s_name string"))


def test_similar_sets_of_all_sizes(spark):
    """Frequent members and many sizes, in blocks of a few sets; no join of entries on their members."""
    import random

    from mnemoria.operators import similarity

    rng = random.Random(11)
    base = [[f"m{min(rng.randrange(80), rng.randrange(80))}" for _ in range(rng.randrange(0, 50))] for _ in range(20)]
    rows = [(i, [m for m in rng.choice(base) if rng.random() > 0.1] if i % 40 else None) for i in range(260)]
    got = similarity.similar_sets(spark.createDataFrame(rows, "id long, members array<string>"), 6, 10, block=16)
    least = {}
    for i, m in rows:
        if m:
            least.setdefault(frozenset(m), i)
    want = [(min(i, j), max(i, j), len(x & y), len(x | y)) for x, i in least.items() for y, j in least.items() if i < j and len(x & y) * 10 >= len(x | y) * 6]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    assert not similarity.similar_sets(spark.createDataFrame([], "id long, members array<string>"), 6, 10).collect()
