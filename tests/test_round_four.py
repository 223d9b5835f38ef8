"""What round 3's findings say: work that grows no faster than the input, with the same rows."""

import math
import re

from pyspark.sql import functions as F

from mnemoria.catalogue import QUERIES
from mnemoria.functions import text as X
from mnemoria.functions import wordlists as W
from mnemoria.operators import extract, fulltext, lexical
from mnemoria.operators.fulltext import FullText

ODD = [None, "", "2024-03-05", "12024-03-05 2024-03-055 x2024-03-05", "on 3/5/24, 13/05/2024_ and é3/5/24é", "March 5th, 2024 or march 5 2024; Smarch 5 2024, May 12TH2024.", "éin Paris near NEW york, at home_ in Georgia's ohio", "USA us UKx _US Us.", "New Yorker New York", "Anna Smith met The Bob in Paris, ÀAnna", "costs 5% 12.50 x9 9x 7_ $1,200.50", "5%x 5%é 5.%"]


def test_texts_meet_each_pattern_once(spark, data):
    plan = QUERIES["specificity_score"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 7


def test_metadata_finds_what_the_patterns_say(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "id int, text string")
    m, n = extract.metadata(F.col("text")), extract.metadata(F.col("text"), noted=True)
    names = ["times", "anchor", "places", "persons", "organisations", "has_numbers", "specificity"]
    got = rows.select("id", "text", *[m[c].alias(c) for c in names]).orderBy("id").collect()
    assert got == extract.noted(rows).select("id", "text", *[n[c].alias(c) for c in names]).orderBy("id").collect()
    every = lambda p, t, g=0: [x.group(g) for x in re.finditer(p, t, re.A)]
    assert got[0]["times"] is None and got[0]["places"] is None
    for r in got[1:]:
        t = r["text"]
        places = sorted({*every(W.CITY, t, 2), *every(W.COUNTRY, t), *every(W.STATE, t)})
        found = [x for x in every(W.PROPER, t, 1) if x.lower() not in W.COMMON_WORDS and x not in places]
        assert (r["times"], r["places"]) == (every(W.DATE_YMD, t) + every(W.DATE_MDY, t) + every(W.DATE_WRITTEN, t), places)
        assert (r["persons"], r["organisations"]) == ([x for x in found if " " not in x], [x for x in found if " " in x])
        assert r["has_numbers"] == bool(re.search(W.NUMBER, t, re.A) or re.search(W.CURRENCY, t))


def test_bm25_cuts_texts_into_words_once(spark):
    """Null texts count as documents and not in the average; rows with one id are documents of their own."""
    docs = spark.createDataFrame([(1, "apple pie"), (2, None), (3, ""), (4, "apple apple tart"), (5, "pear"), (5, "pear plum"), (None, "plum")], "id long, atomic_text string")
    asked = spark.createDataFrame([(1, "apple"), (2, "pear plum"), (3, "nothing")], "query_id int, query string")
    got = lexical.bm25(docs, asked)
    assert "atomic_text" not in got._jdf.queryExecution().optimizedPlan().toString()
    n, average = 7, (2 + 0 + 3 + 1 + 2 + 1) / 6
    share = lambda df, tf, size: math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / average))
    want = {(1, 1): share(2, 1, 2), (1, 4): share(2, 2, 3), (2, 5): share(2, 1, 1) + share(2, 1, 2) + share(2, 1, 2), (2, None): share(2, 1, 1)}
    assert {(r["query_id"], r["id"]): round(r["score"], 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}


def test_indexes_shuffle_ids_and_no_exploded_postings(spark, data, tmp_path, monkeypatch):
    """Texts stay in their tasks, and so do the postings of a window, whatever the batches."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("atomic_text"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        index = FullText.create(spark, f"{tmp_path}/i", docs)
        rows = index.documents().select("window", "id", "length", F.explode("terms").alias("t")).select("t.term", "window", F.struct("id", "t.tf", "length").alias("p"))
        want = rows.groupBy("term", "window").agg(F.count("*").alias("n"), F.max("p.tf").alias("m"), F.min("p.length").alias("l"), F.array_sort(F.collect_list("p")).alias("p"))
        got = index.postings().select("term", "window", "n", "max_tf", "min_length", F.array_sort("postings"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        plain = lexical.postings(docs).groupBy("id").agg(F.count("*").alias("n"), F.sum("tf").alias("tf"))
        ours = index.documents().filter("length > 0").select("id", F.size("terms").alias("n"), F.col("length").alias("tf"))
        assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, plain.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    said = []
    monkeypatch.setattr(fulltext.store, "stored", lambda df, name: said.append(df) or df)
    fulltext.forward(docs, "id", "atomic_text")
    assert "Exchange" not in said[-1]._jdf.queryExecution().executedPlan().toString()


def test_a_words_stem_is_its_columns(spark):
    words = [w + e for w in ("é", "ab", "abc", "naïv", "relat") for e, _, _ in W.STEM_RULES] + ["", "a", "ments"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.stem(F.col("w")).alias("s")).collect()
    assert [r["s"] for r in rows] == [X.stem_word(r["w"]) for r in rows]
