"""Runs of names: long texts, and the patterns' own words on awkward ones."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemoria.functions import names as N
from mnemoria.functions import wordlists as W
from mnemoria.operators import extract as E


def test_texts_of_20000_words_without_a_stop(spark):
    long = ["word " * 20_000, "in " + "Word " * 20_000, "Word " * 20_000 + "Inc.", "Ann joined " + "word " * 20_000, "a " * 20_000]
    rows = spark.createDataFrame(list(enumerate(long)), "id int, text string")
    found = {(r["id"], r["entity_type"], len(r["name"])) for r in E.entities(rows).collect()}
    assert found == {(1, "place", 99_999), (2, "organization", 100_003)}
    assert [(r["id"], r["relation_type"], len(r["target"])) for r in E.relations(rows).collect()] == [(3, "works_at", 99_999)]
    assert {r["n"] for r in rows.select(F.size(N.capitalised(F.col("text"))).alias("n")).collect()} == {0, 1}


PIECES = ["Ann", "bob", "X", "York2", "2York", "new_York", "in", "At", "to", "Inc", "Inc.", "Co.", "co", "Co.x", "Company", "joined", "works at", "lives in", "is a member of", "is part of", "moved to", "é", "Zoë", ",", ", ", " ,", ".", "\n", "\t", "  ", "-", "'s", "5"]


@pytest.fixture(scope="module")
def con():
    return duckdb.connect()


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), min_size=1, max_size=14), min_size=20, max_size=40))
def test_runs_are_those_of_the_patterns(spark, con, texts):
    rows = [(i, " ".join(t) if i % 3 else "".join(t)) for i, t in enumerate(texts)]
    t = F.col("text")
    relations = N.relations(t)
    got = spark.createDataFrame(rows, "id int, text string").select("id", N.capitalised(t), N.places(t), N.companies(t), *[c for k in ("works_at", "lives_in", "member_of") for c in relations[k]]).collect()
    patterns = [(rf"\b{W.NAMES}\b", 1), (W.LOCATION, 2), (W.COMPANY, 0), *[(p, g) for k, _, p in W.RELATIONS if k in relations for g in (1, 2)]]
    for row, (_, text) in zip(got, rows, strict=True):
        want = [con.execute("SELECT regexp_extract_all(?, ?, ?)", [text, p, g]).fetchone()[0] for p, g in patterns]
        assert list(row)[1:] == want, text
