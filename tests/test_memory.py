"""Conversation ingest as a stream: retries, a killed epoch, turns sent again."""

import pytest
from pyspark.sql import functions as F

from mnemoria.sources import tables as T
from mnemoria.streaming import memory

SAID = [
    (1, 0, "user", "Mary Lopez works at Acme and my brother John moved to New York yesterday."), (1, 1, "assistant", "ok"), (1, 2, "user", None), (1, 3, None, "Dr. Mary Jones met John Smith in Paris today."),
    (2, 0, "user", "John knows Mary. John knows Mary. Blue Widget Company is at Boston"), (2, 1, "user", "mary lopez works at acme"), (2, 2, "user", ""), (None, 5, "user", "nobody knows where this is from"), (3, None, "user", "no turn in London"),
]


@pytest.fixture
def turns(spark):
    rows = spark.createDataFrame(SAID, "conv_id long, turn long, role string, content string")
    return rows.withColumn("created_at", T.minutes_after(F.coalesce("conv_id", F.lit(0)) * 60 + F.coalesce("turn", F.lit(0))))


def everything(spark, target):
    return {f.__name__: sorted(map(str, f(spark, target).drop("epoch").collect())) for f in (memory.facts, memory.entities, memory.relations, memory.episodes)}


def test_stream_killed_and_started_again(spark, turns, tmp_path, monkeypatch):
    memory.write_epoch(turns, 0, f"{tmp_path}/plain", T.now())
    want = everything(spark, f"{tmp_path}/plain")
    assert len(want["facts"]) == 7 and len(want["episodes"]) == 2
    for c in (1, 2):
        turns.filter(F.coalesce("conv_id", F.lit(2)) == c).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    start = lambda: memory.ingest_conversations(spark, f"{tmp_path}/in", turns.schema, f"{tmp_path}/out", f"{tmp_path}/cp", T.now())
    relations = memory.extract.relations

    def dies(*a, **b):
        raise RuntimeError("killed")

    monkeypatch.setattr(memory.extract, "relations", dies)  # facts and mentions are out, the mark is not
    with pytest.raises(Exception, match="killed"):
        start().awaitTermination()
    monkeypatch.setattr(memory.extract, "relations", relations)
    start().awaitTermination()
    assert everything(spark, f"{tmp_path}/out") == want
    turns.filter("conv_id = 1").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # sent again
    start().awaitTermination()
    assert everything(spark, f"{tmp_path}/out") == want


def test_what_is_found(spark, turns, tmp_path):
    memory.write_epoch(turns, 0, f"{tmp_path}/t", T.now())
    edges = {(r["source"], r["target"], r["relation_type"]): r["fact_id"] for r in memory.relations(spark, f"{tmp_path}/t").collect()}
    assert edges["mary lopez", "acme and my brother john moved to new york", "works_at"] == 1000  # the patterns take words of any case
    names = {r["normalized_name"]: r["mention_count"] for r in memory.entities(spark, f"{tmp_path}/t").collect()}
    assert names["mary jones"] == 1 and names["boston"] == 1
    text = {r["id"]: r["atomic_text"] for r in memory.facts(spark, f"{tmp_path}/t").collect()}
    assert text[1001] == "assistant: ok" and text[1002] == "user:" and "2024-01-31" in text[1000]
