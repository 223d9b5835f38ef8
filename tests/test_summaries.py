"""Rolling summaries against a loop over facts: full, incremental, what waits, epochs that die or come twice."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mnemoria.operators import summaries as S
from mnemoria.sources import tables as T
from mnemoria.streaming import summaries

COLUMNS = "id long, scope long, minute long, atomic_text string, is_obsolete boolean"


def made(n, seed=5):
    """A third of all facts has one scope; times tie."""
    rng = random.Random(seed)
    return [(i, 0 if rng.random() < 1 / 3 else rng.randrange(1, 6), rng.randrange(20), f"fact\n{i}" if i % 7 else None, rng.random() < 0.2) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).withColumn("created_at", T.minutes_after(F.col("minute"))).drop("minute")


def plain(batches, least, newest, half):
    """Lines of each scope after all batches, and what a state covers."""
    facts, lines, covered, versions = {}, {}, defaultdict(set), defaultdict(int)
    for batch in batches:
        for r in batch:
            facts[r[0], r[1]] = r
        for scope in {s for _, s in facts if s is not None}:
            active = sorted((r[2], r[0], r[3] or "") for (i, s), r in facts.items() if s == scope and i is not None and not r[4])
            wait = [a for a in active if a[1] not in covered[scope]]
            if len(wait) < least:
                continue
            versions[scope] += 1
            if scope in lines and (not half or len(wait) * 2 < len(active)):
                some, old = wait[:newest], lines[scope]
                covered[scope] |= {a[1] for a in some}
            else:
                some, old = active[-newest:], []
                covered[scope] |= {a[1] for a in wait}
            lines[scope] = (old + ["- " + a[2] for a in some])[-newest:]
    return {s: ("\n".join(lines[s]), versions[s]) for s in lines}, {(s, i) for s in covered for i in covered[s]}


@pytest.mark.parametrize("half", [False, True])
def test_epochs_equal_a_loop(spark, tmp_path, half):
    every = made(120)
    again = [(i, s, m, t, True) for i, s, m, t, _ in every[:12]]  # these become obsolete
    odd = [(None, 1, 3, "no id", False), (900, None, 3, "no scope", False), (901, 1, 3, "", None)]
    batches = [every[:50], every[50:55] + odd, every[55:100] + again, every[100:]]
    for epoch, batch in enumerate(batches):
        summaries.write_epoch(table(spark, batch), epoch, str(tmp_path), T.now(), least=3, newest=6, half=half)
    want, covers = plain(batches, 3, 6, half)
    assert {r["scope"]: (r["summary"], r["version"]) for r in summaries.current(spark, str(tmp_path)).collect()} == want
    got = [(r["scope"], r["fact_id"]) for r in summaries.rows(spark, str(tmp_path), "covered").collect()]
    assert len(got) == len(set(got)) and set(got) == covers


def test_killed_and_repeated_epochs(spark, tmp_path, monkeypatch):
    batches = [made(60)[:30], made(60)[30:]]
    want, _ = plain(batches, 3, 5, False)
    for i, batch in enumerate(batches):
        table(spark, batch).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        table(spark, batch).coalesce(1).write.mode("append").parquet(f"{tmp_path}/files")
    out = f"{tmp_path}/out"
    summaries.write_epoch(table(spark, batches[0]), 0, out, T.now(), least=3, newest=5)
    refresh = S.refresh

    def dies(*a, **b):
        made_states, _ = refresh(*a, **b)
        return made_states, made_states.select(F.raise_error(F.lit("killed")).alias("scope"))

    monkeypatch.setattr(S, "refresh", dies)  # facts and states are out, the mark is not
    with pytest.raises(Exception, match="killed"):
        summaries.write_epoch(table(spark, batches[1]), 1, out, T.now(), least=3, newest=5)
    monkeypatch.setattr(S, "refresh", refresh)
    assert {r["version"] for r in summaries.current(spark, out).collect()} == {1}
    for _ in range(2):
        summaries.write_epoch(table(spark, batches[1]), 1, out, T.now(), least=3, newest=5)
        assert {r["scope"]: (r["summary"], r["version"]) for r in summaries.current(spark, out).collect()} == want


def test_stream_of_files_and_an_empty_table(spark, tmp_path):
    rows = made(40)
    table(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second start finds nothing new
        summaries.refresh_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", T.now(), least=2, newest=4).awaitTermination()
    want, _ = plain([rows], 2, 4, False)
    assert {r["scope"]: (r["summary"], r["version"]) for r in summaries.current(spark, f"{tmp_path}/out").collect()} == want
    summaries.write_epoch(table(spark, []), 0, f"{tmp_path}/none", T.now())
    assert summaries.current(spark, f"{tmp_path}/none").count() == 0


def test_a_summariser_of_ones_own(spark):
    facts = table(spark, [(i, 1, i, f"t{i}", False) for i in range(6)])
    none = spark.createDataFrame([], S.STATES), spark.createDataFrame([], S.COVERED)
    states, _ = S.refresh(facts, *none, T.now(), newest=3, summarise=lambda old, texts: F.array(F.concat_ws("+", texts)), scope="scope")
    assert states.first()["lines"] == ["t3+t4+t5"]
