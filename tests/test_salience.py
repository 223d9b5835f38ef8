"""Salience as state: batch and stream against a plain loop, over a restart."""

import re

from pyspark.sql import functions as F

from mnemoria.functions import wordlists as W
from mnemoria.sources import tables as T
from mnemoria.streaming import salience

TALK = [
    "My brother John joined Acme Inc. and he likes it.", "Dr. Mary Jones said she knows him.", "They hired her; their office is in Boston.", "it is hers, not his.", "My sister Anna and my friend Paul met.", "He left.", "himself and itself",
    *[f"Mr. Person{chr(97 + i // 26)}{chr(97 + i % 26)} spoke." for i in range(60)], "He and she and they agree.", None, "",
]


def plain(rows):
    """rows of one conversation: (turn, minute, text)."""
    held, out = [], []
    for turn, minute, text in sorted(rows):
        text = text or ""
        found = {}
        for pattern, group, kind in ((W.TITLED, 2, "person"), (W.MY_RELATIVE, 2, "person"), (W.COMPANY, 0, "org"), (W.LOCATION, 2, "place")):
            for m in re.finditer(pattern, text, re.A):
                if kind != "place" or m.group(group).lower() not in W.COMMON_WORDS:
                    found[m.group(group).lower()] = (m.group(group), kind)
        for low, (name, kind) in found.items():
            old = [h for h in held if h["low"] == low]
            if old:
                old[0].update(seen=minute, weight=old[0]["weight"] + 0.1)
            elif len(held) < 50:
                head = name.lower().split()[0]
                sex = "it" if kind != "person" else "he" if head in W.MALE_NAMES else "she" if head in W.FEMALE_NAMES else "?"
                held.append({"low": low, "name": name, "kind": kind, "sex": sex, "seen": minute, "weight": 1.0})
        for h in held:
            if minute - h["seen"] > 1:
                h["weight"] *= 0.95
        for sex, words in (("he", {"he": "", "him": "", "his": "'s", "himself": ""}), ("she", {"she": "", "her": "", "hers": "'s", "herself": ""}), ("it", {"it": "", "its": "'s", "itself": ""}), ("they", {"they": "", "them": "", "their": "'s", "theirs": "'s", "themselves": ""})):
            fits = [h for h in held if (h["kind"] == "org" if sex == "they" else h["sex"] == sex)]
            if fits:
                best = fits[0]
                for h in fits[1:]:
                    best = h if h["weight"] > best["weight"] else best
                text = " ".join(words_of(text, words, best["name"]))
        out.append((turn, text))
    return out


def words_of(text, words, name):
    parts = re.split(r"(\b[A-Za-z0-9_]+\b)", text, flags=re.A)
    return ["".join(name + words[p.lower()] if p.lower() in words else p for p in parts)]


def test_talk(spark):
    rows = [(c, i, text) for c in (1, 2) for i, text in enumerate(TALK[c - 1 :])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, content string").withColumn("created_at", T.minutes_after(F.col("turn")))
    got = {(r["conv_id"], r["turn"]): r["resolved"] for r in salience.resolved(turns).collect()}
    want = {(c, t): x for c in (1, 2) for t, x in plain([(i, i, text) for k, i, text in rows if k == c])}
    assert got == want


def test_stream_over_a_restart(spark, data, tmp_path):
    turns = T.turns(spark, data).select("conv_id", "turn", "created_at", "content")
    extra = spark.createDataFrame([(900, i, text) for i, text in enumerate(TALK)], "conv_id long, turn long, content string").withColumn("created_at", T.minutes_after(F.col("turn")))
    every = turns.unionByName(extra.select(turns.columns)).cache()
    for part in range(3):  # a start for each file, on one checkpoint
        every.filter(F.least(F.floor(F.col("turn") / 3), F.lit(2)) == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        salience.resolve_stream(spark, f"{tmp_path}/in", every.schema, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, salience.resolved(every).collect()))
    assert len(got) == every.count()
