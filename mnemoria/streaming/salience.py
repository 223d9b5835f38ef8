"""Salient names of a conversation, as state: each turn's pronouns become the names most likely meant.

A turn's own names come first: a new one enters at 1.0 while under ``HELD`` are
known, a known one gains 0.1; then names not seen for over a minute lose a
twentieth. After that its pronouns are replaced, by gender or kind, with the
name of greatest weight (the earlier one of equals).

Names are found by column expressions before the turns are grouped; only what
runs along a conversation is a step in Python (:func:`step`), the same for a
batch and for a stream, where it is the state of one conversation. A stream
takes the turns of a conversation in order; within a micro-batch they are
ordered by ``turn``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import names as N
from ..functions import wordlists as W
from ..operators.extract import PRONOUNS

HELD, NEW, AGAIN, FADE = 50, 1.0, 0.1, 0.95
MINUTE = 60_000_000
RESOLVED = "conv_id long, turn long, resolved string"
STATE = "name array<string>, kind array<string>, gender array<string>, seen array<long>, weight array<double>"


def with_names(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, at, content, names, kinds): each turn's names in order of pattern and place, each once."""
    text = F.coalesce("content", F.lit(""))
    every = lambda p: F.regexp_extract_all(text, F.lit(N.ascii_bounds(p)), F.lit(2))
    places = F.filter(N.places(text), lambda n: ~F.lower(n).isin(*W.COMMON_WORDS))
    found = [(every(W.TITLED), "person"), (every(W.MY_RELATIVE), "person"), (N.companies(text), "organization"), (places, "place")]
    kinds = F.concat(*[_repeat(names, kind) for names, kind in found])
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.unix_micros("created_at").alias("at"), text.alias("content"), F.concat(*[n for n, _ in found]).alias("names"), kinds.alias("kinds"))


def _repeat(names, kind: str):
    return F.transform(names, lambda _: F.lit(kind))


def gender(name: str, kind: str) -> str:
    head = (name.lower().split() or [""])[0]
    return "neutral" if kind != "person" else "male" if head in W.MALE_NAMES else "female" if head in W.FEMALE_NAMES else "unknown"


def step(held: list[list], names, kinds, text: str, at: int) -> str:
    """The text with names for pronouns, after ``held`` ([name, kind, gender, seen, weight], in order of arrival) has learnt the turn's names."""
    last = {n.lower(): (n, k) for n, k in zip(names, kinds, strict=True)}  # the last pattern that names one gives its kind
    known = {e[0].lower(): e for e in held}
    for low, (name, kind) in last.items():
        if low in known:
            known[low][3:] = [at, known[low][4] + AGAIN]
        elif len(held) < HELD:
            known[low] = [name, kind, gender(name, kind), at, NEW]
            held.append(known[low])
    for e in held:
        if at - e[3] > MINUTE:
            e[4] *= FADE
    for whom, (plain, owning) in PRONOUNS.items():
        fits = [e for e in held if (e[1] == "organization" if whom == "plural" else e[2] == whom)]
        if fits:
            name = max(fits, key=lambda e: e[4])[0]
            said = {w: name for w in plain} | {w: name + "'s" for w in owning}
            text = re.sub(rf"(?ai)\b({'|'.join(said)})\b", lambda m, said=said: said[m.group(1).lower()], text)
    return text


def _along(held: list[list], frame: pd.DataFrame) -> pd.DataFrame:
    out = [(r.conv_id, r.turn, step(held, r.names, r.kinds, r.content, r.at)) for r in frame.sort_values(["turn", "at"]).itertuples()]
    return pd.DataFrame(out, columns=["conv_id", "turn", "resolved"])


def resolved(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, resolved) of a table of turns; a conversation is a group."""
    return with_names(turns).groupBy("conv_id").applyInPandas(lambda frame: _along([], frame), RESOLVED)


class Names(StatefulProcessor):
    """What one conversation has made salient so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("names", STATE)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [list(e) for e in zip(*self.state.get(), strict=True)] if self.state.exists() else []
        yield _along(held, pd.concat(rows))
        columns = [list(c) for c in zip(*held, strict=True)] if held else [[] for _ in range(5)]
        self.state.update((columns[0], columns[1], columns[2], [int(x) for x in columns[3]], [float(x) for x in columns[4]]))


#: Settings of such a stream alone; a session's own values come back after its start.
STREAM = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def resolve_stream(spark: SparkSession, source: str, schema, target: str, checkpoint: str, files_per_batch: int = 1) -> StreamingQuery:
    """Turns (conv_id, turn, created_at, content) from new files below ``source`` to resolved ones below ``target``; goes on where it ended."""
    before = {k: spark.conf.get(k, None) for k in STREAM}
    try:
        for k, v in STREAM.items():
            spark.conf.set(k, v)
        turns = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        out = with_names(turns).groupBy("conv_id").transformWithStateInPandas(Names(), RESOLVED, "Append", "None")
        return out.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(target)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
