"""Rolling summaries by scope (a session, an episode, a user) as states that are only appended.

A refresh reads what no summary of a scope has covered yet, writes a new state
of each scope with enough of it, and says which facts that state covers. A full
summary reads the newest facts of its scope; an incremental one reads the last
state and the oldest facts that wait, at most ``newest`` of them; the others go
on waiting, so that one refresh of a scope is bounded and no fact is passed over.

Facts: id, a scope, created_at, atomic_text, is_obsolete. Those without an id or
a scope have no summary; a null ``is_obsolete`` is false, a null text is empty; of
rows with one scope and id the least by (created_at, atomic_text) counts. Ties
in time go by id. Other columns are not read. Without facts nothing is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.store import stored

#: (lines of the last state or null, texts in order of time) -> lines of the new one.
Summarise = Callable[[Column, Column], Column]
STATES = "scope long, version int, lines array<string>, incremental boolean, n_new long, updated_at timestamp"
COVERED = "scope long, fact_id long"


def newest_bullets(newest: int) -> Summarise:
    """The stand-in of a model: a bullet for each text, whole, and of all bullets the last ``newest``."""

    def lines(old: Column, texts: Column) -> Column:
        every = F.concat(F.coalesce(old, F.array().cast("array<string>")), F.transform(texts, lambda t: F.concat(F.lit("- "), t)))
        return F.slice(every, F.greatest(F.size(every) - F.lit(newest - 1), F.lit(1)), F.lit(newest))

    return lines


def latest(states: DataFrame) -> DataFrame:
    """The newest state of each scope."""
    rest = [c for c in states.columns if c != "scope"]
    return states.groupBy("scope").agg(F.max_by(F.struct(*rest), "version").alias("r")).select("scope", "r.*")


def text_of(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def waiting(facts: DataFrame, covered: DataFrame, scope: str = "episode_id") -> DataFrame:
    """(scope, fact_id, created_at, text, waits): active facts once each, and whether no summary covers them."""
    named = facts.filter(~F.coalesce("is_obsolete", F.lit(False)) & F.col("id").isNotNull() & F.col(scope).isNotNull())
    item = F.struct("created_at", F.coalesce("atomic_text", F.lit("")).alias("text"))
    once = named.select(F.col(scope).cast("long").alias("scope"), F.col("id").cast("long").alias("fact_id"), item.alias("r")).groupBy("scope", "fact_id").agg(F.min("r").alias("r"))
    seen = covered.select("scope", "fact_id").distinct().withColumn("seen", F.lit(True))
    return once.join(seen, ["scope", "fact_id"], "left").select("scope", "fact_id", "r.*", F.col("seen").isNull().alias("waits"))


def refresh(facts: DataFrame, states: DataFrame, covered: DataFrame, now: Column, least: int = 5, newest: int = 50, half: bool = False, summarise: Summarise | None = None, scope: str = "episode_id") -> tuple[DataFrame, DataFrame]:
    """(new states, what they cover): for each scope with ``least`` waiting facts or more.

    A scope's first summary is full. Later ones are incremental, with ``half``
    only while fewer than half of the active facts wait (by ids, not by
    numbers of rows). ``states`` and ``covered`` are those of all refreshes before.
    """
    own = waiting(facts, covered, scope)
    counts = own.groupBy("scope").agg(F.count("*").alias("n_active"), F.count_if("waits").alias("n_waiting")).filter(F.col("n_waiting") >= least)
    due = counts.join(latest(states).select("scope", "version", F.col("lines").alias("old")), "scope", "left")
    fewer = F.col("n_waiting") * 2 < F.col("n_active") if half else F.lit(True)
    due = stored(due.withColumn("incremental", F.col("version").isNotNull() & fewer), "summaries-due")
    rows = own.join(due.select("scope", "incremental"), "scope")
    # A rank with a bound: each task keeps its own first ``newest`` rows of a scope before the shuffle.
    oldest = Window.partitionBy("scope").orderBy("created_at", "fact_id")
    youngest = Window.partitionBy("scope").orderBy(F.desc("created_at"), F.desc("fact_id"))
    step = rows.filter("incremental and waits").withColumn("rank", F.row_number().over(oldest)).filter(F.col("rank") <= newest)
    whole = rows.filter("not incremental").withColumn("rank", F.row_number().over(youngest)).filter(F.col("rank") <= newest)
    step = stored(step.select("scope", "fact_id", "created_at", "text"), "summaries-step")
    read = step.unionByName(whole.select("scope", "fact_id", "created_at", "text"))
    texts = read.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("created_at", "fact_id", "text"))).alias("items"))  # newest rows at most
    lines = (summarise or newest_bullets(newest))(F.when(F.col("incremental"), F.col("old")), F.col("items.text"))
    n_new = F.when(F.col("incremental"), F.size("items")).otherwise(F.col("n_waiting")).cast("long")
    made = due.join(texts, "scope").select("scope", (F.coalesce("version", F.lit(0)) + 1).cast("int").alias("version"), lines.alias("lines"), "incremental", n_new.alias("n_new"), now.cast("timestamp").alias("updated_at"))
    covers = step.select("scope", "fact_id").unionByName(rows.filter("not incremental and waits").select("scope", "fact_id"))
    return made, covers
