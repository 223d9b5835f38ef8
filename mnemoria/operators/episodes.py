"""Sessions by inactivity, and what is known of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """(user, started_at, ended_at, n): a gap longer than ``gap`` begins a new one. The same expression works on a stream."""
    s = events.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"), F.count("*").alias("n"))
    return s.drop("w")


def by_id(rows: DataFrame, key: str, ts: str = "created_at") -> DataFrame:
    """(key, started_at, ended_at, n): a session for each id that the caller gives."""
    return rows.groupBy(key).agg(F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"), F.count("*").alias("n"))


def newest(episodes: DataFrame, key: str, n: int = 10) -> DataFrame:
    return episodes.orderBy(F.desc("started_at"), F.desc(key)).limit(n)


def entity_mentions(mentions: DataFrame) -> DataFrame:
    """(episode_id, entity, n)."""
    return mentions.groupBy("episode_id", "entity").agg(F.count("*").alias("n"))


def summaries(facts: DataFrame) -> DataFrame:
    """(episode_id, n_facts, summary): the number of facts, and all of them, whole, as bullets in order of creation. A summary is one value: an episode's texts fit a task."""
    items = F.array_sort(F.collect_list(F.struct("created_at", "id", F.coalesce("atomic_text", F.lit("")).alias("t"))))
    return facts.groupBy("episode_id").agg(F.count("*").alias("n_facts"), F.array_join(F.transform(items, lambda r: F.concat(F.lit("- "), r["t"])), "\n").alias("summary"))


def formatted(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, conversation): a line "Role: content" for each turn, in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, "role", "content")))
    return turns.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: F.concat(F.initcap(r["role"]), F.lit(": "), r["content"])), "\n").alias("conversation"))
