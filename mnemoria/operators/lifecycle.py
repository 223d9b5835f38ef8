"""Life cycle: append-only logs with latest-state views, insert rules, pruning, compression, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring as R


def latest(log: DataFrame, key: str = "id", seq: str = "seq", op: str = "op") -> DataFrame:
    """The newest row of each key, unless it is a deletion; max_by combines map-side, so no window sort."""
    rest = [c for c in log.columns if c != key]
    new = log.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("__row"))
    return new.select(key, *[F.col(f"__row.`{c}`").alias(c) for c in rest]).filter(F.col(op) != "delete")


def insert_rules(rows: DataFrame) -> DataFrame:
    """Trimmed text (blank rows go), defaults for atomic text and category, importance in (0, 1]."""
    text = F.trim("fact_text")
    importance = F.when(F.coalesce("importance", F.lit(0.0)) <= 0, 0.5).when(F.col("importance") > 1, 1.0).otherwise(F.col("importance"))
    atomic = F.when(F.trim(F.coalesce("atomic_text", F.lit(""))) == "", text).otherwise(F.trim("atomic_text"))
    category = F.when(F.coalesce("category", F.lit("")) == "", "other").otherwise(F.col("category"))
    return rows.filter(text != "").withColumns({"atomic_text": atomic, "category": category, "importance": importance, "fact_text": text})


def supersede(log: DataFrame, changes: DataFrame) -> DataFrame:
    """Appends a state for each (old_id, new_id, seq): obsolete, and by whom."""
    old = latest(log).drop("seq", "op", "is_obsolete", "superseded_by")
    rows = old.join(changes, old["id"] == changes["old_id"]).select(*old.columns, "seq", F.lit("update").alias("op"), F.lit(True).alias("is_obsolete"), F.col("new_id").alias("superseded_by"))
    return log.unionByName(rows, allowMissingColumns=True)


def touch(facts: DataFrame, accesses: DataFrame) -> DataFrame:
    """Access counts and last accesses from a log of (fact_id, ts)."""
    seen = accesses.groupBy("fact_id").agg(F.count("*").alias("n"), F.max("ts").alias("t"))
    out = facts.join(seen, facts["id"] == seen["fact_id"], "left")
    return out.withColumns({"access_count": F.col("access_count") + F.coalesce("n", F.lit(0)), "last_accessed": F.greatest("last_accessed", F.coalesce("t", "last_accessed"))}).drop("fact_id", "n", "t")


def prune_keep(facts: DataFrame, threshold: int, keep: int) -> DataFrame:
    """What a hard prune leaves: newest obsolete rows up to keep / 4, strongest active ones up to keep; all under the threshold."""
    if facts.count() <= threshold:
        return facts
    newest = facts.filter("is_obsolete").orderBy(F.desc("created_at"), F.desc("id")).limit(keep // 4)
    strongest = facts.filter("not is_obsolete").orderBy(F.desc("importance"), F.desc("access_count"), F.desc("created_at"), F.desc("id")).limit(keep)
    return newest.unionByName(strongest)


def soft_prune(facts: DataFrame, now: Column, keep: int, spare: float = 0.2) -> DataFrame:
    """Rows to mark obsolete: of the newest 4 * excess active ones the ``excess`` of least weight, but for those of importance ``spare`` or more."""
    active = facts.filter("not is_obsolete")
    excess = active.count() - keep
    if excess <= 0:
        return active.limit(0).withColumn("weight", F.lit(0.0))
    newest = active.orderBy(F.desc("created_at"), F.desc("id")).limit(4 * excess)
    weight = R.prune_weight(F.col("importance"), R.hours_between(now, F.col("created_at")), F.col("access_count"))
    return newest.withColumn("weight", weight).orderBy("weight", "id").limit(excess).filter(F.col("importance") < spare)


def compress_block(memories: DataFrame, before: Column, most: int = 100, least: int = 5) -> DataFrame:
    """One block of the oldest uncompressed memories before a time: ids, span, tokens and a joined summary; none under ``least``."""
    old = memories.filter(~F.col("compressed") & (F.col("created_at") < before)).orderBy("created_at", "id").limit(most)
    ordered = F.array_sort(F.collect_list(F.struct("created_at", "id", "text", "token_count")))
    one = old.agg(ordered.alias("r"), F.min("created_at").alias("time_range_start"), F.max("created_at").alias("time_range_end"), F.sum("token_count").alias("token_count"), F.count("*").alias("n"))
    return one.filter(F.col("n") >= least).select(F.transform("r", lambda x: x["id"]).alias("source_ids"), F.array_join(F.transform("r", lambda x: x["text"]), " | ").alias("summary"), "time_range_start", "time_range_end", "token_count", "n")


def fact_stats(facts: DataFrame) -> DataFrame:
    return facts.agg(F.count("*").alias("total"), F.count_if(~F.col("is_obsolete")).alias("active"), F.count_if("is_obsolete").alias("obsolete"), F.countDistinct("episode_id").alias("episodes"), F.avg(F.when(~F.col("is_obsolete"), F.col("importance"))).alias("avg_importance"))


def memory_stats(memories: DataFrame) -> DataFrame:
    return memories.agg(F.count("*").alias("total"), F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("tokens"), F.count_if("compressed").alias("compressed"), F.coalesce(F.avg(F.col("compressed").cast("int")), F.lit(0.0)).alias("compression_ratio"))


def update_decisions(new: DataFrame, existing: DataFrame, low: float = 0.5, high: float = 0.85, k: int = 5) -> DataFrame:
    """(fact_id, best_id, best_score, decision): ADD when nothing is near; else the near ones are for a model to judge."""
    from .topk import exact_topk

    near = exact_topk(existing.select("id", "embedding"), new.select(F.col("id").alias("query_id"), F.col("embedding").alias("query")), k)
    best = near.filter("rank = 1").select(F.col("query_id").alias("fact_id"), F.col("id").alias("best_id"), F.col("score").alias("best_score"))
    out = new.select(F.col("id").alias("fact_id")).join(best, "fact_id", "left")
    label = F.when(F.coalesce("best_score", F.lit(0.0)) < low, "ADD").when(F.col("best_score") >= high, "UPDATE").otherwise("COMPARE")
    return out.withColumn("decision", label)


def summary_pending(facts: DataFrame, summarised: DataFrame) -> DataFrame:
    """Active facts that no summary covers: an anti join on ids, whatever their number."""
    return facts.filter("not is_obsolete").join(summarised.select(F.col("fact_id").alias("id")), "id", "left_anti")


def rolling_summary(facts: DataFrame, newest: int = 50) -> DataFrame:
    """The deterministic stand-in of a summary: the newest active facts as bullets."""
    top = facts.filter("not is_obsolete").orderBy(F.desc("created_at"), F.desc("id")).limit(newest)
    rows = F.array_sort(F.collect_list(F.struct("created_at", "id", "atomic_text")))
    return top.agg(F.array_join(F.transform(rows, lambda r: F.concat(F.lit("- "), r["atomic_text"])), "\n").alias("summary"), F.count("*").alias("n_facts"))


def recent(rows: DataFrame, n: int, by: str = "created_at") -> DataFrame:
    return rows.orderBy(F.desc(by), F.desc("id")).limit(n)


def last_per_group(rows: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("back", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("back") <= n)


def summary_state(facts: DataFrame, summaries: DataFrame, covered: DataFrame, now: Column, refresh_hours: float = 1.0, least: int = 3) -> DataFrame:
    """One row: the newest summary and what it calls for. ``summaries``: id, summary, updated_at; ``covered``: fact_id, what that summary has read.

    Dirty: an active fact is not covered. Needed from ``least`` active facts
    on. Stale beyond twice the refresh interval, or with no summary (its text
    is then empty). Incremental: some facts are new, and fewer than half.
    """
    last = summaries.agg(F.max_by("summary", F.struct("updated_at", "id")).alias("summary"), F.max("updated_at").alias("updated_at"))
    seen = covered.select(F.col("fact_id").alias("id")).distinct().withColumn("seen", F.lit(True))
    counts = facts.filter("not is_obsolete").join(seen, "id", "left").agg(F.count("*").alias("n_active"), F.count_if(F.col("seen").isNull()).alias("n_pending"))
    stale = F.col("updated_at").isNull() | (R.hours_between(now, F.col("updated_at")) > 2 * refresh_hours)
    some = (F.col("n_pending") > 0) & (F.col("n_pending") * 2 < F.col("n_active"))
    return counts.crossJoin(F.broadcast(last)).select(
        F.coalesce("summary", F.lit("")).alias("summary"), "n_active", "n_pending", (F.col("n_pending") > 0).alias("dirty"),
        (F.col("n_active") >= least).alias("needed"), stale.alias("stale"), (F.col("updated_at").isNotNull() & some).alias("incremental"))


def prune_compressed(memories: DataFrame, keep: int) -> DataFrame:
    """Of the compressed memories the newest ``keep`` stay; the others all do."""
    return memories.filter(~F.col("compressed")).unionByName(recent(memories.filter("compressed"), keep))


def in_categories(rows: DataFrame, categories: list[str]) -> DataFrame:
    """Rows of these categories; an empty list keeps all."""
    return rows.filter(F.col("category").isin(categories)) if categories else rows


def merged_text(reply: Column, new: Column) -> Column:
    """A model's merged text of two facts; a blank one gives way to the new fact's."""
    return F.coalesce(F.nullif(F.trim(reply), F.lit("")), new)


def with_fallback(found: DataFrame, queries: DataFrame, facts: DataFrame, n: int) -> DataFrame:
    """(query_id, id, fallback): what was found, and the ``n`` newest facts for each query that found nothing."""
    empty = queries.select("query_id").distinct().join(found.select("query_id"), "query_id", "left_anti")
    newest = F.broadcast(recent(facts, n).select("id"))
    return found.select("query_id", "id", F.lit(False).alias("fallback")).unionByName(empty.crossJoin(newest).withColumn("fallback", F.lit(True)))
