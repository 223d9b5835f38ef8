"""Selection and packing of ranked rows."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import store
from . import similarity


def greedy_skip(rows: DataFrame, key: str, order: Column, tokens: Column, budget: int, carry: list[str]) -> DataFrame:
    """Takes what still fits, in order; all rows if everything fits. ``order`` sorts ascending; a key's rows pass by one at a time, in sorted batches."""
    item = F.struct(order.alias("o"), tokens.cast("long").alias("t"), *carry)
    own = rows.select(F.col(key), tokens.cast("long").alias("tokens"), F.sum(tokens).over(Window.partitionBy(key)).alias("__total"), item.alias("__item"), *[F.col(c).alias(f"__c_{c}") for c in carry])
    sorted_rows = own.repartition(key).sortWithinPartitions(key, "__item").select(key, F.lit(0).alias("place"), *[F.col(f"__c_{c}").alias(c) for c in carry], "tokens", F.coalesce(F.col("__total") <= budget, F.lit(False)).alias("__all"))

    def run(batches):
        now, used, place = (), 0, 0
        for batch in batches:
            own, taken, places = batch.schema.get_field_index(key), [], []
            for i, (k, t, everything) in enumerate(zip(batch.column(own).to_pylist(), batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())):
                if now != (k,):
                    now, used, place = (k,), 0, 0
                if everything or (t is not None and used + t <= budget):
                    used += t or 0
                    taken.append(i)
                    places.append(place)
                place += 1
            some = batch.take(pa.array(taken, pa.int64()))
            columns = [pa.array(places, pa.int32()) if n == 1 else some.column(n) for n in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return sorted_rows.mapInArrow(run, sorted_rows.drop("__all").schema)


def near_dup_drop(rows: DataFrame, key: str, order: Column, words: Column, carry: list[str], limit: float = 0.85) -> DataFrame:
    """Keeps a row if its word Jaccard with all kept before is at most ``limit``; rows without words (null) stay.

    Of equal sets only the first can stay. Two sets nearer than ``limit``
    share one of the rarest n - floor(limit * n) words of each, so an inverted
    list of those finds all pairs; what is kept then follows from the pairs.
    Words travel only for rows of such a pair; order and places are found from
    the other columns. Equal ``order`` and ``carry`` go by a hash of the words.
    """
    item = F.struct(order.alias("o"), *carry)
    said = rows.select(F.col(key), *carry, item.alias("__item"), words.alias("__w"), F.coalesce(F.col(key).cast("string"), F.lit("\0")).alias("__k"), F.monotonically_increasing_id().alias("__id"))
    said = store.stored(said.withColumn("__set", F.coalesce(F.sha2(F.to_json(F.struct(F.array_sort("__w").alias("w"))), 256), F.lit(""))), "near-dup-words")
    own = said.select(key, *carry, "__item", "__k", "__id", "__set", F.col("__w").isNull().alias("__none"))
    own = own.withColumn("__n", F.row_number().over(Window.partitionBy("__k", "__set").orderBy("__item", "__id"))).filter("__n = 1 or __none")
    own = store.stored(own.withColumn("__pos", F.row_number().over(Window.partitionBy("__k").orderBy("__item", "__set", "__id"))).select(key, *carry, "__k", "__id", "__pos"), "near-dup-rows")  # four steps read it
    sets = said.select(F.col("__id").alias("id"), F.col("__w").alias("members"), F.size("__w").alias("size")).filter("size > 0")
    rarest = similarity.coded(sets).select(F.col("id").alias("__id"), F.col("size").alias("n"), F.slice("codes", 1, F.col("size") - F.floor(F.col("size") * limit).cast("int")).alias("codes"))
    lists = own.select("__k", "__id", "__pos").join(rarest, "__id").select("__k", "__id", F.col("__pos").alias("p"), "n", F.posexplode("codes").alias("r", "code"))
    left, right = (lists.select("__k", "code", *[F.col(c).alias(f"{c}_{i}") for c in ("__id", "p", "n", "r")]) for i in ("a", "b"))
    # the first word shared and those after it, of the set with fewer
    rest = F.least(F.col("n_a") - F.col("r_a"), F.col("n_b") - F.col("r_b"))
    near = left.join(right, ["__k", "code"]).filter((F.col("p_a") < F.col("p_b")) & (F.least("n_a", "n_b") > F.greatest("n_a", "n_b") * limit) & (rest * (1 + limit) >= (F.col("n_a") + F.col("n_b")) * limit - 1e-6))
    near = store.stored(near.select("__k", F.col("p_a").alias("a"), F.col("p_b").alias("b"), "__id_a", "__id_b").distinct(), "near-dup-pairs")
    asked = store.stored(near.select(F.explode(F.array("__id_a", "__id_b")).alias("__id")).distinct(), "near-dup-asked")
    few = F.broadcast(asked) if asked.count() <= 2_000_000 else asked
    found = store.stored(said.select("__id", "__w").join(few, "__id"), "near-dup-sets")
    both = near.join(found.toDF("__id_a", "x"), "__id_a").join(found.toDF("__id_b", "y"), "__id_b")
    pairs = both.filter(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")) > limit).select("__k", "a", "b")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        gone: set[int] = set()
        for a, b in group.sort_values(["b", "a"])[["a", "b"]].itertuples(index=False):
            if a not in gone:
                gone.add(b)
        return pd.DataFrame({"__k": [group["__k"].iloc[0]] * len(gone), "__pos": sorted(gone)})

    dropped = pairs.groupBy("__k").applyInPandas(fold, "__k string, __pos int")
    kept = own.join(dropped, ["__k", "__pos"], "left_anti")
    place = F.row_number().over(Window.partitionBy("__k").orderBy("__pos")) - 1
    return kept.withColumn("place", place).select(key, "place", *carry)


def mmr(rows: DataFrame, key: str, k: int, trade: float = 0.7, id_column: str = "id") -> DataFrame:
    """(key, id, place): the best first, then trade * score - (1 - trade) * the closest kept one's similarity.

    Similarity is 1 - min(2 * |difference of semantic scores|, 1). Candidates
    of a key are few (a search's pool), so a group fits a task.
    """

    def select(group: pd.DataFrame) -> pd.DataFrame:
        left = group.sort_values(["score", id_column], ascending=[False, True]).reset_index(drop=True)
        score, semantic = left["score"].to_numpy(), left["semantic"].to_numpy()
        taken: list[int] = []
        while len(taken) < min(k, len(left)):
            best, value = -1, float("-inf")
            for i in range(len(left)):
                if i not in taken:
                    near = max((1 - min(2 * abs(semantic[i] - semantic[j]), 1.0) for j in taken), default=0.0)
                    x = score[i] if not taken else trade * score[i] - (1 - trade) * near
                    if x > value:
                        best, value = i, x
            taken.append(best)
        return pd.DataFrame({key: [group[key].iloc[0]] * len(taken), id_column: left[id_column].to_numpy()[taken], "place": range(len(taken))})

    return rows.groupBy(key).applyInPandas(select, f"{key} long, {id_column} long, place int")


def shuffled_tail(rows: DataFrame, key: str, tokens: str, budget: int, id_column: str = "id") -> DataFrame:
    """The head, max(2, n / 3) rows, then the tail in a fixed permutation; the longest prefix that fits."""

    def select(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values(["score", id_column], ascending=[False, True]).reset_index(drop=True)
        head = min(len(own), max(2, len(own) // 3))
        order, n = list(range(len(own))), len(own) - head
        for i in range(n):
            j = i * 247 % n
            order[head + i], order[head + j] = order[head + j], order[head + i]
        own = own.iloc[order]
        fits = own[tokens].cumsum() <= budget
        own = own[fits.cummin()] if len(own) else own
        return pd.DataFrame({key: own[key], id_column: own[id_column], "place": range(len(own))})

    return rows.groupBy(key).applyInPandas(select, f"{key} long, {id_column} long, place int")


def history(turns: DataFrame, size: Column, budget: int, partition: list[str], order: list) -> DataFrame:
    """Newest turns backwards until their sizes pass the budget."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.withColumn("running", F.sum(size).over(w)).filter(F.col("running") <= budget)


def first_n_per(rows: DataFrame, partition: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).filter(F.col("rank") <= n)


def bullet_list(rows: DataFrame, key: str, text: str, order: str, title: str = "Relevant memories:") -> DataFrame:
    """(key, context): a title and a line for each row."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: F.concat(F.lit("- "), s[text]))
    return rows.groupBy(key).agg(F.concat(F.lit(title + "\n"), F.array_join(lines, "\n")).alias("context"))


def relevant_turns(turns: DataFrame, least: float, newest: int, k: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Turns that score ``least`` or are among the newest; the k best of those."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    some = turns.withColumn("back", back).filter((F.col("score") >= least) | (F.col("back") <= newest))
    return some.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), order))).filter(F.col("place") <= k)


def transcript(turns: DataFrame, tokens: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, transcript): the last 4 * tokens characters of all turns, in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, "content"))), lambda s: s["content"])
    return turns.groupBy(key).agg(F.right(F.array_join(lines, "\n"), F.lit(4 * tokens)).alias("transcript"))


def prompt_facts(facts: DataFrame, key: str, order: list, budget: int, header: int = 10) -> DataFrame:
    """The prefix of each key's facts that fits the budget after a header; a quarter token per byte, rounded down."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return facts.withColumn("used", F.sum(F.floor(F.octet_length("atomic_text") / 4).cast("long")).over(w) + header).filter(F.col("used") <= budget)


def fit_context(rows: DataFrame, key: str, score: Column, tokens: Column, most: int, prompt: int, summary: int, carry: list[str]) -> DataFrame:
    """Greedy packing by score into what the prompt, an answer of 512 and a summary (256 at most) leave of ``most``."""
    return greedy_skip(rows, key, F.struct((-score).alias("s"), *carry), tokens, max(0, most - prompt - 512 - min(summary, 256)), carry)
