"""Statistics of measurements, in the three rank conventions in use.

Ranks come from counts: equal values are counted before they travel, ``PIECES``
of a group's distinct values, picked by their hashes, cut them into ranges, and a
value's rank is the size of the ranges before its own plus a running sum within
it. So no group is sorted in one task, however large. Ranges are worked out in
more than one place of the plan, so they depend on the values alone: a sketch
would change with the order in which its parts are merged. Null values take no
part, a null group is one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PIECES = 64


def cuts(counts: DataFrame) -> DataFrame:
    """(g, edges) of distinct (g, v): at most PIECES of a group's values, the same however its rows are dealt."""
    slot = F.pmod(F.xxhash64("v"), F.lit(PIECES))
    picked = counts.groupBy("g", slot.alias("slot")).agg(F.min_by("v", F.struct(F.xxhash64("v", F.lit(1)), "v")).alias("v"))
    return picked.groupBy("g").agg(F.array_sort(F.collect_list("v")).alias("edges"))


def at_places(rows: DataFrame, group: str, value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(group, n, mean, sd, the value at each place): places are 1-based ranks made from n."""
    known = rows.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    stats = known.groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    counts = known.groupBy("g", "v").agg(F.count("*").alias("c"))
    edges = cuts(counts).select(F.col("g").alias("same"), "edges")
    of = stats.select(F.col("g").alias("of"), "n").join(edges, F.col("of").eqNullSafe(F.col("same")))
    cut = counts.join(of, F.col("g").eqNullSafe(F.col("of"))).select("g", "v", "c", "n", F.size(F.filter("edges", lambda e: e < F.col("v"))).alias("piece"))
    sizes = cut.groupBy("g", "piece").agg(F.sum("c").alias("size"))
    before = sizes.select(F.col("g").alias("of"), F.col("piece").alias("at"), (F.sum("size").over(Window.partitionBy("g").orderBy("piece")) - F.col("size")).alias("before"))
    high = F.sum("c").over(Window.partitionBy("g", "piece").orderBy("v"))
    ranked = cut.withColumn("high", high).join(before, F.col("g").eqNullSafe(F.col("of")) & (F.col("piece") == F.col("at"))).withColumn("high", F.col("high") + F.col("before"))
    found = [F.max(F.when((place(F.col("n")) <= F.col("high")) & (place(F.col("n")) > F.col("high") - F.col("c")), F.col("v"))).alias(name) for name, place in places.items()]
    values = ranked.groupBy("g").agg(*found).withColumnRenamed("g", "of")
    return stats.join(values, F.col("g").eqNullSafe(F.col("of"))).select(F.col("g").alias(group), "n", "mean", "sd", *places)


def upper(rows: DataFrame, group: str = "operation", value: str = "duration_us") -> DataFrame:
    """Median s[n / 2], percentiles s[int(n * p)], population deviation."""
    at = lambda p: lambda n: F.least(F.floor(n * p), n - 1) + 1
    return at_places(rows, group, value, {"median": at(0.5), "p95": at(0.95), "p99": at(0.99)})


def nearest_rank(rows: DataFrame, group: str = "operation", value: str = "duration_us") -> DataFrame:
    """Percentiles at ceil(n * p); the median averages the middle two."""
    at = lambda p: lambda n: F.ceil(n * p / 100)
    out = at_places(rows, group, value, {"low": lambda n: F.floor((n + 1) / 2), "high": lambda n: F.floor((n + 2) / 2), "p95": at(95), "p99": at(99)})
    return out.select(group, "n", ((F.col("low") + F.col("high")) / 2).alias("median"), "p95", "p99")


def integer(rows: DataFrame, group: str = "operation", value: str = "duration_us") -> DataFrame:
    """s[n * p / 100] by integer division."""
    at = lambda p: lambda n: F.least(F.floor(n * p / 100), n - 1) + 1
    return at_places(rows, group, value, {"p50": at(50), "p95": at(95), "p99": at(99)}).select(group, "n", "p50", "p95", "p99")


def distance_bucket(d: Column) -> Column:
    return F.when(d <= 10, "0-10").when(d <= 25, "11-25").when(d <= 50, "26-50").otherwise("50+")


def summary(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Runs, valid ones (value over 0), errors, their share in percent, and the mean of the valid."""
    ok = F.col(value) > 0
    out = rows.groupBy(group).agg(F.count("*").alias("runs"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("errors"), F.round(F.avg(F.when(ok, F.col(value))), 4).alias("mean"))
    return out.withColumn("error_pct", F.round(F.col("errors") * 100 / F.col("runs"), 1))


def positive_only(rows: DataFrame, group: str = "operation", value: str = "duration_us") -> DataFrame:
    return upper(rows.filter(F.col(value) > 0), group, value)


def hit_rate(hits, misses):
    """Hits over all; 0 if there were none."""
    return F.when(hits + misses > 0, hits / (hits + misses)).otherwise(F.lit(0.0))
