"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, write_table


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the smallest node it reaches.

    A round gives each node the least label around it, then the label of that
    label; rounds end when none changes. Labels are written to the shared
    folder each round, so a lost executor costs a round at most.
    """
    spark = edges.sparkSession
    both = edges.filter("a <> b").select("a", "b").unionByName(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).dropDuplicates(["a", "b"])
    both, edge_path = write_table(both, "cc-edges")
    labels, path = write_table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node"), "cc-labels")
    for _ in range(max_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        step, step_path = write_table(step, "cc-labels")
        drop_table(spark, path)
        if step.filter("component <> old").isEmpty():
            drop_table(spark, edge_path)
            return step.select("node", "component")
        jump = step.select(F.col("node").alias("low"), F.col("component").alias("via"))
        labels, path = write_table(step.select("node", F.col("component").alias("low")).join(jump, "low").select("node", F.least("low", "via").alias("component")), "cc-labels")
        drop_table(spark, step_path)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def merge_components(component: DataFrame, links: DataFrame) -> DataFrame:
    """``component`` (node, component) after further links (a, b): only the graph of components is walked again."""
    of = lambda c: component.select(F.col("node").alias(c), F.col("component").alias("c" + c))
    pairs = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    joined = connected_components(pairs.filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    new = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(component, "node", "left_anti").withColumn("component", F.col("node"))
    every = component.unionByName(new)
    to = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return every.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
