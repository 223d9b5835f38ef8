"""The symbolic view: an inverted table of times, places, persons and organisations, searched by an equi-join.

Values compare without regard to case, times exactly. A kind that both the query
and the fact have can reach a quarter; each of the query's values that the fact
has counts a quarter, so a score is the number of those over the number of
shared kinds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import extract

KINDS = ("times", "places", "persons", "organisations")


def facets(rows: DataFrame, id_column: str = "id", column: str = "atomic_text") -> DataFrame:
    """(id, kinds, kind, value, n): each value of a text once, how often it stands there, and a bit for each kind that the text has."""
    found = extract.metadata(F.col(column), noted=True)
    lists = extract.noted(rows, column).select(F.col(id_column).alias("id"), *[found[k].alias(k) for k in KINDS])
    kinds = sum((F.when(F.size(k) > 0, 1 << i).otherwise(0) for i, k in enumerate(KINDS)), F.lit(0))
    each = F.concat(*[_numbered(F.col(k) if k == "times" else F.transform(k, F.lower), i) for i, k in enumerate(KINDS)])
    return lists.select("id", kinds.alias("kinds"), F.explode(each).alias("f")).groupBy("id", "kinds", F.col("f.kind").alias("kind"), F.col("f.value").alias("value")).agg(F.count("*").alias("n"))


def _numbered(values, kind: int):
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def view(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k facts that share most; ``index`` and ``queries`` are :func:`facets` of facts and of queries."""
    own = queries.select(F.col("id").alias("query_id"), F.col("kinds").alias("asked"), "kind", "value", F.col("n").alias("times"))
    hits = index.join(own, ["kind", "value"]).groupBy("query_id", "id", "asked", "kinds").agg(F.sum("times").alias("hits"))
    scored = hits.select("query_id", "id", (F.col("hits") / F.bit_count(F.col("asked").bitwiseAND(F.col("kinds")))).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)
