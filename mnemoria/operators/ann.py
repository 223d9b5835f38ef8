"""IVF index with product-quantised codes, as two tables: centroids(cluster, centroid) and postings(id, cluster, codes, residual_norm)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vector as V
from .topk import listed_topk


def seeds(vectors: DataFrame, nlist: int) -> DataFrame:
    """(cluster, centroid): rows at evenly spaced ranks of the id; ranks come from counts of id ranges, not one sort in one task."""
    n = vectors.count()
    nlist = min(nlist, n)
    if not nlist:
        return vectors.sparkSession.createDataFrame([], "cluster int, centroid array<double>")
    ids = vectors.select("id")
    step = n / nlist
    at = ids.selectExpr(f"percentile_disc(0.0) within group (order by id) as low") if nlist == 1 else ids.select(F.expr("percentile_approx(id, array(" + ",".join(str(min(1.0, (int(i * step) + 1) / n)) for i in range(nlist)) + "), 1000000)").alias("low"))
    picked = at.select(F.posexplode(F.array("low") if nlist == 1 else F.col("low")).alias("cluster", "id"))
    return vectors.join(F.broadcast(picked), "id").select("cluster", F.transform("embedding", lambda x: x.cast("double")).alias("centroid"))


def assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, cluster, score): the nearest centroid by cosine, ties to the lower cluster; centroids (nlist rows) are broadcast."""
    pairs = vectors.crossJoin(F.broadcast(centroids)).withColumn("score", V.cosine_clamped(F.col("embedding"), F.col("centroid")))
    return pairs.groupBy("id").agg(F.max_by("cluster", F.struct("score", -F.col("cluster"))).alias("cluster"), F.max("score").alias("score"))


def train(vectors: DataFrame, nlist: int = 64, rounds: int = 4) -> DataFrame:
    """Lloyd rounds from the seeds: assign, average, normalise; an empty cluster keeps its centroid."""
    centroids = seeds(vectors, nlist)
    spark = vectors.sparkSession
    for _ in range(rounds):
        own = vectors.join(assign(vectors, centroids).select("id", "cluster"), "id")
        means = own.select("cluster", F.posexplode("embedding").alias("dim", "x")).groupBy("cluster", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))
        new = means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("new"))
        rows = centroids.join(new, "cluster", "left").select("cluster", V.normalize(F.coalesce("new", "centroid")).alias("centroid")).collect()  # nlist rows
        centroids = spark.createDataFrame(rows, "cluster int, centroid array<double>")
    return centroids


def probe(postings: DataFrame, centroids: DataFrame, queries: DataFrame, nprobe: int, k: int) -> DataFrame:
    """(query_id, id, score, rank): the nearest ``nprobe`` lists, then exact scores to six digits. ``postings``: id, cluster, embedding."""
    near = queries.crossJoin(F.broadcast(centroids)).withColumn("c", V.cosine(F.col("query"), F.col("centroid")))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("c"), "cluster"))).filter(F.col("r") <= nprobe).select("query_id", "query", "cluster")
    asked = near.groupBy("query_id").agg(F.first("query").alias("query"), F.collect_set("cluster").alias("clusters"))
    return listed_topk(postings.select("id", "embedding", "cluster"), asked, k, V.cosine_clamped, 6).select("query_id", "id", "score", "rank")


def codebook(vectors: DataFrame, m: int, bits: int, rounds: int = 4, sample: int = 20_000) -> DataFrame:
    """(part, code, centre): Lloyd in each subspace, from a bounded sample by hash; the last part takes the remainder."""
    n = vectors.count()
    if n > sample:
        vectors = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(n)) < sample)
    d = F.size("embedding")
    width = F.floor(d / m).cast("int")
    parts = vectors.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.slice("embedding", i * width + 1, F.when(i == m - 1, d - i * width).otherwise(width)))).alias("part", "x"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        x = np.stack(group.sort_values("id")["x"].to_list()).astype(float)
        c = x[[int(i * len(x) / 2**bits) for i in range(2**bits)]]
        for _ in range(rounds):
            own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        return pd.DataFrame({"part": group["part"].iloc[0], "code": range(len(c)), "centre": list(c)})

    return parts.groupBy("part").applyInPandas(fit, "part int, code int, centre array<double>")


def encode(vectors: DataFrame, book: DataFrame, m: int) -> DataFrame:
    """(id, codes): the nearest centre of each part by squared distance; the book (m * 2^bits rows) is broadcast."""
    d = F.size("embedding")
    width = F.floor(d / m).cast("int")
    parts = vectors.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.slice("embedding", i * width + 1, F.when(i == m - 1, d - i * width).otherwise(width)))).alias("part", "x"))
    near = parts.join(F.broadcast(book), "part").withColumn("d2", V.l2_squared(F.col("x"), F.col("centre")))
    best = near.groupBy("id", "part").agg(F.min_by("code", F.struct("d2", "code")).alias("code"), F.min("d2").alias("d2"))
    return best.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "code"))), lambda s: s["code"]).alias("codes"), F.sum("d2").alias("distortion"))


def adc_score(codes: DataFrame, book: DataFrame, query: DataFrame, m: int) -> DataFrame:
    """(id, score): 1 / (1 + the summed table distances) of a query (one row, query) by codes alone."""
    d = F.size("query")
    width = F.floor(d / m).cast("int")
    parts = query.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.slice("query", i * width + 1, F.when(i == m - 1, d - i * width).otherwise(width)))).alias("part", "q"))
    table = book.join(F.broadcast(parts), "part").select("part", "code", V.l2_squared(F.col("q"), F.col("centre")).alias("d2"))
    rows = codes.select("id", F.posexplode("codes").alias("part", "code")).join(F.broadcast(table), ["part", "code"])
    return rows.groupBy("id").agg((F.lit(1.0) / (F.sum("d2") + 1)).alias("score"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall, top1): the share of the exact answer that was found."""
    hits = exact.select("query_id", "id", F.col("rank").alias("r")).join(found.select("query_id", "id", F.col("rank").alias("fr")), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg(F.avg(F.col("fr").isNotNull().cast("int")).alias("recall"), F.max(((F.col("r") == 1) & (F.col("fr") == 1)).cast("int")).alias("top1"))


def index_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("cluster").agg(F.count("*").alias("n"))


def save(path: str, centroids: DataFrame, postings: DataFrame, **about: str) -> None:
    """The index as Parquet: lists partitioned by cluster, so that a probe reads only its own."""
    spark = centroids.sparkSession
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    postings.write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/postings")
    spark.createDataFrame([(k, str(v)) for k, v in sorted(about.items())] or [("version", "1")], "key string, value string").write.mode("overwrite").parquet(f"{path}/about")


def load(spark, path: str, **expected: str) -> tuple[DataFrame, DataFrame]:
    """(centroids, postings), if the index is the expected one (dimension, model, version)."""
    about = {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/about").collect()}
    wrong = {k: about.get(k) for k, v in expected.items() if about.get(k) != str(v)}
    if wrong:
        raise ValueError(f"another index: {wrong}")
    return spark.read.parquet(f"{path}/centroids"), spark.read.parquet(f"{path}/postings")


def upsert(postings: DataFrame, centroids: DataFrame, vectors: DataFrame) -> DataFrame:
    """New or changed vectors go to the existing centroids' lists; older rows of theirs leave."""
    new = vectors.join(assign(vectors, centroids).select("id", "cluster"), "id")
    return postings.join(vectors.select("id"), "id", "left_anti").unionByName(new.select(postings.columns))
