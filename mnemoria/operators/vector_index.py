"""A stored vector index: IVF lists of residual product codes, searched in two stages.

Vectors go, at length one, to the list of the centroid nearest by cosine; what
is left after the centroid is coded part by part. A search takes, for each
list that a query probes, the squared distances from what its rows' codes stand
for to what is left of the query there, as matrix products; each task keeps an
oversample of the nearest, and those are ranked by their exact cosine.

How many lists a query probes follows from the query: all whose centroid comes
within ``gap`` of its best one. The gap is measured when the index is trained:
a bounded sample of vectors is searched exactly, and the gap is the least that
reaches the lists of the wanted share of their true neighbours. A query left
with fewer than k rows is answered by a scan, as is every query of an index
that has fewer than ``train_min`` vectors and so no lists yet.

Fitted on samples of bounded size, by hash (``SAMPLE`` rows for centroids and
codes, ``ASKED`` queries for the gap); every row is indexed. Sent to tasks are
the centroids (checked against ``SENT``), the codebooks and a block of queries.

Writes are versions (``sources.versions``): rows of a write are a part of its
own, rows that it replaces or deletes are buried; older versions stay readable.
``maintain`` trains anew when vectors lie farther from their centroids than at
training, on average, or when many were appended.

Null vectors, nulls or non-finite numbers in them and vectors of another length
are not indexed; zero vectors are, at cosine 0 to all. Of rows with one id in a
write the least vector stays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vector as V
from ..sources import store, versions
from . import topk
from .nearest import Best, pairs

SAMPLE, ASKED = 50_000, 256
#: Bytes of centroids that are sent to each task.
SENT = 64 << 20
#: Queries that are searched at a time.
BLOCK = 8192
LIST = "id long, codes binary, residual_norm float, embedding array<float>, cluster int"
FLAT = "id long, embedding array<float>"


def usable(vectors: DataFrame, dimension: int | None = None) -> DataFrame:
    """(id, embedding): vectors that can be indexed, at length one."""
    x = F.col("embedding")
    good = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    ok = F.col("id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: good(e.cast("double")))
    rows = vectors.filter(ok if dimension is None else ok & (F.size(x) == dimension))
    one = rows.groupBy(F.col("id").cast("long").alias("id")).agg(F.min("embedding").alias("embedding"))
    return one.select("id", V.normalize(F.col("embedding")).cast("array<float>").alias("embedding"))


def cuts(d: int, m: int) -> list[slice]:
    """``m`` parts of d numbers; the last takes the remainder."""
    width = d // m
    return [slice(i * width, (i + 1) * width if i < m - 1 else d) for i in range(m)]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre by squared distance, ties to the lower."""
    return ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)


def fit_books(residuals: np.ndarray, m: int, bits: int, rounds: int = 8) -> list[np.ndarray]:
    """Lloyd's centres of each part of a sample (its size is bounded by the caller)."""
    books = []
    for cut in cuts(residuals.shape[1], m):
        x = residuals[:, cut]
        centres = x[np.linspace(0, len(x) - 1, min(1 << bits, len(x))).astype(int)]
        for _ in range(rounds):
            own = nearest(x, centres)
            n = np.bincount(own, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, own, x)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        books.append(centres)
    return books


def encode(x: np.ndarray, centroids: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, codes, norm of the residual) of each row; the list is that of the greatest inner product, ties to the lower."""
    cluster = (x @ centroids.T).argmax(1)
    left = x - centroids[cluster]
    codes = np.stack([nearest(left[:, cut], book) for cut, book in zip(cuts(x.shape[1], len(books)), books, strict=True)], axis=1)
    return cluster, codes.astype(np.uint8), np.linalg.norm(left, axis=1)


def matrix(column: pd.Series, d: int) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64) if len(column) else np.zeros((0, d))


class VectorIndex:
    """The index at ``path`` as of one version."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None, **expected):
        self.spark, self.path = spark, path
        self.about = versions.read(spark, path, version)
        wrong = {k: self.about.get(k) for k, v in expected.items() if self.about.get(k) != v}
        if wrong:
            raise ValueError(f"another index: {wrong}")

    @property
    def version(self) -> int:
        return self.about["version"]

    @property
    def trained(self) -> bool:
        return bool(self.about["centroids"])

    @staticmethod
    def create(spark: SparkSession, path: str, vectors: DataFrame, nlist: int | None = None, m: int = 8, bits: int = 8, train_min: int = 1000, share: float = 0.98, k: int = 10, model: str = "") -> VectorIndex:
        """A new index of ``vectors`` (id, embedding); ``share`` is how many true neighbours probed lists are to hold."""
        rows = store.stored(usable(vectors), "index-input")
        head = rows.agg(F.count("*").alias("n"), F.min(F.struct("id", F.size("embedding").alias("d")))["d"].alias("d")).first()
        n, d = head["n"], head["d"] or 0
        wishes = {"nlist": nlist, "m": min(m, max(d, 1)), "bits": min(bits, 8), "train_min": train_min, "share": share, "k": k, "model": model}
        about = wishes | {"dimension": d, "parts": [], "dead": [], "centroids": [], "books": [], "gap": None, "error": None, "trained_on": 0}
        rows = rows.filter(F.size("embedding") == d)
        return VectorIndex(spark, path, versions.publish(spark, path, about | _filled(spark, path, rows, n, about), 0))

    def lists(self) -> DataFrame:
        """(part, id, codes, residual_norm, embedding, cluster) of all parts, buried rows too; without lists, (part, id, embedding)."""
        out = None
        for i, path in enumerate(self.about["parts"]):
            own = self.spark.read.schema(LIST if self.trained else FLAT).parquet(path).select(F.lit(i).alias("part"), "*")
            out = own if out is None else out.unionByName(own)
        return out if out is not None else self.spark.createDataFrame([], f"part int, {LIST}")

    def dead(self) -> DataFrame:
        """(part, id) of buried rows."""
        paths = self.about["dead"]
        return self.spark.read.schema("part int, id long").parquet(*paths) if paths else self.spark.createDataFrame([], "part int, id long")

    def live(self) -> DataFrame:
        return self.lists().join(self.dead(), ["part", "id"], "left_anti")

    def _next(self, about: dict) -> VectorIndex:
        about = {k: v for k, v in (self.about | about).items() if k != "version"}
        return VectorIndex(self.spark, self.path, versions.publish(self.spark, self.path, about, self.version))

    def _bury(self, ids: DataFrame) -> list[str]:
        own = versions.part(self.path, "dead")
        self.live().select("part", "id").join(ids.select(F.col("id").cast("long")).distinct(), "id", "left_semi").select("part", "id").write.parquet(own)
        return [*self.about["dead"], own]

    def upsert(self, vectors: DataFrame) -> VectorIndex:
        """New and changed vectors go to the lists of the trained centroids. An index without lists is trained once it has ``train_min``."""
        rows = store.stored(usable(vectors, self.about["dimension"] or None), "index-input")
        dead = self._bury(rows)
        if not self.trained:
            own = versions.part(self.path, "vectors")
            rows.write.parquet(own)
            head = rows.agg(F.max(F.size("embedding"))).first()[0]
            grown = self._next({"parts": [*self.about["parts"], own], "dead": dead, "dimension": self.about["dimension"] or head or 0})
            return grown.rebuild() if grown.live().count() >= self.about["train_min"] else grown
        own = versions.part(self.path, "lists")
        _write_lists(rows, np.array(self.about["centroids"]), [np.array(b) for b in self.about["books"]], own)
        return self._next({"parts": [*self.about["parts"], own], "dead": dead})

    def delete(self, ids: DataFrame) -> VectorIndex:
        return self._next({"dead": self._bury(ids)})

    def rebuild(self) -> VectorIndex:
        """Trained anew on the live vectors, which become one part."""
        rows = store.stored(self.live().select("id", "embedding"), "index-input")
        return self._next({"dead": [], "parts": [], "centroids": [], "books": [], "gap": None} | _filled(self.spark, self.path, rows, rows.count(), self.about))

    def drift(self) -> tuple[float, float]:
        """Mean residual of live rows over that at training, and how many live rows were appended, as a share of what was trained on."""
        if not self.trained:
            return 1.0, 0.0
        said = self.live().agg(F.avg(F.col("residual_norm").cast("double")), F.count_if(F.col("part") > 0)).first()
        return (said[0] / self.about["error"] if said[0] and self.about["error"] else 1.0), said[1] / max(1, self.about["trained_on"])

    def maintain(self, most_drift: float = 1.25, most_appended: float = 0.5) -> VectorIndex:
        """This index, or one trained anew if vectors lie far from their centroids by now or many were appended."""
        farther, appended = self.drift()
        return self.rebuild() if farther > most_drift or appended > most_appended else self

    def stats(self) -> DataFrame:
        """(cluster, n) of live rows."""
        return self.live().groupBy("cluster").agg(F.count("*").alias("n"))

    def probes(self, queries: np.ndarray) -> np.ndarray:
        """For queries at length one, which lists each probes (a boolean matrix)."""
        near = queries @ np.array(self.about["centroids"]).T
        return near >= near.max(1, keepdims=True) - self.about["gap"] - 1e-9

    def scan(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, id, score, rank): the exact answer from all live rows."""
        return topk.exact_topk(self.live().select("id", "embedding"), queries.select("query_id", "query"), k).select("query_id", "id", "score", "rank")

    def search(self, queries: DataFrame, k: int = 10, oversample: int = 20) -> DataFrame:
        """(query_id, id, score, rank) by cosine held to [0, 1], ties to the lower id; ``queries`` has query_id and query.

        Blocks of ``BLOCK`` queries are searched one after the other, each
        written before the next is sent out.
        """
        if not self.trained:
            return self.scan(queries, k)
        n = queries.count()
        blocks = max(1, -(-n // BLOCK))
        out = store.scratch(self.spark, "index-found")
        for i in range(blocks):
            own = queries.select("query_id", "query").filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
            self._search_block(own, k, oversample).write.mode("append").parquet(out)
        found = self.spark.read.schema(f"query_id {dict(queries.dtypes)['query_id']}, id long, score double, rank int").parquet(out)
        short = queries.join(found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k), "query_id", "left_anti")
        if short.isEmpty():
            return found
        return found.join(short.select("query_id"), "query_id", "left_anti").unionByName(self.scan(short, k))

    def _search_block(self, queries: DataFrame, k: int, oversample: int) -> DataFrame:
        d = self.about["dimension"]
        rows = [r for r in queries.select(F.monotonically_increasing_id().alias("at"), "query_id", V.normalize(F.col("query")).alias("q")).collect() if r["q"] and len(r["q"]) == d]
        asked = np.array([r["q"] for r in rows], float).reshape(-1, d)
        probed = self.probes(asked) if len(rows) else np.zeros((0, len(self.about["centroids"])), bool)
        centroids, books = np.array(self.about["centroids"]), [np.array(b) for b in self.about["books"]]
        sent = self.spark.sparkContext.broadcast((asked, probed, centroids, books))
        keep = k * oversample

        def near(frames):
            asked, probed, centroids, books = sent.value
            best = Best(len(asked), keep)
            for frame in frames:
                codes = np.frombuffer(b"".join(frame["codes"]), np.uint8).reshape(len(frame), len(books))
                left = np.concatenate([book[codes[:, j]] for j, book in enumerate(books)], axis=1)
                ids, part = frame["id"].to_numpy(), frame["part"].to_numpy().astype(np.int64)
                for cluster, at in frame.groupby("cluster").indices.items():
                    which = np.flatnonzero(probed[:, cluster])
                    if not len(which):
                        continue
                    least = best.least[which]
                    for q, v, far in pairs("l2", left[at], asked[which] - centroids[cluster], keep, least, -1):
                        best.add(which[q], -far, ids[at[v]], part[at[v]])
                    best.least[which] = np.maximum(best.least[which], least)
            q, good, ids, part = best.sort()
            for i in range(0, len(q), 100_000):
                own = slice(i, i + 100_000)
                yield pd.DataFrame({"q": q[own].astype(np.int32), "part": part[own].astype(np.int32), "id": ids[own], "far": -good[own]})

        used = [int(c) for c in np.flatnonzero(probed.any(0))]
        lists = self.live().filter(F.col("cluster").isin(used))
        coded = lists.select("part", "id", "codes", "cluster").mapInPandas(near, "q int, part int, id long, far double")
        first = F.row_number().over(Window.partitionBy("q").orderBy("far", "id"))
        kept = coded.withColumn("r", first).filter(F.col("r") <= keep).select("q", "part", "id")
        names = self.spark.createDataFrame([(i, r["query_id"], r["q"]) for i, r in enumerate(rows)], f"q int, query_id {dict(queries.dtypes)['query_id']}, query array<double>")
        full = lists.select("part", "id", "embedding").join(kept, ["part", "id"]).join(F.broadcast(names), "q")  # BLOCK queries
        scored = full.withColumn("score", V.cosine_clamped(F.col("query"), F.col("embedding")))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "id"))
        return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def _filled(spark: SparkSession, path: str, rows: DataFrame, n: int, about: dict) -> dict:
    """The first part of an index and, where there are vectors enough, its training."""
    if n < max(about["train_min"], 2):
        own = versions.part(path, "vectors")
        rows.write.parquet(own)
        return {"parts": [own]}
    nlist = about["nlist"] or max(2, int(round(n**0.5)))
    sample = rows if n <= SAMPLE else rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(SAMPLE / n * (1 << 20)))
    sample = store.stored(sample, "index-sample")
    d = sample.select(F.size("embedding")).first()[0]
    if nlist * d * 8 > SENT:
        raise ValueError(f"{nlist} centroids of {d} numbers are more than {SENT} bytes")
    fitted = KMeans(k=nlist, maxIter=12, seed=7, distanceMeasure="euclidean").fit(sample.select(array_to_vector("embedding").alias("features")))
    centroids = np.array(fitted.clusterCenters())
    length = np.linalg.norm(centroids, axis=1, keepdims=True)
    centroids = centroids / np.where(length > 0, length, 1)
    held = matrix(sample.orderBy("id").toPandas()["embedding"], d)  # SAMPLE rows, about
    books = fit_books(held - centroids[(held @ centroids.T).argmax(1)], about["m"], about["bits"])
    own = versions.part(path, "lists")
    _write_lists(rows, centroids, books, own)
    error = spark.read.schema(LIST).parquet(own).agg(F.avg(F.col("residual_norm").cast("double"))).first()[0]
    gap = _gap(rows, centroids, n, about["k"], about["share"])
    return {"parts": [own], "centroids": centroids.tolist(), "books": [b.tolist() for b in books], "gap": gap, "error": error, "trained_on": n}


def _write_lists(rows: DataFrame, centroids: np.ndarray, books: list[np.ndarray], path: str) -> None:
    sent = rows.sparkSession.sparkContext.broadcast((centroids, books))

    def run(frames):
        for frame in frames:
            cluster, codes, norm = encode(matrix(frame["embedding"], sent.value[0].shape[1]), *sent.value)
            yield pd.DataFrame({"id": frame["id"], "codes": [c.tobytes() for c in codes], "residual_norm": norm.astype(np.float32), "embedding": frame["embedding"], "cluster": cluster.astype(np.int32)})

    coded = rows.select("id", "embedding").mapInPandas(run, LIST)
    spread = F.pmod(F.xxhash64("id"), F.lit(8))  # a list with most rows is eight tasks
    coded.repartition("cluster", spread).write.partitionBy("cluster").parquet(path)


def _gap(rows: DataFrame, centroids: np.ndarray, n: int, k: int, share: float) -> float:
    """How far below a query's best centroid the lists of ``share`` of its true neighbours lie, over ``ASKED`` vectors."""
    asked = rows.filter(F.pmod(F.xxhash64("id", F.lit("asked")), F.lit(1 << 30)) < int(min(1.0, ASKED / n) * (1 << 30))).limit(4 * ASKED).select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    asked = store.stored(asked, "index-asked")
    exact = topk.exact_topk(rows, asked, k + 1).filter("id <> query_id").select("query_id", "id")
    pairs = exact.join(rows, "id").join(asked, "query_id").select("query", "embedding").toPandas()  # ASKED * (k + 1) rows, about
    if not len(pairs):
        return 2.0
    near = matrix(pairs["query"], 0) @ centroids.T
    own = (matrix(pairs["embedding"], 0) @ centroids.T).argmax(1)
    return float(np.quantile(near.max(1) - near[np.arange(len(near)), own], share))
