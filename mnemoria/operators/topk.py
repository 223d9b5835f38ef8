"""Vector top-k: exact, pre-filtered, paged, and under a token budget. A query set is always a DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vector as V


#: Scores that tasks find by matrix products.
KINDS = {V.cosine_clamped: "clamped", V.cosine: "cosine", V.dot: "dot", V.l2_squared: "l2"}
#: The most rows that a task holds of a query; more are passed on as they are found.
HELD = 4096


def plain(x: Column, d: int) -> Column:
    """Vectors of ``d`` numbers whose products neither overflow nor vanish."""
    return F.coalesce((F.size(x) == d) & F.forall(x, lambda e: e.isNotNull() & (F.abs(e.cast("double")) < 1e70) & ((e == 0) | (F.abs(e.cast("double")) > 1e-70))), F.lit(False))


def _scored(vectors: DataFrame, queries: DataFrame, score, digits: int | None, min_score: float | None, block: int, n: int) -> DataFrame:
    """All pairs of a vector and a query, by column expressions; for the few rows that are no plain vectors and for scores of the caller's own."""
    blocks = max(1, -(-n // block))
    parts = [queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) for i in range(blocks)]
    own = score(F.col("query"), F.col("embedding"))
    pairs = reduce(DataFrame.unionByName, [vectors.crossJoin(F.broadcast(p)) for p in parts]).withColumn("score", own if digits is None else F.round(own, digits))
    return (pairs if min_score is None else pairs.filter(F.col("score") >= min_score)).drop("query", "embedding")


def _near(vectors: DataFrame, asked, names: list, of, kind: str, k: int, sign: int, digits, min_score, schema: str) -> DataFrame:
    """The rows of each task that may be among a query's ``k`` best. ``asked``: queries as a matrix; ``of``: None, or a boolean matrix of which list (column ``cluster``) each looks into."""
    sent = vectors.sparkSession.sparkContext.broadcast((asked, names, of))
    carried = [c for c in vectors.columns if c not in ("embedding", "cluster")]
    small = "query_id int," in schema

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .nearest import Best, pairs

        asked, names, of = sent.value
        names = pa.array(names, pa.int32() if small else None)
        best, tables, seen = Best(len(asked), k), [], 0

        def shaped(rows: pa.Table, q, score):
            out = rows.append_column("query_id", names.take(pa.array(q))).append_column("score", pa.array(score))
            return out.combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            rows = pa.Table.from_batches([batch]).select(carried)
            if of is None:
                lists = [(None, None)]
            else:
                cluster = batch.column("cluster").to_numpy(zero_copy_only=False)
                lists = [(np.flatnonzero(of[:, c]), np.flatnonzero(cluster == c)) for c in np.unique(cluster)]
            if k > HELD:
                for which, own in lists:
                    for q, v, score in pairs(kind, x, asked, k, best.least, sign, digits, min_score, which, own):
                        yield from shaped(rows.take(pa.array(v)), q, score)
                continue
            for which, own in lists:
                for q, v, score in pairs(kind, x, asked, k, best.least, sign, digits, min_score, which, own):
                    best.add(q, sign * score, ids[v], v + seen)
            tables.append(rows)
            seen += len(ids)
            if seen > 100_000:  # only rows that are still held stay
                q, good, own, load = best.sort()
                kept, load = np.unique(load, return_inverse=True)
                best.held, tables, seen = [(q, good, own, load)], [pa.concat_tables(tables).take(pa.array(kept))], len(kept)
        if tables:
            q, good, _, load = best.sort()
            yield from shaped(pa.concat_tables(tables).take(pa.array(load)), q, sign * good)

    return vectors.mapInArrow(run, schema)


def _pairs(vectors: DataFrame, queries: DataFrame, k: int, score, min_score: float | None, ascending: bool, block: int, digits: int | None) -> DataFrame:
    """Pairs with their scores, among them the ``k`` best of each query; ``queries`` may name the lists (clusters) that a query looks into."""
    import numpy as np

    types, kind = dict(vectors.dtypes), KINDS.get(score)
    head = queries.agg(F.count("*").alias("n"), F.mode(F.size("query")).alias("d")).first()
    d = head["d"] or 0
    listed = "clusters" in queries.columns
    if kind is None or d <= 0 or types["id"] not in ("bigint", "int") or types["embedding"] not in ("array<float>", "array<double>") or set(queries.columns) - {"query_id", "query", "clusters"}:
        if listed:
            queries = queries.withColumn("cluster", F.explode("clusters")).drop("clusters")
            own = score(F.col("query"), F.col("embedding"))
            return vectors.join(queries, "cluster").withColumn("score", own if digits is None else F.round(own, digits)).drop("query", "embedding", "cluster")
        return _scored(vectors, queries, score, digits, min_score, block, head["n"])
    carried = [f for f in vectors.schema.fields if f.name not in ("embedding", "cluster")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carried), f"query_id {dict(queries.dtypes)['query_id']}", "score double"])
    is_plain, good = plain(F.col("query"), d), vectors.filter(plain(F.col("embedding"), d))
    if head["n"] >= 500:  # few files hold many vectors, and each meets all queries
        good = good.repartition(2 * vectors.sparkSession.sparkContext.defaultParallelism, "id")
    blocks = max(1, -(-head["n"] // block))
    parts = []
    for i in range(blocks):
        own = queries.filter(is_plain & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)).toPandas()  # ``block`` rows, about
        if not len(own):
            continue
        asked, of = np.stack(own["query"].to_list()).astype(np.float64), None
        if listed:
            of = np.zeros((len(own), 1 + max(max(c) for c in own["clusters"])), bool)
            for row, c in enumerate(own["clusters"]):
                of[row, c] = True
            inside = good.filter(F.col("cluster") < of.shape[1])
        parts.append(_near(inside if listed else good, asked, own["query_id"].to_list(), of, kind, k, -1 if ascending else 1, digits, min_score, schema))
    odd = vectors.filter(~plain(F.col("embedding"), d))
    strange = queries.filter(~is_plain)
    for v, q in ((odd, queries), (vectors.filter(plain(F.col("embedding"), d)), strange)):
        if not (odd if q is queries else strange).isEmpty():
            if listed:
                q = q.withColumn("cluster", F.explode("clusters")).drop("clusters")
                own = score(F.col("query"), F.col("embedding"))
                parts.append(v.join(q, "cluster").withColumn("score", own if digits is None else F.round(own, digits)).drop("query", "embedding", "cluster"))
            else:
                parts.append(_scored(v, q, score, digits, min_score, block, head["n"]))
    if not parts:
        return vectors.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, score=V.cosine_clamped, min_score: float | None = None, ascending: bool = False, block: int = 10_000, digits: int | None = None) -> DataFrame:
    """(query_id, id, score, rank) by score, ties to the lower id; ``queries`` has query_id and query. Scores are rounded to ``digits`` first, if given.

    Queries are sent to the tasks, ``block`` of them at a time (their number is
    counted first); each task finds the best k of its own vectors by matrix
    products (``nearest``), and only k rows per query and task are shuffled.
    """
    pairs = _pairs(vectors, queries, k, score, min_score, ascending, block, digits)
    order = F.asc("score") if ascending else F.desc("score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def within(vectors: DataFrame, queries: DataFrame, min_score: float, score=V.cosine_clamped, block: int = 10_000, digits: int | None = None) -> DataFrame:
    """(query_id, id, score) of all pairs at ``min_score`` or more, as they are found: nothing is sorted or shuffled."""
    return _pairs(vectors, queries, HELD + 1, score, min_score, False, block, digits)


def listed_topk(vectors: DataFrame, queries: DataFrame, k: int, score=V.cosine_clamped, digits: int | None = None, block: int = 10_000) -> DataFrame:
    """As :func:`exact_topk`, where each vector has a ``cluster`` and each query the ``clusters`` (array) that it looks into."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return _pairs(vectors, queries, k, score, None, False, block, digits).withColumn("rank", rank).filter(F.col("rank") <= k)


def prefiltered_topk(facts: DataFrame, query: Column, k: int, pool: int, score=V.cosine, min_score: float | None = None, text_order: str = "created_at") -> DataFrame:
    """The ``pool`` most important and newest first, and only those are scored; not an exact search."""
    first = facts.orderBy(F.desc("importance"), F.desc(text_order), F.desc("id")).limit(pool)
    out = first.withColumn("score", score(query, F.col("embedding")))
    if min_score is not None:
        out = out.filter(F.col("score") >= min_score)
    return out.orderBy(F.desc("score"), "id").limit(k)


def paged_recent(memories: DataFrame, query: Column, k: int = 5, min_score: float = 0.3, page: int = 200, pages: int = 5) -> DataFrame:
    """Newest first in pages, up to the page that brings the hits to 3 * k; then the k best."""
    recent = memories.filter(F.col("embedding").isNotNull() & ~F.col("compressed")).orderBy(F.desc("created_at"), F.desc("id")).limit(page * pages)
    scored = recent.withColumn("score", V.cosine(query, F.col("embedding")))
    scored = scored.withColumn("page", F.floor((F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id"))) - 1) / page))
    hits = scored.groupBy("page").agg(F.count_if(F.col("score") >= min_score).alias("hits"))
    before = hits.withColumn("before", F.coalesce(F.sum("hits").over(Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("before") < 3 * k)
    return scored.filter(F.col("score") >= min_score).join(F.broadcast(before.select("page")), "page").orderBy(F.desc("score"), "id").limit(k)


def within_budget(ranked: DataFrame, tokens: Column, budget: int, order: list, partition: list[str] | None = None) -> DataFrame:
    """The longest prefix whose tokens fit; a budget of 0 or less lets all through."""
    if budget <= 0:
        return ranked
    w = Window.partitionBy(*(partition or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("running_tokens", F.sum(tokens).over(w)).filter(F.col("running_tokens") <= budget)


def label_centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """(label, dim, mean): the average vector of each label, a row per dimension."""
    return vectors.select(label, F.posexplode("embedding").alias("dim", "x")).groupBy(label, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def centroid_arrays(vectors: DataFrame, label: str = "label") -> DataFrame:
    rows = label_centroids(vectors, label)
    return rows.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("centroid"))
