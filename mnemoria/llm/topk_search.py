"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Vectors become integers, floor(scale * x), and are packed as they are read
into shards of a few thousand, each with its ball tree. Queries go out in
blocks of a fixed number. For a query, a node's bound is its centre's inner
product plus the query's norm times the radius; a node's children are visited
in the order of their bounds, and only while the bound reaches the query's
current kth score. That score is shared: a pilot sample gives every task the
same start, and it rises through all shards that a task searches.
"""

from __future__ import annotations

import io
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import write_table

LOWEST = -(1 << 63)
NO_ID = (1 << 63) - 1
EXACT = 2.0**53


def build_tree(v: np.ndarray, ids: np.ndarray, leaf: int) -> dict[str, np.ndarray]:
    """Vectors ordered so that each node is a range; nodes as centre, radius, range and children (-1: leaf)."""
    order = np.arange(len(v))
    centre, radius, span, child = [], [], [], []

    def node(lo: int, hi: int) -> int:
        x = v[order[lo:hi]]
        c = x.mean(0)
        far = np.sqrt(((x - c) ** 2).sum(1))
        me = len(centre)
        centre.append(c)
        radius.append(far.max())
        span.append((lo, hi))
        child.append((-1, -1))
        if hi - lo <= leaf or not far.max():
            own = order[lo:hi]
            order[lo:hi] = own[np.argsort(ids[own], kind="stable")]
            return me
        a = x[far.argmax()]
        b = x[((x - a) ** 2).sum(1).argmax()]
        own = order[lo:hi]
        order[lo:hi] = own[np.argsort(x @ (b - a), kind="stable")]
        mid = (lo + hi) // 2
        child[me] = (node(lo, mid), node(mid, hi))
        return me

    node(0, len(v))
    return {"v": v[order], "ids": ids[order], "centre": np.array(centre), "radius": np.array(radius), "span": np.array(span), "child": np.array(child)}


class Search:
    """The k best of all trees shown to it, for a block of queries."""

    def __init__(self, q: np.ndarray, ids: np.ndarray, floor: np.ndarray, k: int):
        self.q, self.ids, self.k = q, ids, k
        self.norm = np.sqrt((q * q).sum(1))
        self.floor = floor  # a score that k candidates are known to reach
        self.score = np.full((len(q), k), LOWEST, np.int64)
        self.vec = np.full((len(q), k), NO_ID, np.int64)
        self.visits = 0

    def kth(self, some: np.ndarray) -> np.ndarray:
        return np.maximum(self.floor[some], self.score[some, -1]).astype(float)

    def bound(self, tree: dict, node: int, some: np.ndarray) -> np.ndarray:
        upper = self.q[some] @ tree["centre"][node] + self.norm[some] * tree["radius"][node]
        return upper + 1e-9 * np.abs(upper) + 1e-6 * (1 + self.norm[some])  # never below the true one

    def visit(self, tree: dict, node: int, some: np.ndarray, bound: np.ndarray) -> None:
        some = some[bound >= self.kth(some)]
        if not len(some):
            return
        left, right = tree["child"][node]
        if left < 0:
            return self.scan(tree, node, some)
        bl, br = self.bound(tree, left, some), self.bound(tree, right, some)
        first = bl >= br
        for near, far, mask, bn, bf in ((left, right, first, bl, br), (right, left, ~first, br, bl)):
            if mask.any():
                self.visit(tree, near, some[mask], bn[mask])
                self.visit(tree, far, some[mask], bf[mask])

    def scan(self, tree: dict, node: int, some: np.ndarray) -> None:
        lo, hi = tree["span"][node]
        v, ids = tree["v"][lo:hi], tree["ids"][lo:hi]
        self.visits += len(some) * (hi - lo)
        for at in range(0, hi - lo, 4096):  # a leaf of equal vectors may be long
            x, own = v[at : at + 4096], ids[at : at + 4096]
            if len(x) and float(np.abs(x).max(initial=0)) * float(np.abs(self.q[some]).max(initial=0)) * x.shape[1] >= EXACT:
                exact = np.array([[sum(int(a) * int(b) for a, b in zip(r, y, strict=True)) for y in x] for r in self.q[some]], object)
                s = np.clip(exact, LOWEST + 1, NO_ID).astype(np.int64)
            else:
                s = (self.q[some] @ x.T).astype(np.int64)
            s[own[None, :] == self.ids[some][:, None]] = LOWEST
            better = s.max(1) >= self.kth(some) if len(x) else np.zeros(len(some), bool)
            if not better.any():
                continue
            who, s = some[better], s[better]
            best = np.argsort(~s, axis=1, kind="stable")[:, : self.k]  # ~s falls as s rises; ids rise within a leaf
            score = np.hstack([self.score[who], np.take_along_axis(s, best, 1)])
            vec = np.hstack([self.vec[who], np.where(np.take_along_axis(s, best, 1) == LOWEST, NO_ID, own[best])])
            keep = np.lexsort((vec, ~score), axis=1)[:, : self.k]
            self.score[who], self.vec[who] = np.take_along_axis(score, keep, 1), np.take_along_axis(vec, keep, 1)

    def add(self, tree: dict) -> None:
        everyone = np.arange(len(self.q))
        if len(everyone):
            self.visit(tree, 0, everyone, self.bound(tree, 0, everyone))


def integers(batch, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and floor(scale * x) by dimension."""
    ids = batch.column(0).to_numpy()
    column = batch.column(1)
    size = column.value_lengths().to_numpy().astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    start = np.cumsum(size) - size
    return {int(d): (ids[size == d], np.floor(scale * flat[start[size == d][:, None] + np.arange(d)[None, :]])) for d in np.unique(size)}


def usable(vectors: DataFrame) -> DataFrame:
    ok = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(ok)


def _pack(batches, scale: float, rows: int, leaf: int):
    """Shards of up to ``rows`` vectors, with their trees, as they come."""
    held: dict[int, list] = {}

    def out(d: int):
        ids, v = (np.concatenate(x) for x in zip(*held.pop(d), strict=True))
        for at in range(0, len(ids), rows):
            buffer = io.BytesIO()
            small = len(v) and float(np.abs(v).max(initial=0)) < 32000
            tree = build_tree(v[at : at + rows], ids[at : at + rows], leaf)
            tree["v"] = tree["v"].astype(np.int16 if small else np.float64)
            np.savez(buffer, **tree)
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([buffer.getvalue()])], ["dim", "tree"])

    for batch in batches:
        for d, (ids, v) in integers(batch, scale).items():
            held.setdefault(d, []).append((ids, v))
            if sum(len(x[0]) for x in held[d]) >= rows:
                yield from out(d)
    for d in list(held):
        yield from out(d)


def load_tree(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as z:
        tree = {k: z[k] for k in z.files}
    tree["v"] = tree["v"].astype(float)
    return tree


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, shard_rows: int = 4096, leaf: int = 128, block: int = 65_536) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k best candidates by integer inner product, ties to the smaller vec_id.

    Both tables have vec_id and embedding (arrays of any number type). A
    candidate is any row but those with the query's id. Rows whose id or vector
    is null, or whose vector holds a null or non-finite component, take no
    part; vectors of another length are no candidates; an empty vector's scores
    are 0; repeated rows are candidates each; a query row repeated gives its
    answer twice; fewer than k candidates give all; scores beyond 64 bits are
    held at the limit. ``block`` queries at most are broadcast at a time.
    """
    spark = vectors.sparkSession
    good = usable(vectors)
    shards, _ = write_table(good.mapInArrow(lambda it: _pack(it, scale, shard_rows, leaf), "dim int, tree binary"), "shards")
    asked = usable(queries)
    n, n_asked = good.count(), asked.count()
    sample = good.filter(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // shard_rows))) == 0).limit(shard_rows)
    pilots = {d: build_tree(v, ids, leaf) for b in sample.toArrow().to_batches() for d, (ids, v) in integers(b, scale).items() if len(ids)}
    out = []
    blocks = max(1, -(-n_asked // block))
    for i in range(blocks):
        own = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)) == i)
        parts: dict[int, list] = {}
        for b in own.toArrow().to_batches():
            for d, x in integers(b, scale).items():
                parts.setdefault(d, []).append(x)
        packed = {}
        for d, x in parts.items():
            ids, q = (np.concatenate(y) for y in zip(*x, strict=True))
            start = Search(q, ids, np.full(len(ids), LOWEST, np.int64), k)
            if d in pilots:
                start.add(pilots[d])
            packed[d] = (q, ids, start.score[:, -1].copy())
        sent = spark.sparkContext.broadcast(packed)
        hits = shards.mapInArrow(_Task(sent, k), "dim int, q int, query_id long, vec_id long, score long").withColumn("block", F.lit(i))
        if blocks > 1:  # one after the other, so that the driver and the executors hold one block
            hits, _ = write_table(hits, "hits")
            sent.destroy()
        out.append(hits)
    found = reduce(DataFrame.unionAll, out)
    rank = F.row_number().over(Window.partitionBy("block", "dim", "q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Task:
    """Searches all shards of a partition, one after the other, with one current kth score for each query."""

    def __init__(self, shared, k: int):
        self.shared, self.k = shared, k

    def __call__(self, batches):
        searches = {d: Search(q, ids, floor, self.k) for d, (q, ids, floor) in self.shared.value.items()}
        for batch in batches:
            for d, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if d in searches:
                    searches[d].add(load_tree(raw.as_py()))
        for d, s in searches.items():
            row, col = np.nonzero((s.vec != NO_ID) & (s.score >= s.floor[:, None]))
            columns = [np.full(len(row), d, np.int32), row.astype(np.int32), s.ids[row], s.vec[row, col], s.score[row, col]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dim", "q", "query_id", "vec_id", "score"])
