"""Soft-membership mixing to target weights.

A logistic classifier over the hashed words and word ends that tell domains
apart, fitted on labelled documents, gives every document a posterior over
domains. Document rates
r >= 0 then minimise the (relative) squared distance between the expected
tokens of each domain, sum(r * tokens * posterior), and their targets, by
projected gradient from r = 1, with Nesterov's momentum, which starts anew
where the distance grows. A step needs one sum over the corpus, a number
for each domain; a document's rate is replayed from the list of gradients, so
no rates are stored between steps.
"""

from __future__ import annotations

import itertools
import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import drop_table, replacing, with_fields, write_table

BUCKETS = 1 << 15
MAX_DOMAINS = 64
MAX_FEATURES = 512
DEVIATION = 4.0
ADDED = ("n_tokens", "posterior", "rate", "copies")


def doc_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct buckets (row, bucket) and its number of words."""
    start, end, first = K.words(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    word = K.Prefix(K.LOWER[data])(start, end)
    last = K.mix(K.Prefix(data)(np.maximum(start, end - 2), end) + K.U(1))
    bucket = np.concatenate([word, last]) & K.U(BUCKETS - 1)
    pairs = np.unique(np.concatenate([row, row]) * BUCKETS + bucket.astype(np.int64))
    # how varied the words are and how much is in capitals, in steps
    n_words, rows = np.diff(first), np.arange(len(offsets) - 1)
    variety = np.bincount(pairs // BUCKETS, minlength=len(rows)) * 8 // np.maximum(2 * n_words, 1)
    capitals = K.row_sums((data >= 65) & (data <= 90), offsets) * 8 // np.maximum(np.diff(offsets), 1)
    extra = [K.mix(step.astype(np.uint64) + K.U(salt)) & K.U(BUCKETS - 1) for step, salt in ((variety, 1000), (capitals, 2000))]
    pairs = np.unique(np.concatenate([pairs, *(rows * BUCKETS + x.astype(np.int64) for x in extra)]))
    return pairs // BUCKETS, pairs % BUCKETS, n_words


class Labelled:
    """Domain numbers by document id, as two arrays."""

    def __init__(self, ids: np.ndarray, domain: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.domain = ids[order], domain[order]

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, self.domain[at], -1)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.fill_null(-(1 << 62)).to_numpy()


def _bucket_counts(batches, known):
    """(domain, bucket, n) over the labelled documents of a partition; bucket -1 counts documents."""
    parts = []
    for batch in batches:
        domain = known.value(_numbers(batch.column(0)))
        take = np.flatnonzero(domain >= 0)
        if len(take):
            own = domain[take]
            for lo, hi, data, offsets in K.text_slices(batch.column(1).take(pa.array(take))):
                row, bucket, _ = doc_features(data, offsets)
                parts.append(own[lo:hi][row] * (BUCKETS + 1) + bucket + 1)
                parts.append(own[lo:hi] * (BUCKETS + 1))
    if parts:
        key, n = np.unique(np.concatenate(parts), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array((key // (BUCKETS + 1)).astype(np.int32)), pa.array((key % (BUCKETS + 1) - 1).astype(np.int32)), pa.array(n)], ["domain", "bucket", "n"])


def _active(batches, chosen, keep_text: bool = False):
    """Tokens, and which of the chosen features a document has."""
    place = np.full(BUCKETS, -1)
    place[chosen.value] = np.arange(len(chosen.value))
    for batch in batches:
        where = batch.schema.get_field_index("text")
        others = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if keep_text or i != where]
        for lo, hi, data, offsets in K.text_slices(batch.column(where)):
            row, bucket, tokens = doc_features(data, offsets)
            at = place[bucket]
            ends = np.append(0, np.cumsum(np.bincount(row[at >= 0], minlength=hi - lo))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(at[at >= 0].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for _, c in others), pa.array(tokens.astype(np.int64)), lists], [*(n for n, _ in others), "n_tokens", "active"])


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def logistic(x: np.ndarray, y: np.ndarray, k: int, ridge: float = 1.0, rounds: int = 400) -> np.ndarray:
    """Weights (features + 1, k) by accelerated gradient descent on the penalised log loss."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    goal = np.eye(k, dtype=x.dtype)[y]
    step = 1 / (0.5 * np.linalg.norm(x, 2) ** 2 + ridge)
    w = v = np.zeros((x.shape[1], k), x.dtype)
    for i in range(rounds):
        new = v - step * (x.T @ (softmax(x @ v) - goal) + ridge * np.vstack([v[:-1], 0 * v[-1:]]))
        w, v = new, new + i / (i + 3) * (new - w)
    return w.astype(float)


class Fitted:
    """Posterior from a document's features, and the rate that the gradients so far give."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.steps: list[tuple[np.ndarray, float]] = []

    def posterior(self, active: pa.Array) -> np.ndarray:
        size = active.value_lengths().to_numpy().astype(np.int64)
        flat = active.flatten().to_numpy()
        row = np.repeat(np.arange(len(size)), size)
        return softmax(np.stack([np.bincount(row, w[flat], len(size)) + w[-1] for w in self.weights.T], 1))

    def rates(self, posterior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rates after all steps, and the point ahead of them from which the next one starts."""
        r = ahead = np.ones(len(posterior))
        for gradient, momentum in self.steps:
            new = np.maximum(0.0, ahead - posterior @ gradient)
            r, ahead = new, new + momentum * (new - r)
        return r, ahead

    def rate(self, posterior: np.ndarray) -> np.ndarray:
        return self.rates(posterior)[0]


def _arrays(batch) -> tuple[np.ndarray, pa.Array]:
    at = batch.schema.get_field_index
    return batch.column(at("n_tokens")).to_numpy().astype(float), batch.column(at("active"))


def _totals(table: DataFrame, shared, what) -> np.ndarray:
    """The sum over the table of what ``what`` makes of (tokens, posterior, fitted)."""

    def part(batches):
        total = None
        for batch in batches:
            n, active = _arrays(batch)
            if len(n):
                x = what(n, shared.value.posterior(active), shared.value)
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["i", "v"])

    rows = table.select("n_tokens", "active").mapInArrow(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    return rows.sort_values("i")["v"].to_numpy()


def fit_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], total: float | None, max_labelled: int, steps: int | None, tolerance: float):
    """The fitted classifier and rates, the chosen features (both broadcast), and the table of documents' features."""
    spark, names = docs.sparkSession, sorted(targets)
    k = len(names)
    if not 0 < k <= MAX_DOMAINS:
        raise ValueError(f"1 to {MAX_DOMAINS} domains, not {k}")
    send = spark.sparkContext.broadcast
    use = labels.filter(F.col("doc_id").isNotNull() & F.col("domain").isin(names)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    n = use.count()
    if n > max_labelled:
        use = use.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < int(max_labelled / n * (1 << 20)))
    rows = use.select(F.col("doc_id").cast("long").alias("doc_id"), "domain").toPandas()
    ids, domain = rows["doc_id"].to_numpy(np.int64), rows["domain"].map({d: i for i, d in enumerate(names)}).to_numpy(np.int64)
    known = send(Labelled(ids, domain))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = own.mapInArrow(lambda it: _bucket_counts(it, known), "domain int, bucket int, n long").groupBy("domain", "bucket").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros((k, BUCKETS + 1))
    seen[counts["domain"].to_numpy(int), counts["bucket"].to_numpy(int) + 1] = counts["n"].to_numpy(float)
    n_docs = seen[:, 0]
    share = (seen[:, 1:] + 0.5) / (n_docs[:, None] + 1)
    overall = (seen[:, 1:].sum(0) + 0.5) / (n_docs.sum() + 1)
    z = (share - overall) / np.sqrt(overall * (1 - np.minimum(overall, 0.999)) / np.maximum(n_docs, 1)[:, None])
    tell = np.where(n_docs[:, None] > 0, np.abs(z), 0).max(0)
    chosen = np.argsort(-tell, kind="stable")[:MAX_FEATURES]
    chosen = send(chosen[tell[chosen] > DEVIATION])
    columns = [c for c in docs.columns if c != "text"]
    inner = docs.select("text", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col("doc_id").cast("long").alias("__id"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields if f.name != "text")
    table, path = write_table(inner.mapInArrow(lambda it: _active(it, chosen), f"{kinds}, n_tokens long, active array<int>"), "mixing")

    def sample(batches):
        for batch in batches:
            d = known.value(_numbers(batch.column(0)))
            some = pa.array(d >= 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(some), pa.array(d[d >= 0].astype(np.int32)), batch.column(1).filter(some)], ["id", "domain", "active"])

    rows = table.select("__id", "active").mapInArrow(sample, "id long, domain int, active array<int>")
    rows = rows.groupBy("id").agg(F.min(F.struct("active", "domain")).alias("r")).select("r.*").toPandas()  # a row for each sampled id
    weights = np.zeros((len(chosen.value) + 1, k))
    if len(rows):
        x = np.zeros((len(rows), len(chosen.value)), np.float32)
        for i, own in enumerate(rows["active"]):
            x[i, own] = 1
        weights = logistic(x, rows["domain"].to_numpy(int), k)
    fitted = Fitted(weights)
    first = _totals(table, send(fitted), lambda n, p, _: np.concatenate([(p * n[:, None]).sum(0), ((p * n[:, None]).T @ p).ravel()]))
    if len(first):
        natural, gram = first[:k], first[k:].reshape(k, k)
        goal = np.array([targets[d] for d in names], float)
        goal = goal / goal.sum() * (natural.sum() if total is None else total)
        scale = np.linalg.pinv(gram, rcond=1e-10, hermitian=True)  # the metric in which a step of 1 is safe, as no rate's share of the Hessian exceeds the Gram matrix
        current, ahead, allowed, settled, age, history = natural, natural, tolerance * max(1.0, goal.sum()), False, 1.0, []
        for _ in itertools.count() if steps is None else range(steps):
            if settled := np.abs(current - goal).max() <= allowed:
                break
            history.append(max(0.0, float((current - goal) @ scale @ (current - goal))))  # 0 (but for rounding) where what is left is out of reach
            if settled := history[-1] <= 1e-12 * float(goal @ scale @ goal) or len(history) > 12 and history[-1] >= 0.9 * history[-12]:  # as near as nonnegative rates come
                break
            grew = len(history) > 1 and history[-1] > history[-2]
            older, age = 1.0 if grew else age, (1 + math.sqrt(1 + 4 * (1.0 if grew else age) ** 2)) / 2
            fitted.steps.append((scale @ (ahead - goal), (older - 1) / age))
            both = _totals(table, send(fitted), lambda n, p, f: np.stack([n @ (p * r[:, None]) for r in f.rates(p)]))
            current, ahead = both[:k], both[k:]
        if (left := float(np.abs(current - goal).max())) > allowed:
            warnings.warn(f"{'no step brings rates nearer' if settled else f'rates have not settled in {steps} steps'}: a domain's expected tokens miss their target by {left:.6g} of {goal.sum():.6g}", RuntimeWarning, stacklevel=3)
    return send(fitted), chosen, table, path


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], total: float | None = None, max_labelled: int = 20_000, steps: int | None = None, tolerance: float = 1e-5, seed: int = 0) -> DataFrame:
    """The columns of ``docs`` but text, n_tokens, posterior (array in the order of sorted(targets)), rate and copies.

    ``labels`` has doc_id and domain (one of ``targets``' keys; other rows are
    not used). ``total`` is the sum of the targets in tokens, by default the
    corpus's. ``copies`` rounds the rate by a coin that doc_id and ``seed``
    fix. Descent ends when all targets are met to ``tolerance`` of the total, or
    when a dozen steps bring the squared distance down by less than a tenth; a RuntimeWarning gives the
    distance left where targets are out of reach (or, if ``steps`` is given, not met by then). About ``max_labelled`` labelled rows, by hash, fit the classifier; a
    domain without any has no posterior. Null and empty texts have no tokens
    and the prior as posterior; repeated rows get equal rates; an empty table
    gives an empty one; input columns with the added names give way.
    """
    docs = replacing(docs, *ADDED)
    k, columns = len(targets), [c for c in docs.columns if c != "text"]
    final, _, table, _ = fit_rates(docs, labels, targets, total, max_labelled, steps, tolerance)

    def rated(batches):
        for batch in batches:
            kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n not in ("active", "__id")]
            p = final.value.posterior(_arrays(batch)[1])
            lists = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), k).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), lists, pa.array(final.value.rate(p))], [*(n for n, _ in kept), "posterior", "rate"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields if f.name not in ("active", "__id"))
    out = table.mapInArrow(rated, f"{kinds}, posterior array<double>, rate double")
    named = {c: F.col(f"c{i}") for i, c in enumerate(columns)}
    return out.select(*[v.alias(c) for c, v in named.items()], "n_tokens", "posterior", "rate", copies(named["doc_id"], F.col("rate"), seed).alias("copies"))


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float], total: float | None = None, max_labelled: int = 20_000, steps: int | None = None, tolerance: float = 1e-5, seed: int = 0) -> DataFrame:
    """``docs`` as :func:`mix` rates them: each row as often as its copies say, in its own columns.

    Nulls, empty and long texts, repeated rows and an empty table are treated
    as there; any column names will do, as only doc_id and text are read.
    """
    final, chosen, _, path = fit_rates(docs, labels, targets, total, max_labelled, steps, tolerance)
    drop_table(docs.sparkSession, path)
    names = docs.columns
    inner = docs.toDF(*["text" if c == "text" else f"c{i}" for i, c in enumerate(names)])

    def rated(batches):
        for batch in batches:
            for part in _active(iter([batch]), chosen, keep_text=True):
                rate = final.value.rate(final.value.posterior(_arrays(part)[1]))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in batch.schema.names), pa.array(rate)], [*batch.schema.names, "__rate"])

    out = inner.mapInArrow(rated, with_fields(inner, __rate="double"))
    n = copies(F.col(f"c{names.index('doc_id')}"), F.col("__rate"), seed)
    return out.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), n))).drop("__copy", "__rate").toDF(*names)


def copies(doc_id: Column, rate: Column, seed: int = 0) -> Column:
    """The rate, rounded up or down by a coin that the id fixes."""
    coin = F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return (F.floor(rate) + (coin < rate - F.floor(rate)).cast("long")).cast("int")
