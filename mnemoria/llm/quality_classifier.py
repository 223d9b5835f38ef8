"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Document statistics are standardised and mapped to ``n_features`` cosines,
whose inner products approximate a Gaussian kernel. Each partition sums its
part of the normal equations; the sums, of a size set by ``n_features`` alone,
are added up and solved. Scores on a fold that the regression didn't see are
made probabilities by pool-adjacent-violators over a histogram.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import docstats
from . import kernels as K
from .common import drop_table, replacing, write_table

BINS = 2000
LOW, HIGH = -0.5, 1.5


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """A row of numbers for each document, from its counts."""
    c = {k: v.astype(float) for k, v in c.items()}
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1)
    letters, lines = np.maximum(c["n_letters"], 1), np.maximum(c["n_word_lines"], 1)
    return np.stack([
        np.log1p(c["n_words"]), np.minimum(c["word_chars"] / words, 40), np.minimum(c["n_symbols"] / words, 4), c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
        c["n_distinct_words"] / words, c["n_upper"] / letters, c["n_digits"] / chars, np.minimum(c["n_punct"] / words, 4), np.minimum(c["n_bangs"] / words, 4), np.minimum(c["n_pipes"] / words, 4),
        np.log1p(c["n_words"] / lines), c["n_wide"] / chars, c["n_letters"] / chars], 1)


N_STATS = 14


class Model:
    def __init__(self, n_features: int = 256, width: float = 2.5, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w = rng.normal(size=(N_STATS, n_features)) / width
        self.b = rng.uniform(0, 2 * np.pi, n_features)
        self.mean, self.sd = np.zeros(N_STATS), np.ones(N_STATS)
        self.beta = np.zeros(n_features + 1)
        self.x, self.y = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def lift(self, f: np.ndarray) -> np.ndarray:
        z = np.clip((f - self.mean) / self.sd, -8, 8)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / self.w.shape[1]), np.ones((len(f), 1))])

    def raw(self, f: np.ndarray) -> np.ndarray:
        return self.lift(f) @ self.beta

    def score(self, f: np.ndarray) -> np.ndarray:
        """Calibrated, and never flat: the raw score breaks ties within a level."""
        raw = self.raw(f)
        return np.clip(0.98 * np.interp(raw, self.x, self.y) + 0.02 * np.clip((raw - LOW) / (HIGH - LOW), 0, 1), 0, 1)


def _counts(batch) -> dict[str, np.ndarray]:
    return {n: batch.column(batch.schema.get_field_index(n)).to_numpy() for n in docstats.NAMES}


def _summed(rows: DataFrame, part) -> np.ndarray:
    """The sum over partitions of what ``part`` makes of a batch, a matrix; its rows are added up in the cluster."""

    def partial(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = part(batch)
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total))], ["i", "v"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [group["i"].iloc[0]], "v": [np.sum(np.stack(group["v"].to_list()), 0)]})

    found = rows.mapInArrow(partial, "i long, v array<double>").groupBy("i").applyInPandas(add, "i long, v array<double>").toPandas()
    return np.stack(found.sort_values("i")["v"].to_list()) if len(found) else np.zeros((0, 0))


def pool(n: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Pool-adjacent-violators: nondecreasing shares of positives, weighted by n."""
    level, weight, width = [], [], []
    for k, p in zip(n, positive, strict=True):
        level.append(p / k)
        weight.append(k)
        width.append(1)
        while len(level) > 1 and level[-2] >= level[-1]:
            w = weight[-2] + weight[-1]
            level[-2:] = [(level[-2] * weight[-2] + level[-1] * weight[-1]) / w]
            weight[-2:] = [w]
            width[-2:] = [width[-2] + width[-1]]
    return np.repeat(level, width)


def fold(doc_id: Column) -> Column:
    """0 to 4; fold 0 is held out, fold 1 calibrates."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")


def fit(stats: DataFrame, labels: DataFrame, max_labelled: int = 200_000, n_features: int = 256, ridge: float = 1e-3) -> Model:
    """Learns labels.quality from the labelled rows outside fold 0; of those, about ``max_labelled`` at most, by hash."""
    model, spark = Model(n_features), stats.sparkSession
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.min("quality").cast("double").alias("__label"))
    n = known.count()
    if n > max_labelled:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(max_labelled / n * (1 << 20)))
    rows = stats.join(known, "doc_id").select("__label", fold(F.col("doc_id")).alias("__fold"), *docstats.NAMES)
    rows, path = write_table(rows, "quality-train")
    train, calibrate = rows.filter("__fold <> 1"), rows.filter("__fold = 1")

    def moments(batch):
        f = features(_counts(batch))
        return np.stack([f.sum(0), (f * f).sum(0), np.full(N_STATS, float(len(f)))])

    sums = _summed(train, moments)
    if not sums.size:
        drop_table(spark, path)
        return model
    count = sums[2, 0]
    model.mean = sums[0] / count
    model.sd = np.sqrt(np.maximum(sums[1] / count - model.mean**2, 0))
    model.sd[model.sd < 1e-9] = 1.0

    def normal(batch):
        z = model.lift(features(_counts(batch)))
        y = batch.column(batch.schema.get_field_index("__label")).to_numpy()
        return np.hstack([z.T @ z, (z.T @ y)[:, None]])

    sums = _summed(train, normal)
    penalty = np.full(n_features + 1, ridge * count)
    penalty[-1] = 1e-9
    model.beta = np.linalg.solve(sums[:, :-1] + np.diag(penalty / n_features), sums[:, -1])

    def histogram(batch):
        at = np.clip(((model.raw(features(_counts(batch))) - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
        y = batch.column(batch.schema.get_field_index("__label")).to_numpy()
        return np.stack([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)]).astype(float)

    held = _summed(calibrate, histogram)
    if held.size:
        some = held[0] > 0
        model.x = (np.flatnonzero(some) + 0.5) / BINS * (HIGH - LOW) + LOW
        model.y = pool(held[0][some], held[1][some])
    else:
        model.x, model.y = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    drop_table(spark, path)
    return model


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fitting) -> DataFrame:
    """The columns of ``docs`` but text, then held_out, score (0 to 1; higher: label 1 likelier) and predicted (1 if score >= threshold).

    Only the text is an input of the score. Null and empty texts are scored by
    their zero counts; repeated rows get equal scores; without usable labels
    every score is about a half; a document labelled twice counts as 0 if it is
    once; an empty table gives an empty one; input columns with the added names
    give way.
    """
    docs = replacing(docs, "held_out", "score", "predicted")
    names = [c for c in docs.columns if c != "text"]
    stats, _ = write_table(docstats.with_stats(docs.select("text", *[F.col(f"`{c}`").alias(c if c == "doc_id" else f"c{i}") for i, c in enumerate(names)])), "classifier-stats")
    shared = docs.sparkSession.sparkContext.broadcast(fit(stats, labels, **fitting))
    drop = set(docstats.NAMES)

    def scored(batches):
        for batch in batches:
            kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n not in drop]
            score = shared.value.score(features(_counts(batch))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(score)], [*(n for n, _ in kept), "score"])

    kept = [f for f in stats.schema.fields if f.name not in drop]
    out = stats.mapInArrow(scored, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", score double")
    return out.select(*[F.col(f.name).alias(n) for f, n in zip(kept, names, strict=True)], (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fitting) -> DataFrame:
    """The rows of ``docs`` that :func:`score_documents` predicts 1, in their own columns; texts aren't shuffled.

    Null and empty texts are judged by their zero counts, texts of any length
    by all of theirs; repeated rows stay or go together; without usable labels
    every row stays at a threshold up to a half; an empty table gives an empty
    one; any column names will do, as only doc_id and text are read.
    """
    stats, path = write_table(docstats.with_stats(docs.select("doc_id", "text")), "classifier-stats")
    shared = docs.sparkSession.sparkContext.broadcast(fit(stats, labels, **fitting))
    drop_table(docs.sparkSession, path)

    def good(batches):
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            for lo, hi, data, offsets in K.text_slices(text):
                keep = shared.value.score(features(docstats.slice_stats(data, offsets))) >= threshold
                yield batch.slice(lo, hi - lo).filter(pa.array(keep))

    return docs.mapInArrow(good, docs.schema)
