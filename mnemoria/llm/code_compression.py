"""Vector code compression: product codes whose nearest entries are found behind segment-mean lower bounds.

A vector of integers is cut into equal parts, each coded by the nearest of its
codebook's entries. For a stretch of L components with means m and residual
norms r (what is left of a stretch after its mean), the squared distance is at
least L (m_x - m_c)^2 + (r_x - r_c)^2, summed over stretches. The bounds are
taken coarse to fine: one stretch a part, then two, four and eight. An entry whose
bound exceeds an exact distance already found is out; survivors get exact
integer distances. Bounds are doubles, so a slack above their rounding error
keeps each filter conservative; ties go to the lower index.

Rows: vectors that are null, empty, or hold null or non-finite components take
no part, nor do vectors of another length than the one with the smallest id
(repeated ids: the least vector). A length that the number of parts does not
divide is filled up with zeros. Repeated rows count each; a null id is coded
but starts no codebook unless there are too few others. Columns other than
those named may have any name. An empty table gives an empty result. Scaled
components must stay under 2**27, where all sums fit 64 bits; beyond, ValueError.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table

MOST = 1 << 27
CHUNK = 2048


def features(x: np.ndarray, blocks: int) -> np.ndarray:
    """For each row its stretches' means times sqrt(L), then their residual norms: squared distances of these are the lower bounds."""
    n, d = x.shape
    blocks = blocks if d % blocks == 0 else 1
    parts = x.reshape(n, blocks, d // blocks)
    length, sums = d // blocks, parts.sum(axis=2)
    left = length * np.einsum("nbl,nbl->nb", parts, parts) - sums * sums  # exact: the residual's square times L
    return np.concatenate([sums / np.sqrt(length), np.sqrt(left / length)], axis=1)


class Codebook:
    """Entries of one part (k x d integers) and their features at each level."""

    LEVELS = (1, 2, 4, 8)

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.levels = [features(entries, b) for b in self.LEVELS]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (ties: the lowest) and its exact squared distance, for each row."""
        index, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for lo in range(0, len(x), CHUNK):
            index[lo : lo + CHUNK], error[lo : lo + CHUNK] = self._chunk(x[lo : lo + CHUNK])
        return index, error

    def exact(self, x: np.ndarray, row: np.ndarray, entry: np.ndarray) -> np.ndarray:
        gap = x[row] - self.entries[entry]
        return np.einsum("ij,ij->i", gap, gap)

    def _chunk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        every = np.arange(len(x))
        alive, best = None, None
        for level, own in zip(self.LEVELS, self.levels, strict=True):
            mine = features(x, level)
            mine2, own2 = np.einsum("ij,ij->i", mine, mine), np.einsum("ij,ij->i", own, own)
            bound = mine2[:, None] - 2 * (mine @ own.T) + own2[None, :]
            seems = self.exact(x, every, bound.argmin(axis=1))  # of the entry that looks nearest: no farther one can win
            best = seems if best is None else np.minimum(best, seems)
            slack = 1e-12 * (mine2.max() + own2.max()) + 1e-6  # far above what rounding adds to a bound
            near = bound <= (best + slack)[:, None]
            alive = near if alive is None else alive & near
        row, entry = np.nonzero(alive)
        distance = self.exact(x, row, entry)
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        least = np.minimum.reduceat(distance, first)
        hit = np.flatnonzero(distance == least[row])  # in order of entries, so a row's first is its lowest
        win = hit[np.flatnonzero(np.append(True, row[hit][1:] != row[hit][:-1]))]
        return entry[win], least


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def integers(vectors: DataFrame, vector: str, scale: float, parts: int) -> DataFrame:
    """(vec_id, label, n, v): vectors with their length, scaled, floored and filled up."""
    x = F.col(vector)
    good = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    kept = vectors.filter(x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: good(e.cast("double"))))
    kept = kept.select("vec_id", "label", F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))
    # a NULL-safe flag beside the cast, so that a value out of range is an error with a name
    top = F.aggregate("v", F.lit(0).cast("long"), lambda a, e: F.greatest(a, F.abs(e)))
    v = F.when(top < MOST, F.col("v")).otherwise(F.raise_error(F.lit(f"a scaled component reaches {MOST}")).cast("array<bigint>"))
    more = F.pmod(-F.size("v"), F.lit(parts))
    return kept.select("vec_id", "label", F.size("v").alias("n"), F.concat(v, F.array_repeat(F.lit(0).cast("long"), more)).cast("array<int>").alias("v"))


def compress(vectors: DataFrame, vector: str = "embedding", scale: float = 1024.0, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each vector that takes part.

    ``vectors`` has vec_id, label and ``vector``. Codebooks start as the parts of
    the ``entries`` smallest ids and are moved ``rounds`` times. A round reads all
    rows and returns sums for parts x entries, which tasks add up first; they and
    the codebooks (parts x entries x length / parts integers) are all that the
    driver holds or sends.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits a part: 256 entries at most")
    spark = vectors.sparkSession
    rows, _ = write_table(integers(vectors, vector, scale, parts), "codes-input")
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v", "n")
    head = start.limit(1).collect()
    if not head:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    n, width = head[0]["n"], len(head[0]["v"]) // parts
    rows = rows.filter(F.col("n") == n)
    first = np.array([r["v"] for r in start.filter(F.col("n") == n).limit(entries).collect()], np.int64)
    books = [first[:, p * width : (p + 1) * width] for p in range(parts)]
    for _ in range(rounds):
        books = moved(rows, books)
    text = ",".join(str(x) for book in books for x in book.ravel().tolist())
    own = [Codebook(b) for b in books]

    def code(batches):
        for batch in batches:
            x = matrix(batch.column("v"))
            found = [own[p].nearest(np.ascontiguousarray(x[:, p * width : (p + 1) * width])) for p in range(parts)] if len(x) else []
            if found:
                raw = np.stack([i for i, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                codes = [raw[i : i + 2 * parts] for i in range(0, len(raw), 2 * parts)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes), pa.array(sum(e for _, e in found))], ["vec_id", "label", "code", "error"])

    coded, _ = write_table(rows.select("vec_id", "label", "v").mapInArrow(code, f"vec_id {dict(rows.dtypes)['vec_id']}, label {dict(rows.dtypes)['label']}, code string, error long"), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def moved(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks after one round: each entry becomes the floored mean of the parts nearest to it; an unused one stays."""
    width, parts = books[0].shape[1], len(books)
    own = [Codebook(b) for b in books]

    def sums(batches):
        count = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            x = matrix(batch.column(0))
            for p in range(parts) if len(x) else ():
                part = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
                index, _ = own[p].nearest(part)
                count[p] += np.bincount(index, minlength=len(books[p]))
                order = np.argsort(index, kind="stable")
                used, at = np.unique(index[order], return_index=True)
                total[p][used] += np.add.reduceat(part[order], at, axis=0)
        for p in range(parts):
            used = np.flatnonzero(count[p])
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(count[p][used]), pa.array(list(total[p][used]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    out = [b.copy() for b in books]
    added = rows.select("v").mapInArrow(sums, "part int, entry int, n long, total array<long>").groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(width)]).alias("total"))
    for r in added.collect():
        out[r["part"]][r["entry"]] = [t // r["n"] for t in r["total"]]
    return out
