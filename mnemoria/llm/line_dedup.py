"""Line dedup: lines that many documents share are dropped everywhere.

Lines are exploded and hashed (128 bits), a hash's documents are counted, and
documents are put together again, by position, without the lines whose count
reaches the threshold. Only distinct hashes of a document are counted, so the
shuffle moves 16 bytes for each distinct line, combined map-side first; texts
never leave their partition as long as the dropped hashes stay under
``broadcast_limit`` (a checked size). Beyond it, the lines' (document,
position, hash) are joined with the dropped hashes by a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import drop_table, plain, replacing, with_fields, write_table

HASHES = "h1 long, h2 long"
STRIPPED = bytes([32, 9, 10, 11, 12, 13])


def line_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each row, in order: start, end, (n, 2) key hashes, key lengths in code points, and each row's first line."""
    n, rows = len(data), len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    first = np.zeros(rows + 1, np.int64)
    np.cumsum(1 + np.diff(np.searchsorted(breaks, offsets)), out=first[1:])
    # strip: the nearest non-white byte at or after the start, and at or before the end
    black = np.flatnonzero(~K.WHITE[data])
    left, right = np.searchsorted(black, start), np.searchsorted(black, end) - 1
    full = left <= right
    at = lambda i: black[np.clip(i, 0, max(len(black) - 1, 0))] if len(black) else np.zeros(len(i), np.int64)
    lo = np.where(full, at(left), start)
    hi = np.where(full, at(right) + 1, start)
    low = K.LOWER[data]
    keys = np.stack([K.Prefix(low, lane)(lo, hi) for lane in (0, 1)], 1) if n else np.zeros((len(start), 2), np.uint64)
    points = np.zeros(n + 1, np.int64)
    np.cumsum(K.code_points(data), out=points[1:])
    return start, end, keys.view(np.int64), points[hi] - points[lo], first


def distinct_keys(batches, min_chars: int):
    """Each document's distinct line keys."""
    for batch in batches:
        for _, _, data, offsets in K.text_slices(batch.column(0)):
            _, _, keys, size, first = line_keys(data, offsets)
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
            keep = size >= min_chars
            order = np.lexsort((keys[keep, 1], keys[keep, 0], row[keep]))
            keys, row = keys[keep][order], row[keep][order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (keys[1:] != keys[:-1]).any(1)
            yield pa.RecordBatch.from_arrays([pa.array(keys[new, 0]), pa.array(keys[new, 1])], ["h1", "h2"])


class Without:
    """Joins lines again, without those in the given keys (pairs sorted by their first half)."""

    def __init__(self, keys, min_chars: int):
        self.keys, self.min_chars = keys, min_chars

    def member(self, lines: np.ndarray) -> np.ndarray:
        dropped = self.keys.value
        out = np.zeros(len(lines), bool)
        if not len(dropped) or not len(lines):
            return out
        at = np.searchsorted(dropped[:, 0], lines[:, 0])
        todo = np.arange(len(lines))
        while len(todo):  # keys that agree in their first half stand next to each other
            here = at[todo]
            todo = todo[(here < len(dropped)) & (dropped[np.minimum(here, len(dropped) - 1), 0] == lines[todo, 0])]
            hit = dropped[at[todo], 1] == lines[todo, 1]
            out[todo[hit]] = True
            todo = todo[~hit]
            at[todo] += 1
        return out

    def __call__(self, batches):
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            text = batch.column(batch.schema.get_field_index("text"))
            null = text.is_null().to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in K.text_slices(text):
                start, end, keys, size, first = line_keys(data, offsets)
                gone = self.member(keys) & (size >= self.min_chars)
                lost = K.row_sums(gone, first)
                raw = data.tobytes()
                for i in range(hi - lo):
                    a, b = first[i], first[i + 1]
                    if not lost[i]:
                        texts.append(None if null[lo + i] else raw[offsets[i] : offsets[i + 1]].decode())
                    else:
                        texts.append(b"\n".join(raw[start[j] : end[j]] for j in range(a, b) if not gone[j]).decode())
                n_lines.append(np.diff(first))
                n_dropped.append(lost)
            columns = [pa.array(texts, pa.string()) if name == "text" else batch.column(i) for i, name in enumerate(batch.schema.names)]
            long = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, long(n_lines), long(n_dropped)], [*batch.schema.names, "n_lines", "n_dropped"])


def common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(h1, h2, n_docs) of the lines that at least ``min_docs`` rows hold."""
    keys = docs.select("text").mapInArrow(lambda it: distinct_keys(it, min_chars), HASHES)
    return keys.groupBy("h1", "h2").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= min_docs)


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, broadcast_limit: int = 2_000_000) -> DataFrame:
    """``docs`` with lines of ``min_docs`` documents or more taken out of ``text``, plus n_lines (before) and n_dropped.

    A line's key is the line without white space at both ends, A-Z lower-cased;
    keys shorter than ``min_chars`` code points stay. Each row counts as a
    document, so rows that repeat a text or a doc_id count again; a line counts
    once in a row. Texts of any length are taken whole. Null and empty texts have one empty
    line; null stays null. An empty table gives an empty one. Input columns
    named n_lines or n_dropped are replaced. ``broadcast_limit`` dropped keys
    (16 bytes each) are sent to every executor at most; more are joined by a
    shuffle, with the same result.
    """
    docs = replacing(docs, "n_lines", "n_dropped")
    spark = docs.sparkSession
    found, path = write_table(common_lines(docs, min_docs, min_chars).select("h1", "h2"), "lines")
    schema = with_fields(docs, n_lines="long", n_dropped="long")
    if found.count() <= broadcast_limit:
        rows = found.toPandas()
        drop_table(spark, path)
        keys = rows[["h1", "h2"]].to_numpy(np.int64).reshape(-1, 2)
        keys = keys[np.argsort(keys[:, 0], kind="stable")]
        return docs.mapInArrow(Without(spark.sparkContext.broadcast(keys), min_chars), schema)
    return _by_shuffle(docs, found, min_chars).select([f.name for f in schema])


def _split_rows(batches, min_chars: int):
    for batch in batches:
        rowid = batch.column(0).to_numpy()
        for lo, hi, data, offsets in K.text_slices(batch.column(1)):
            _, _, keys, size, first = line_keys(data, offsets)
            n = np.diff(first)
            row = np.repeat(rowid[lo:hi], n)
            pos = np.arange(len(row)) - np.repeat(first[:-1], n)
            ok = size >= min_chars
            yield pa.RecordBatch.from_arrays([pa.array(row[ok]), pa.array(pos[ok]), pa.array(keys[ok, 0]), pa.array(keys[ok, 1])], ["__row", "pos", "h1", "h2"])


def _without_positions(batches, names: list[str]):
    """Texts again, without the lines at the given positions."""
    for batch in batches:
        at = batch.schema.get_field_index
        text, gone = batch.column(at("text")), batch.column(at("__gone"))
        texts, n_lines, n_dropped = [], [], []
        for one, lost in zip(text.to_pylist(), gone.to_pylist(), strict=True):
            lines = (one or "").split("\n")
            lost = set(lost or ())
            texts.append("\n".join(x for i, x in enumerate(lines) if i not in lost) if lost else one)
            n_lines.append(len(lines))
            n_dropped.append(len(lost))
        columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(at(n)) for n in names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])


def _by_shuffle(docs: DataFrame, found: DataFrame, min_chars: int) -> DataFrame:
    """The way for more dropped keys than may be broadcast: positions travel, and each text once."""
    inner, names = plain(docs, "text")
    kept, _ = write_table(inner.withColumn("__row", F.monotonically_increasing_id()), "lines-rows")
    lines = kept.select("__row", "text").mapInArrow(lambda it: _split_rows(it, min_chars), "__row long, pos long, " + HASHES)
    gone = lines.join(found, ["h1", "h2"], "left_semi").groupBy("__row").agg(F.collect_list("pos").alias("__gone"))
    out = kept.join(gone, "__row", "left").mapInArrow(lambda it: _without_positions(it, list(names)), with_fields(inner, n_lines="long", n_dropped="long"))
    return out.toDF(*names.values(), "n_lines", "n_dropped")
