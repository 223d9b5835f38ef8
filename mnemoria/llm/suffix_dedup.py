"""Repeated strings by prefix-free parsing.

A position where a rolling hash of ``w`` bytes falls under a threshold is a
trigger; triggers cut a text into phrases that overlap by ``w`` bytes, so
phrases depend on what they hold and not on where they stand. The distinct
phrases are the dictionary, a text's row of phrases its parse. A string of
``length`` bytes that stands in two places has the same whole phrases in both,
so it holds none that the dictionary counts once: that leaves few starts.

For those, an order of all suffixes is needed only as far as it tells equal
``length``-byte prefixes. A start is a suffix of a dictionary phrase followed
by a suffix of the parse. Starts that share their phrase are taken together:
where the phrase with all that follows, as far as their strings reach, stands
twice, all of them repeat, and thousands of copies cost what one does. What is
left are the edges of repeated passages; there the class of each start's string
is found one by one, against the other edges and against inner starts that a
bitmap says may match. Classes are 128-bit fingerprints; no text is sorted, and
no position but those of edges is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap
from . import kernels as K
from .common import drop_table, replacing, with_fields, write_table

W = 10
EVERY = 24
ADDED = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept": "binary"}


def triggers(data: np.ndarray, offsets: np.ndarray, prefix: K.Prefix) -> np.ndarray:
    """Where the hash of the next W bytes, all of one row, is under an EVERYth of its range."""
    n = len(data) - W + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(prefix.windows(W) < K.PRIME // K.U(EVERY))
    return at[at + W <= offsets[np.searchsorted(offsets, at, side="right")]]


def phrases(data: np.ndarray, offsets: np.ndarray, prefix: K.Prefix) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Triggers, then starts, ends and hashes of the phrases between neighbouring triggers of a row."""
    at = triggers(data, offsets, prefix)
    row = np.searchsorted(offsets, at, side="right")
    same = np.flatnonzero(row[1:] == row[:-1])
    lo, hi = at[same], at[same + 1] + W
    return at, lo, hi, prefix(lo, hi)


def candidates(data: np.ndarray, offsets: np.ndarray, prefix: K.Prefix, repeated: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which places may begin a repeated string (no whole phrase in it is unique), and the triggers."""
    n = len(data)
    at, lo, hi, key = phrases(data, offsets, prefix)
    unique = ~bitmap.contains(repeated, key)
    a, b = hi[unique] - length, lo[unique]
    begin = offsets[np.searchsorted(offsets, b, side="right") - 1]
    a = np.maximum(a, begin)
    some = a <= b
    cover = np.cumsum(np.bincount(a[some], minlength=n + 1)[: n + 1] - np.bincount(b[some] + 1, minlength=n + 1)[: n + 1])
    out = cover[:n] == 0
    for_row = np.diff(offsets)
    room = np.zeros(n + 1, np.int64)  # places with ``length`` bytes left in their row
    np.add.at(room, offsets[:-1], (for_row >= length).astype(np.int64))
    np.add.at(room, np.maximum(offsets[1:] - length + 1, offsets[:-1])[for_row >= length], -1)
    return out & (np.cumsum(room)[:n] > 0), at


def units(may: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of candidate places that share their next trigger."""
    n = len(may)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = K.row_starts(n, offsets)
    cut[np.minimum(at + 1, n)] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = may[:-1] & ~cut[1:n], may[1:] & ~cut[1:n]
    return np.flatnonzero(may & ~before), np.flatnonzero(may & ~after) + 1


def _phrase_keys(batches):
    for batch in batches:
        for _, _, data, offsets in K.text_slices(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(phrases(data, offsets, K.Prefix(data))[3].view(np.int64))], ["phrase"])


def _by_affected(batches, repeated, length: int, wanted: bool):
    """Rows that have candidate places (or those that have none)."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        keep = []
        for lo, _, data, offsets in K.text_slices(text):
            may, _ = candidates(data, offsets, K.Prefix(data), repeated.value, length)
            hit = K.row_sums(may, offsets) > 0
            keep.append(lo + np.flatnonzero(hit == wanted))
        if keep and len(rows := np.concatenate(keep)):
            yield batch.take(pa.array(rows))


def _units(batches, repeated, length: int):
    """Each unit's row, places and what its strings cover, hashed."""
    for batch in batches:
        uid = batch.column(0).to_numpy()
        for first, _, data, offsets in K.text_slices(batch.column(1)):
            prefix = K.Prefix(data)
            may, at = candidates(data, offsets, prefix, repeated.value, length)
            lo, hi = units(may, at, offsets)
            row = np.searchsorted(offsets, lo, side="right") - 1
            two = [p(lo, hi - 1 + length).view(np.int64) for p in (prefix, K.Prefix(data, 1))]
            columns = [uid[first + row], (lo - offsets[row]).astype(np.int32), (hi - offsets[row]).astype(np.int32), *two]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["uid", "lo", "hi", "c1", "c2"])


class RowWindows:
    """The starts in the given runs of a text, and one lane of their strings' hashes at a time."""

    def __init__(self, text: bytes, lo: np.ndarray, hi: np.ndarray, length: int):
        n = hi - lo
        self.data, self.length = np.frombuffer(text, np.uint8), length
        self.at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))

    def keys(self, lane: int, some=slice(None)) -> np.ndarray:
        at = self.at[some]
        prefix = K.Prefix(self.data, lane)
        if 2 * len(at) > len(self.data):  # in a row, without fetching sums one by one
            return prefix.every(self.length)[at]
        return prefix(at, at + self.length)


def _judged_rows(batch):
    names = batch.schema.names
    uid, text, runs = (batch.column(names.index(c)) for c in ("uid", "text", "units"))
    ends = runs.offsets.to_numpy()
    flat = runs.values
    lo, hi, again = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    for i in range(batch.num_rows):
        part = slice(ends[i], ends[i + 1])
        yield i, uid[i].as_py(), text[i].as_py().encode(), lo[part].astype(np.int64), hi[part].astype(np.int64), again[part].astype(bool)


#: Windows that go out at a time.
OUT = 1 << 17


def _windows(batches, length: int, inner: bool, near=None, keys_only: bool = False):
    """Edge (or inner) starts whose class ``near`` may hold, one for each different string of a row, with its number."""

    def out(parts):
        keys, uid, at, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(uid), pa.array(at), pa.array(n)], ["h1", "h2", "uid", "at", "n"])

    for batch in batches:
        parts, halves, held = [], [], 0
        for _, uid, text, lo, hi, again in _judged_rows(batch):
            own = again if inner else ~again
            if own.any():
                windows = RowWindows(text, lo[own], hi[own], length)
                at, one = windows.at, windows.keys(0)
                if near is not None:
                    hit = np.flatnonzero(bitmap.contains(near.value, one))
                    if not len(hit):
                        continue
                    at, one = at[hit], one[hit]
                if keys_only:  # half a key will do: a string that a row holds twice counts twice
                    one.sort()
                    new = np.append(True, one[1:] != one[:-1])
                    halves.append(one[new | np.append(True, new[:-1])].view(np.int64))
                    held += len(halves[-1])
                    if held >= OUT:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(halves))], ["h1"])
                        halves, held = [], 0
                    continue
                keys = np.stack([one, windows.keys(1, hit if near is not None else slice(None))], 1)
                order = np.lexsort((at, keys[:, 1], keys[:, 0]))
                at, keys = at[order], keys[order]
                first = np.ones(len(at), bool)
                first[1:] = (keys[1:] != keys[:-1]).any(1)
                start = np.flatnonzero(first)
                parts.append((keys[start].view(np.int64), np.full(len(start), uid), at[start].astype(np.int32), np.diff(np.append(start, len(at)))))
                held += len(start)
                if held >= OUT:
                    yield out(parts)
                    parts, held = [], 0
        if parts:
            yield out(parts)
        if halves:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(halves))], ["h1"])


def _remove(batches, names: list[str], length: int):
    for batch in batches:
        size, gone, spans, kept = [], [], [], []
        found = batch.column(batch.schema.get_field_index("found"))
        for i, _, text, lo, hi, again in _judged_rows(batch):
            n = len(text)
            mark = np.zeros(n + 1, np.int64)
            np.add.at(mark, lo[again], 1)
            np.add.at(mark, hi[again] - 1 + length, -1)
            known = found[i].as_py()
            if known:  # the strings that begin there, wherever else in the row they are
                windows = RowWindows(text, lo[~again], hi[~again], length)
                at, one = windows.at, windows.keys(0)
                same = np.flatnonzero(np.isin(one, one[np.isin(at, known)]))
                two = windows.keys(1, same)
                lead = {*zip(one[same][np.isin(at[same], known)].tolist(), two[np.isin(at[same], known)].tolist())}
                hit = at[same[[x in lead for x in zip(one[same].tolist(), two.tolist(), strict=True)]]]
                np.add.at(mark, hit, 1)
                np.add.at(mark, hit + length, -1)
            out = np.cumsum(mark)[:n] > 0
            size.append(n)
            gone.append(int(out.sum()))
            spans.append(int((out & ~np.append(False, out[:-1])).sum()))
            kept.append(np.frombuffer(text, np.uint8)[~out].tobytes())
        columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
        columns += [pa.array(x, pa.int64()) for x in (size, gone, spans)] + [pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, [*names, *ADDED])


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """``docs`` plus n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes that stay, binary).

    A byte goes when a string of ``length`` bytes that covers it also starts
    anywhere else, in the same row or another; strings are judged on the input
    and overlap. Null texts count as empty; repeated rows repeat each other;
    texts shorter than ``length`` stay whole; an empty table gives an empty
    one; input columns with the added names give way.
    """
    docs = replacing(docs, *ADDED)
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    again = docs.select("text").mapInArrow(_phrase_keys, "phrase long").groupBy("phrase").agg(F.count("*").alias("n")).filter("n > 1").select("phrase")
    again, phrase_path = write_table(again, "phrases")
    repeated = send(bitmap.build(again, bitmap.bits_for(again.count())))
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(c if c == "text" else f"c{i}") for i, c in enumerate(names)])
    plain = inner.columns
    filled = inner.withColumn("text", F.coalesce("text", F.lit("")))
    affected, affected_path = write_table(filled.mapInArrow(lambda it: _by_affected(it, repeated, length, True), filled.schema).withColumn("uid", F.monotonically_increasing_id()), "affected")
    found, unit_path = write_table(affected.select("uid", "text").mapInArrow(lambda it: _units(it, repeated, length), "uid long, lo int, hi int, c1 long, c2 long"), "units")
    # as a table of its own, so that the join below may split a unit that very many rows hold
    twice, twice_path = write_table(found.groupBy("c1", "c2").agg(F.count("*").alias("n")).filter("n > 1").select("c1", "c2", F.lit(True).alias("again")), "twice")
    drop_table(spark, phrase_path)
    runs = found.join(twice, ["c1", "c2"], "left").groupBy("uid").agg(F.collect_list(F.struct("lo", "hi", F.coalesce("again", F.lit(False)).alias("again"))).alias("units"))
    judged, _ = write_table(affected.join(runs, "uid"), "judged")
    n_edges = judged.agg(F.sum(F.aggregate("units", F.lit(0).cast("long"), lambda s, u: s + F.when(u["again"], 0).otherwise(u["hi"] - u["lo"])))).first()[0] or 0
    for path in (unit_path, twice_path, affected_path):
        drop_table(spark, path)
    window = "h1 long, h2 long, uid long, at int, n long"
    slim = judged.select("uid", "text", "units")
    # first half-keys alone: which edge strings may stand twice; only those travel with their places
    near = send(bitmap.build(slim.mapInArrow(lambda it: _windows(it, length, False, None, True), "h1 long"), bitmap.bits_for(n_edges)))
    halves = slim.mapInArrow(lambda it: _windows(it, length, False, None, True), "h1 long").unionByName(slim.mapInArrow(lambda it: _windows(it, length, True, near, True), "h1 long"))
    double, double_path = write_table(halves.groupBy("h1").agg(F.count("*").alias("n")).filter("n > 1").select("h1"), "halves")
    near.unpersist()
    twofold = send(bitmap.build(double, bitmap.bits_for(double.count())))
    drop_table(spark, double_path)
    edges = slim.mapInArrow(lambda it: _windows(it, length, False, twofold), window)
    matches = slim.mapInArrow(lambda it: _windows(it, length, True, twofold), window)
    classes = edges.select("h1", "h2", "n").unionByName(matches.select("h1", "h2", "n")).groupBy("h1", "h2").agg(F.sum("n").alias("n")).filter("n > 1").select("h1", "h2")
    classes, _ = write_table(classes, "classes")
    hits = edges.join(classes, ["h1", "h2"]).groupBy("uid").agg(F.collect_list("at").alias("found"))
    schema = with_fields(filled, **ADDED)
    cut = judged.join(hits, "uid", "left").mapInArrow(lambda it: _remove(it, plain, length), schema)
    rest = filled.mapInArrow(lambda it: _by_affected(it, repeated, length, False), filled.schema)
    rest = rest.withColumns({"n_bytes": F.octet_length("text").cast("long"), "n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"), "kept": F.col("text").cast("binary")})
    return cut.unionByName(rest).toDF(*names, *ADDED)
