"""Packing into fixed windows by minimum bin slack.

A document's ids are cut at multiples of the window; full pieces are sequences
of their own, and what is left of each document, 1 to window - 1 ids, is a
length. Only the histogram of these lengths (under ``window`` numbers) goes to
the driver. There a bounded subset-sum over bitsets picks, again and again,
the multiset of lengths that holds the longest left and fills the window
closest, traces its counts back, and repeats it as often as they last. Each
remainder then finds its place from its rank among those of its length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K
from . import tokens
from .common import replacing, write_table

WINDOW = 1024
#: Ranks are counted in so many runs first, so that no length is a single task; more, with the rows, up to the second number.
RUNS, MOST_RUNS = 1024, 4096
PIECE = (("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long"))


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, at most ``counts`` of each, whose sum is the largest up to ``room``.

    Reachable sums are the bits of an integer; each length's copies are added
    in chunks of 1, 2, 4 ..., and the steps are traced back from the best sum.
    """
    limit = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left > 0:
            n = min(chunk, left)
            steps.append((length, n, reach))
            reach |= (reach << (length * n)) & limit
            left, chunk = left - n, chunk * 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    best, out = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> best & 1:
            out[length] = out.get(length, 0) + n
            best -= length * n
    return out


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """(lengths and how many of each in one sequence, how many such sequences), using up ``counts``."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        top = max(left)
        rest = left | {top: left[top] - 1}
        one = best_fill({k: v for k, v in rest.items() if v and k <= window - top}, window - top)
        one[top] = one.get(top, 0) + 1
        times = min(left[k] // n for k, n in one.items())
        out.append((one, times))
        for k, n in one.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def places(patterns: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, copies in a sequence, first sequence, offset), by length and rank; number of sequences."""
    rows, used, sequence = [], {}, 0
    for one, times in patterns:
        offset = 0
        for length in sorted(one, reverse=True):
            n = one[length]
            rows.append((length, used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5), sequence


def _encode(batches, path: str, window: int, keep_ids: str):
    """Adds n_ids (with the closing id 0), each piece's CRC, and, where ``keep_ids`` names a NumPy type, the ids as bytes."""
    for batch in batches:
        where = batch.schema.get_field_index("text")
        others = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if i != where]
        for lo, hi, data, offsets in K.text_slices(batch.column(where)):
            size, crcs, kept = [], [], []
            for ids in tokens.slice_ids(data, offsets, path):
                ids = np.append(ids, np.uint32(0)).astype("<u4")
                size.append(len(ids))
                crcs.append([zlib.crc32(ids[i : i + window].tobytes()) for i in range(0, len(ids), window)])
                if keep_ids:
                    narrow = ids.astype(keep_ids)
                    kept += [narrow[i : i + window].tobytes() for i in range(0, len(ids), window)]
            if keep_ids:  # a row for each piece, so that no row is long
                n = np.array(list(map(len, crcs)), np.int64)
                row = np.repeat(np.arange(hi - lo), n)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                columns = [(m, c.slice(lo, hi - lo).take(pa.array(row))) for m, c in others]
                columns += [("n_ids", pa.array(np.array(size, np.int64)[row])), ("pos", pa.array(pos)), ("crc", pa.array([x for c in crcs for x in c], pa.int64()))]
                columns.append(("ids", pa.array(kept, pa.binary())))
            else:
                columns = [(n, c.slice(lo, hi - lo)) for n, c in others]
                columns += [("n_ids", pa.array(size, pa.int64())), ("crcs", pa.array(crcs, pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([c for _, c in columns], [n for n, _ in columns])


def _widen(batches, kind: str):
    """Ids from bytes to numbers, after they have travelled."""
    tokens.forget()
    width = np.dtype(kind).itemsize
    for batch in batches:
        where = batch.schema.get_field_index("ids")
        column = batch.column(where)
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
        ids = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind).astype(np.int32) if len(column) else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array((at - at[0]) // width, pa.int32()), pa.array(ids))
        yield pa.RecordBatch.from_arrays([lists if i == where else c for i, c in enumerate(batch.columns)], batch.schema.names)


class Place:
    """Gives each document's remainder its sequence and offset, and its full pieces their first sequence."""

    def __init__(self, shared):
        self.shared = shared

    def __call__(self, batches):
        rows, sequences, base_rest, base_full, window = self.shared.value
        key = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            c = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names) if n in ("rest", "run", "rank", "before")}
            rank = c["rank"] + base_rest[c["run"], c["rest"]]
            full = sequences + base_full[c["run"]] + c["before"]
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            some = c["rest"] > 0
            if some.any():
                at = rows[np.searchsorted(key, c["rest"][some].astype(np.int64) << 44 | rank[some], side="right") - 1]
                nth = rank[some] - at[:, 1]
                seq[some] = at[:, 3] + nth // at[:, 2]
                off[some] = at[:, 4] + nth % at[:, 2] * c["rest"][some]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seq), pa.array(off), pa.array(full)], [*batch.schema.names, "seq", "off", "full_seq"])


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece: the columns of ``docs`` but text, then start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document's ids are its text's, without special tokens, and a closing id
    0; a null or empty text has that id alone, texts of any length are cut whole. Each row is a document, repeated
    rows too; an empty table gives an empty one; input columns with the added
    names give way. The driver holds the histogram of lengths, and counts by
    (length, run): window * MOST_RUNS numbers at most. Ids are written and
    shuffled as bytes, two an id where the vocabulary allows it.
    """
    names = [n for n, _ in PIECE] + ["ids"] * keep_ids
    docs = replacing(docs, *names)
    kept = [c for c in docs.columns if c != "text"]
    inner = docs.select("text", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.monotonically_increasing_id().alias("uid"))
    path = tokenizer or tokens.default_path()
    others = [f for f in inner.schema.fields if f.name != "text"]
    kind = tokens.id_type(path) if keep_ids else ""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in others), "n_ids long, pos long, crc long, ids binary" if keep_ids else "n_ids long, crcs array<long>"])
    coded = inner.mapInArrow(lambda it: _encode(it, path, window, kind), schema)
    coded, _ = write_table(coded, "tokens")
    one_each = coded.filter("pos = 0").select("uid", "n_ids") if keep_ids else coded
    runs = min(MOST_RUNS, max(RUNS, one_each.count() // 1_000_000))
    run_of = F.pmod(F.xxhash64("uid"), F.lit(runs)).cast("int")
    slim = one_each.select("uid", run_of.alias("run"), F.pmod("n_ids", F.lit(window)).cast("int").alias("rest"), F.floor(F.col("n_ids") / window).cast("long").alias("full"))
    counted = slim.groupBy("run", "rest").agg(F.count("*").alias("n"), F.sum("full").alias("full")).toPandas()
    by_rest = np.zeros((runs, window), np.int64)
    by_full = np.zeros(runs, np.int64)
    run = counted["run"].to_numpy(np.int64)
    np.add.at(by_rest, (run, counted["rest"].to_numpy(np.int64)), counted["n"].to_numpy(np.int64))
    np.add.at(by_full, run, counted["full"].to_numpy(np.int64))
    totals = by_rest.sum(0)
    rows, sequences = places(plan({k: int(totals[k]) for k in range(1, window)}, window))
    shared = docs.sparkSession.sparkContext.broadcast((rows, sequences, np.cumsum(by_rest, 0) - by_rest, np.cumsum(by_full) - by_full, window))
    by_run = Window.partitionBy("run").orderBy("uid")
    rest = one_each.withColumns({
        "run": run_of, "rest": F.pmod("n_ids", F.lit(window)).cast("int"), "full": F.floor(F.col("n_ids") / window).cast("long")})
    rest = rest.withColumns({
        "before": F.coalesce(F.sum("full").over(by_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "rank": (F.row_number().over(Window.partitionBy("run", "rest").orderBy("uid")) - 1).cast("long")})
    placed = rest.mapInArrow(Place(shared), ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema.fields), "seq long, off long, full_seq long"]))
    if keep_ids:
        out = coded.join(placed.drop("n_ids"), "uid")
        at, crc = F.col("pos"), F.col("crc")
    else:
        out = placed.select("*", F.explode(F.transform("crcs", lambda x, i: F.struct(i.cast("long").alias("pos"), x.alias("crc")))).alias("piece"))
        at, crc = F.col("piece.pos"), F.col("piece.crc")
    last = at == F.col("full")
    length = F.when(last, F.col("rest")).otherwise(window).cast("long")
    out = out.select(
        *[f"c{i}" for i in range(len(kept))], (at * window).alias("start"), length.alias("length"), crc.alias("ids_crc32"), F.col("n_ids").alias("doc_tokens"),
        F.when(last, F.col("seq")).otherwise(F.col("full_seq") + at).alias("sequence_id"), F.when(last, F.col("off")).otherwise(0).cast("long").alias("offset"),
        *[F.col("ids")] * keep_ids)
    if keep_ids:
        out = out.mapInArrow(lambda it: _widen(it, kind), ", ".join(f"{f.name} {'array<int>' if f.name == 'ids' else f.dataType.simpleString()}" for f in out.schema.fields))
    return out.toDF(*kept, *out.columns[len(kept):])
