"""Bitmaps of a bounded size over 64-bit keys, built in the cluster: a filter with false hits but no misses."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K

CHUNK = 1 << 19


def bits_for(n: int, most: int = 1 << 29) -> int:
    """A power of two, 32 bits or more a key, up to ``most`` (64 MB)."""
    return min(most, max(CHUNK, 1 << (32 * max(n, 1) - 1).bit_length()))


def places(keys: np.ndarray, bits: int) -> np.ndarray:
    return (K.mix(keys.view(np.uint64) ^ K.U(0x5851F42D4C957F2D)) & K.U(bits - 1)).astype(np.int64)


def contains(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = places(keys, len(bitmap) * 8)
    return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def build(keys: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of ``keys`` (one long column); the driver gets each of its chunks once."""

    def where(batches):
        for batch in batches:
            at = places(np.ascontiguousarray(batch.column(0).to_numpy()), bits)
            yield pa.RecordBatch.from_arrays([pa.array((at // CHUNK).astype(np.int32)), pa.array((at % CHUNK).astype(np.int32))], ["chunk", "at"])

    def chunks(batches):
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            chunk, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.argsort(chunk, kind="stable")
            chunk, at = chunk[order], at[order]
            edges = np.append(np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])), len(chunk)) if len(chunk) else []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                flags = np.zeros(CHUNK, bool)
                flags[at[lo:hi]] = True
                bits_here = np.packbits(flags, bitorder="little")
                c = int(chunk[lo])
                own[c] = own[c] | bits_here if c in own else bits_here
        for c, flags in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([flags.tobytes()])], ["chunk", "bytes"])

    rows = keys.mapInArrow(where, "chunk int, at int").repartition("chunk").mapInArrow(chunks, "chunk int, bytes binary")
    out = np.zeros(bits >> 3, np.uint8)
    for c, raw in rows.toLocalIterator(prefetchPartitions=True):
        out[c * (CHUNK >> 3) : (c + 1) * (CHUNK >> 3)] = np.frombuffer(raw, np.uint8)
    return out
