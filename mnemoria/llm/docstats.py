"""Counts over whole texts, one pass, vectorised: what quality rules and the quality classifier look at."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K

#: The symbols that count as such.
SYMBOLS = b"#*$%&|<>"
NAMES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_word_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_chars", "n_letters", "n_upper", "n_digits", "n_punct", "n_bangs", "n_pipes", "n_wide")


def _table(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_IS = {"symbol": _table(SYMBOLS), "upper": _table(bytes(range(65, 91))), "lower": _table(bytes(range(97, 123))), "digit": _table(b"0123456789"), "punct": _table(b".,;:!?\"'()-"), "bang": _table(b"!"), "pipe": _table(b"|")}


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def distinct_by_row(row: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """How many distinct hashes each row has; ``row`` is mixed into the hash, so equal keys are of one row."""
    if not len(row):
        return np.zeros(rows, np.int64)
    key = K.mix(hashes + row.astype(np.uint64) * K.U(0xD6E8FEB86659FD93))
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    return np.bincount(row[order[new]], minlength=rows).astype(np.int64)


def slice_stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of NAMES for each row."""
    rows, n = len(offsets) - 1, len(data)
    start, end, first = K.words(data, offsets)
    row_of_word = np.repeat(np.arange(rows), np.diff(first))
    points = K.code_points(data)
    total = np.zeros(n + 1, np.int64)
    np.cumsum(points, out=total[1:])
    hashed = K.Prefix(data)
    out = {"n_words": np.diff(first), "word_chars": K.row_sums(total[end] - total[start], first)}
    count = lambda mask: K.row_sums(mask, offsets)
    words = hashed(start, end)
    # lines
    breaks = np.flatnonzero(data == 10)
    lo = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    hi = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    n_lines = 1 + np.diff(np.searchsorted(breaks, offsets))
    row_of_line = np.repeat(np.arange(rows), n_lines)
    wordy = np.searchsorted(start, hi) > np.searchsorted(start, lo)
    lines = row_of_line[wordy]
    n_wordy = np.bincount(lines, minlength=rows).astype(np.int64)
    out |= {"n_lines": n_lines, "n_word_lines": n_wordy, "n_dup_lines": n_wordy - distinct_by_row(lines, hashed(lo[wordy], hi[wordy]), rows)}
    # 3-word windows found twice or more in their text
    cover = np.zeros(len(words), bool)
    if len(words) >= 3:
        at = np.flatnonzero(row_of_word[2:] == row_of_word[:-2])
        key = K.mix(K.mix(K.mix(words[at] + row_of_word[at].astype(np.uint64) * K.U(0xD6E8FEB86659FD93)) + words[at + 1]) + words[at + 2])
        twice = at[repeated(key)]
        for j in range(3):
            cover[twice + j] = True
    out |= {"n_repeat_words": K.row_sums(cover, first), "n_distinct_words": distinct_by_row(row_of_word, words, rows)}
    upper = _IS["upper"][data]
    after = np.zeros(n, bool)  # Latin-1 capitals
    if n:
        after[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    wide = points & (data >= 0x80)
    out |= {
        "n_symbols": count(_IS["symbol"][data]), "n_chars": K.row_sums(points, offsets), "n_upper": count(upper | after), "n_letters": count(upper | _IS["lower"][data] | wide), "n_digits": count(_IS["digit"][data]),
        "n_punct": count(_IS["punct"][data]), "n_bangs": count(_IS["bang"][data]), "n_pipes": count(_IS["pipe"][data]), "n_wide": count(wide)}
    return out


def _stats(batches):
    for batch in batches:
        where = batch.schema.get_field_index("text")
        others = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if i != where]
        for lo, hi, data, offsets in K.text_slices(batch.column(where)):
            found = slice_stats(data, offsets)
            yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for _, c in others), *(pa.array(found[n].astype(np.int64)) for n in NAMES)], [*(n for n, _ in others), *NAMES])


def with_stats(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but text, and the counts of its text (null counts as empty)."""
    from .common import replacing

    docs = replacing(docs, *NAMES)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return docs.mapInArrow(_stats, f"{kept}, {', '.join(f'{n} long' for n in NAMES)}")
