"""Token ids of whole texts by a public byte-level BPE, with a cache of pieces.

The vocabulary's own pre-tokeniser pattern cuts a text into pieces, and a
piece's ids don't depend on what stands around it. So pieces are found for a
whole slice with NumPy, and only pieces that this worker hasn't met go to the
``tokenizers`` library. Texts for which the vectorised cut isn't plainly the
pattern's (apostrophes, which may begin contractions; code points beyond the
basic plane or unassigned) go to the library as a whole.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from . import kernels as K

SPACE, LETTER, NUMBER, OTHER, ODD = range(5)
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
MAX_CACHED = 1_500_000
#: Entries of the direct-mapped table before the sorted one, as a power of two.
TABLE_BITS = 21
_state: dict = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def classes() -> np.ndarray:
    """The pattern's class of each code point of the basic plane; one more entry for all beyond."""
    if "classes" not in _state:
        major = {"L": LETTER, "N": NUMBER}
        out = np.array([ODD if (c := unicodedata.category(chr(i))) in ("Cn", "Cs") else major.get(c[0], OTHER) for i in range(0x10000)] + [ODD], np.uint8)
        out[WHITE_SPACE] = SPACE
        out[ord("'")] = ODD
        _state["classes"] = out
    return _state["classes"]


class Pieces:
    """Ids of the pieces met so far, by their hash."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.clear()
        self.model = self.tokenizer.model
        # byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        self.alphabet = {b: b if b in plain else next(others) for b in range(256)}

    def clear(self) -> None:
        self.table_key = np.zeros(1 << TABLE_BITS, np.uint64)
        self.table_at = np.full(1 << TABLE_BITS, -1, np.int64)
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def piece(self, piece: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.alphabet))]

    def find(self, keys: np.ndarray, bytes_of) -> np.ndarray:
        """Entries of pieces by their keys; bytes_of gives the bytes of those that are new."""
        if len(self.keys) > MAX_CACHED:
            self.clear()
        slot = (keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        out = np.where(self.table_key[slot] == keys, self.table_at[slot], -1)
        miss = np.flatnonzero(out < 0)
        if len(miss):
            some, where, back = np.unique(keys[miss], return_index=True, return_inverse=True)
            at = self.sorted_find(some, lambda new: bytes_of(miss[where[new]]))
            found = self.entry[at]
            out[miss] = found[back]
            slot = (some >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            free = self.table_at[slot] < 0
            self.table_key[slot[free]], self.table_at[slot[free]] = some[free], found[free]
            # where two new keys want one slot, the later one of the assignment holds both halves
        return out

    def sorted_find(self, keys: np.ndarray, bytes_of) -> np.ndarray:
        """Places in the sorted table of (distinct, sorted) keys."""
        at = np.searchsorted(self.keys, keys)
        old = np.zeros(len(keys), bool)
        if len(self.keys):
            old = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        if not old.all():
            new = np.flatnonzero(~old)
            ids = [self.piece(x) for x in bytes_of(new)]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            start = np.cumsum(size) - size + len(self.ids)
            self.ids = np.concatenate([self.ids, np.fromiter((x for y in ids for x in y), np.uint32, int(size.sum()))])
            entry = np.arange(len(self.size), len(self.size) + len(size))
            self.start, self.size = np.append(self.start, start), np.append(self.size, size)
            self.keys, self.entry = np.insert(self.keys, at[new], keys[new]), np.insert(self.entry, at[new], entry)
            at = np.searchsorted(self.keys, keys)
        return at


def pieces_of(path: str) -> Pieces:
    if ("pieces", path) not in _state:
        _state["pieces", path] = Pieces(path)
    return _state["pieces", path]


def id_type(path: str) -> str:
    """The narrowest NumPy type that holds all ids of a vocabulary (and 0)."""
    from tokenizers import Tokenizer

    most = max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0)
    return "<u2" if most < 1 << 16 else "<u4"


def forget() -> None:
    """Drops the pieces met so far: workers are used again, for steps that need no tokens."""
    if _state:
        _state.clear()
        K.give_back()


def slice_ids(data: np.ndarray, offsets: np.ndarray, path: str) -> list[np.ndarray]:
    """The ids of each row's text."""
    cache, rows = pieces_of(path), len(offsets) - 1
    raw = data.tobytes()
    points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return [np.zeros(0, np.uint32)] * rows
    byte_at = np.append(np.flatnonzero(K.code_points(data)), len(data))
    row_at = np.searchsorted(byte_at, offsets)
    kind = classes()[np.minimum(points, 0x10000)]
    odd = K.row_sums(kind == ODD, row_at) > 0
    mark = K.row_starts(n, row_at)
    run = mark[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    last = np.append(run[1:], True)  # the last of its run
    white = kind == SPACE
    joined = np.zeros(n, bool)  # follows a space of the same row, which then begins its piece
    joined[1:] = (points[:-1] == 32) & ~mark[1:n]
    start = np.where(white, run | (last & ~mark[1:]), run & ~joined)
    begin = np.flatnonzero(start)
    end = np.append(begin[1:], n)
    first = np.searchsorted(begin, row_at)
    lo, hi = byte_at[begin], byte_at[end]
    at = cache.find(K.Prefix(data)(lo, hi), lambda new: [raw[a:b] for a, b in zip(lo[new], hi[new], strict=True)])
    size = cache.size[at]
    bounds = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=bounds[1:])
    ids = cache.ids[np.repeat(cache.start[at] - bounds[:-1], size) + np.arange(bounds[-1])]
    row = bounds[first]
    out = [ids[row[i] : row[i + 1]] for i in range(rows)]
    if odd.any():
        which = np.flatnonzero(odd)
        for i, x in zip(which, cache.encode([raw[offsets[i] : offsets[i + 1]].decode() for i in which]), strict=True):
            out[i] = np.array(x, np.uint32)
    return out
