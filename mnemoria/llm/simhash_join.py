"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Two that differ in three bits at most differ in
three bytes at most, so they share five positional bytes. Distinct fingerprints
are indexed by sets of positions and the bytes there; the sets are such that
any five positions hold one of them, so a linked pair meets under some key. A
key's members get an inverted list for each (position, byte) outside the key;
each pair's shared bytes are tallied over these lists, pairs that reach the
guaranteed number are verified bit by bit.

Equal fingerprints are one node, however many documents have them. A key with
more than ``block`` members is dealt in blocks, each pair of blocks a group of
its own, so nothing is left out and no group is unbounded; a key of m members
then sends each m / block times. Of the links within a group a spanning forest
is handed on.

Rows: null and empty texts and texts without words have fingerprint zero and
link like others; very long texts are taken whole; repeated rows and ties are
rows like others; null ids are rows like others, and count as no id where the
smallest is sought (all ids null: null). Other columns are not read, so they
may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import drop_table, write_table
from .components import connected_components

SEED = 42
#: Differing bits that the position sets below allow for: five shared bytes of eight.
MOST_BITS = 3
#: Pairs: one in each quarter; any five of eight positions hold a whole quarter.
PAIRS = [(0, 1), (2, 3), (4, 5), (6, 7)]
#: Triples within a half; any five of eight positions have three in one half.
TRIPLES = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3), (4, 5, 6), (4, 5, 7), (4, 6, 7), (5, 6, 7)]
#: Distinct fingerprints up to which pairs are used: a thousand a key on average.
PAIRS_UP_TO = 1 << 26
#: Squares of group sizes that are tallied together.
TALLY = 1 << 21


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with one space after each word, words' starts and ends in them, each row's first word."""
    start, end, first = K.words(data, offsets)
    size = end - start
    out_end = np.cumsum(size + 1) - 1
    out_start = out_end - size
    out = np.full(int(out_end[-1]) + 1 if len(out_end) else 0, 32, np.uint8)
    take = np.ones(len(out), bool)
    take[out_end] = False
    black = np.zeros(len(data) + 1, np.int8)
    black[start] = 1
    black[end] -= 1
    out[take] = K.LOWER[data[np.cumsum(black[:-1]).astype(bool)]]
    return out.tobytes(), out_start, out_end, first


def slice_fingerprints(data: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit fingerprint of each row's k-word shingles; zero for rows without words."""
    text, start, end, first = normal(data, offsets)
    n_words = np.diff(first)
    n_out = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(n_out)])
    row = np.repeat(np.arange(len(n_out)), n_out)
    lead = first[:-1][row] + np.arange(bounds[-1]) - bounds[:-1][row]
    lo, hi = start[lead], end[np.minimum(lead + k, first[1:][row]) - 1]
    cuts = [text[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, cuts, repeat(SEED)), np.uint64, len(cuts))
    out = np.zeros(len(n_out), np.uint64)
    some = np.flatnonzero(n_out)
    step = max(1, (1 << 22) // 64)
    ones = np.zeros((len(n_out), 64), np.int64)
    for at in range(0, len(hashes), step):  # bounded memory for long texts
        part, of = hashes[at : at + step], row[at : at + step]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        edge = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        ones[of[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
    if len(some):
        major = np.packbits(2 * ones[some] > n_out[some, None], axis=1)
        out[some] = np.ascontiguousarray(major).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp) for each document; fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi, data, offsets in K.text_slices(texts):
                found = slice_fingerprints(data, offsets, k)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def byte_keys(nodes: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """(key, fp): a key is a position set's number and the bytes at its positions."""
    byte = lambda j: F.shiftrightunsigned("fp", 8 * (7 - j)).bitwiseAND(F.lit(255))
    keys = []
    for c, positions in enumerate(sets):
        key = F.lit(c).cast("long")
        for j in positions:
            key = key * 256 + byte(j)
        keys.append(key)
    return nodes.select("fp", F.explode(F.array(*keys)).alias("key"))


def groups(keyed: DataFrame, block: int) -> DataFrame:
    """(key, members): the members of each key of two or more; of a large key, those of each two of its blocks."""
    sizes = keyed.groupBy("key").count().filter(F.col("count") > block)
    large = sizes.select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = keyed.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("low"), F.greatest(own, j).alias("high")))
    met = dealt.select("key", "fp", F.explode(meets).alias("at")).select("key", "fp", "at.low", "at.high")
    together = met.repartition("key", "low", "high").groupBy("key", "low", "high").agg(F.collect_list("fp").alias("members"))
    return together.filter(F.size("members") > 1).select("key", "members")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of ``n`` nodes reaches over the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label, new.copy())  # the label's own node follows
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def linked(of: np.ndarray, fp: np.ndarray, sets: list[tuple[int, ...]], set_of: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among members ``fp`` (uint64) of the groups ``of``: tally shared bytes over inverted lists, keep pairs that reach the number, verify."""
    n = len(fp)
    pairs = []
    for j in range(8):
        inside = np.array([j in s for s in sets])[set_of]  # shared by the whole group: no list needed
        rows = np.flatnonzero(~inside)
        posting = of[rows] * 256 + ((fp[rows] >> np.uint64(8 * (7 - j))) & np.uint64(255)).astype(np.int64)
        order = np.argsort(posting, kind="stable")
        rows, posting = rows[order], posting[order]
        edge = np.flatnonzero(np.append(True, posting[1:] != posting[:-1])) if len(rows) else np.zeros(0, np.int64)
        length = np.diff(np.append(edge, len(rows)))
        # each member with all that follow it in its list
        place = np.arange(len(rows)) - np.repeat(edge, length)
        after = np.repeat(length, length) - place - 1
        first = np.repeat(np.arange(len(rows)), after)
        step = np.arange(len(first)) - np.repeat(np.cumsum(after) - after, after) + 1
        pairs.append(rows[first] * n + rows[first + step])
    code, shared = np.unique(np.concatenate(pairs), return_counts=True)
    a, b = code // n, code % n
    known = np.array([len(s) for s in sets])[set_of]
    enough = shared + known[a] >= 8 - max_bits
    a, b = a[enough], b[enough]
    near = np.bitwise_count(fp[a] ^ fp[b]) <= max_bits
    label = forest(a[near], b[near], n)
    child = np.flatnonzero(label != np.arange(n))
    return fp[child], fp[label[child]]


def links(grouped: DataFrame, sets: list[tuple[int, ...]], max_bits: int) -> DataFrame:
    """(a, b): links that join the members of each group which reach one another in it."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            member = lists.flatten().to_numpy().view(np.uint64)
            ends = np.cumsum(size)
            set_of_key = keys >> (8 * len(sets[0]))
            lo = 0
            load = np.cumsum(size.astype(np.int64) ** 2)
            while lo < len(keys):
                hi = max(lo + 1, int(np.searchsorted(load, (load[lo - 1] if lo else 0) + TALLY, side="right")))
                of = np.repeat(np.arange(hi - lo), size[lo:hi])
                part = member[ends[lo] - size[lo] : ends[hi - 1]]
                a, b = linked(of, part, sets, set_of_key[lo:hi][of], max_bits)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
                lo = hi

    return grouped.mapInArrow(run, "a long, b long")


def components(docs: DataFrame, k: int = 3, max_bits: int = MOST_BITS, block: int = 512) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each document; component_id is the smallest doc_id that links reach."""
    if not 0 <= max_bits <= MOST_BITS:
        raise ValueError(f"the index finds pairs of up to {MOST_BITS} differing bits")
    spark = docs.sparkSession
    prints, _ = write_table(fingerprints(docs, k), "simhash-prints")
    nodes, nodes_path = write_table(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    sets = PAIRS if nodes.count() <= PAIRS_UP_TO else TRIPLES
    edges, edges_path = write_table(links(groups(byte_keys(nodes, sets), block), sets, max_bits), "simhash-links")
    found, found_path = write_table(connected_components(edges), "simhash-components")
    drop_table(spark, edges_path)
    joined = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named, _ = write_table(joined.join(least, "component").select(F.col("fp").alias("of"), "component_id"), "simhash-named")
    for path in (nodes_path, found_path):
        drop_table(spark, path)
    return prints.join(named, prints["fp"] == named["of"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
