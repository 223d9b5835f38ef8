"""N-gram Jaccard self-join by T-occurrence search, down to connected components.

A document is its set of distinct k-word shingles (64-bit hashes). Documents
with equal sets are one node. Sets x and y link when den * |x & y| >= num *
|x | y|, which takes an overlap T(x, y), so both hold a common shingle among
their first |x| - ceil(num |x| / den) + 1 in any order that all sets share. The
order puts shingles last that are frequent anywhere, so inverted lists of
these index shingles are short; a set that has used up too much of itself
before a list can reach no T with anyone there.

Lists are searched, not paired. First a list's most ordinary member (the one
with the least rare shingles, so the likeliest source of the others) is
searched in the list; the links give components. Then every list that still
holds several components has its members outside the largest one searched
against all its members, in blocks: of those only one link between two
components comes back. A search is DivideSkip over the members' full sets: the
query's short inverted lists are merged by a heap, and members that come close
enough are looked up in the long ones by binary search. Links within one
component change nothing, so components are those of all links.
"""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap
from . import kernels as K
from .common import drop_table, parallelism, write_table
from .components import connected_components, merge_components

#: Records that a query is searched in at a time, and queries that share a list's records.
GROUP, ASKED = 128, 512
#: DivideSkip's weight of a probe: of L lists, the T / (MU * log2(longest) + 1) longest are probed.
MU = 0.01
LANE2 = K.U(0xA0761D6478BD642F)
FREQUENT_WINDOW = 1_000_000
#: Shingles of the records that are held at a time, at most.
HELD = 1 << 18


def row_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Each row's distinct shingles, sorted."""
    low = K.LOWER[data]
    start, end, first = K.words(data, offsets)
    found, bounds = K.shingles(K.Prefix(low)(start, end), first, k)
    return [np.unique(found[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(K.mix(s).sum(dtype=np.uint64)), int(K.mix(s ^ LANE2).sum(dtype=np.uint64))


def _frequent(batches, k: int, least: int):
    """Shingles that many different sets of this stretch hold, with how many do."""
    held, n, seen = [], 0, set()

    def out():
        if held:
            keys, count = np.unique(np.concatenate(held), return_counts=True)
            some = count >= least
            yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(count[some])], ["token", "n"])

    for batch in batches:
        for _, _, data, offsets in K.text_slices(batch.column(0)):
            for s in row_sets(data, offsets, k):
                if len(s) and (f := fingerprint(s)) not in seen:
                    seen.add(f)
                    held.append(s)
                    n += len(s)
            if n >= FREQUENT_WINDOW:
                yield from out()
                held, n, seen = [], 0, set()
    yield from out()


def frequent_shingles(texts: DataFrame, k: int, least: int = 2, most: int = 1_000_000) -> np.ndarray:
    """About ``most`` (8 bytes each) of the most frequent shingles, rarest first: an order, so it has no say in results.

    What a stretch of the corpus holds twice is counted over all of it. Whole
    steps of a histogram of counts go in from the top; of the step that no
    longer fits, a share by hash.
    """
    counted = texts.mapInArrow(lambda it: _frequent(it, k, least), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter("n > 3")
    counted, path = write_table(counted, "frequent")
    step = F.floor(F.log2("n") * 16).cast("int")
    floor, share, left = 1 << 30, 0.0, most
    for at, tokens in sorted(map(tuple, counted.groupBy(step).agg(F.count("*")).collect()), reverse=True):
        floor, share = at, min(1.0, left / tokens)
        left -= tokens
        if left <= 0:
            break
    some = (step > floor) | ((step == floor) & (F.pmod(F.xxhash64("token"), F.lit(1 << 20)) < int(share * (1 << 20))))
    found = counted.filter(some).toPandas().sort_values(["n", "token"])
    drop_table(texts.sparkSession, path)
    return found["token"].to_numpy(np.int64).view(np.uint64)


class Index:
    """doc_id, set size, fingerprint, number of rare shingles and index shingles of each row."""

    def __init__(self, frequent, k: int, num: int, den: int):
        self.frequent, self.k, self.num, self.den = frequent, k, num, den

    def __call__(self, batches):
        last = self.frequent.value
        by_value = np.argsort(last)
        known = last[by_value]
        for batch in batches:
            for lo, hi, data, offsets in K.text_slices(batch.column(1)):
                sizes, f1, f2, prefix, odd = [], [], [], [], []
                for s in row_sets(data, offsets, self.k):
                    n = len(s)
                    f = fingerprint(s)
                    sizes.append(n)
                    f1.append(f[0])
                    f2.append(f[1])
                    take = n - -(-self.num * n // self.den) + 1 if n else 0
                    odd.append(n)
                    if n and len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        late = known[at] == s
                        rare = s[~late]
                        odd[-1] = len(rare)
                        if len(rare) < take:  # the rarest of the frequent ones fill up
                            s = np.concatenate([rare, s[late][np.argsort(by_value[at[late]], kind="stable")]])
                        else:
                            s = rare
                    prefix.append(s[:take].view(np.int64))
                ends = np.append(0, np.cumsum([len(p) for p in prefix])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefix)))
                longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (f1, f2)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), *longs, pa.array(odd, pa.int64()), lists], ["doc_id", "n", "f1", "f2", "rare", "prefix"])


def _sets(batches, wanted, k: int):
    """Full sets, as bytes, of rows whose id may be wanted (a bitmap of bounded size) or is null; equal ones of a partition once."""
    seen = set()
    for batch in batches:
        ids = batch.column(0)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        keep = np.flatnonzero(~known | bitmap.contains(wanted.value, np.ascontiguousarray(ids.fill_null(0).to_numpy())))
        if len(keep):
            text = batch.column(1).take(pa.array(keep))
            for _, _, data, offsets in K.text_slices(text):
                new = {}
                for s in row_sets(data, offsets, k):
                    if len(s) and (f := fingerprint(s)) not in seen:
                        seen.add(f)
                        new[f] = s.tobytes()
                longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in zip(*new, strict=True)] if new else [pa.array([], pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([*longs, pa.array(new.values(), pa.binary())], ["f1", "f2", "words"])


class Lists:
    """The inverted lists of some records (sorted sets): a list is a stretch of ``owner``, its entries sort by (token, owner)."""

    def __init__(self, records: list[np.ndarray]):
        self.size = np.array([len(r) for r in records])
        tokens = np.concatenate(records)
        owner = np.repeat(np.arange(len(records)), self.size)
        order = np.argsort(tokens, kind="stable")
        self.owner = owner[order]
        self.tokens, self.start = np.unique(tokens[order], return_index=True)
        self.end = np.append(self.start[1:], len(tokens))
        self.entries = np.repeat(np.arange(len(self.tokens)), self.end - self.start) << 32 | self.owner

    def reach(self, query: np.ndarray, num: int, den: int) -> np.ndarray:
        """Records whose overlap with the query reaches T, by DivideSkip.

        A record that the merged short lists name fewer than T times less the
        number of long ones can't reach T; the others are looked up, by binary
        search, in the long lists.
        """
        need = -(-num * (len(query) + self.size) // (num + den))  # den * o >= num * (|q| + |r| - o)
        at = np.searchsorted(self.tokens, query)
        own = at[self.tokens[np.minimum(at, len(self.tokens) - 1)] == query] if len(self.tokens) else at[:0]
        t = int(need.min())
        if t < 1 or len(own) < t:
            return np.zeros(0, np.int64)
        length = self.end[own] - self.start[own]
        n_long = min(t - 1, int(t / (MU * math.log2(max(2, int(length.max()))) + 1)))
        own = own[np.argsort(-length, kind="stable")]
        long, short = own[:n_long], own[n_long:]
        count = np.zeros(len(self.size), np.int64)
        for record, times in itertools.groupby(heapq.merge(*(self.owner[a:b].tolist() for a, b in zip(self.start[short], self.end[short], strict=True)))):
            count[record] = sum(1 for _ in times)
        near = np.flatnonzero(count >= need - n_long)
        for i in range(0, len(near), 64):
            some = near[i : i + 64]
            probes = long[:, None] << 32 | some[None, :]
            spot = np.searchsorted(self.entries, probes)
            count[some] += (self.entries[np.minimum(spot, len(self.entries) - 1)] == probes).sum(0)
        return near[count[near] >= need[near]]


def _groups(batches, at_a_time: int):
    """(key, queries, some records) from rows (g, salt, role, node, component, ...) by g, salt and role: 0 asks and is held, 1 is held.

    Each two rows of which one asks meet once at least: those that ask come
    first and ask to the end. A query or record is (node, component, n, ...).
    """
    key, asked, held, last, size = None, [], [], None, 0
    for batch in batches:
        raw = [_values(batch.column(c)) for c in range(6, batch.num_columns)]
        for i, (g, salt, role, node, component, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True)):
            if (g, salt) != key or len(held) >= at_a_time or size >= HELD:
                if asked and held:
                    yield key, asked, held
                held, size = [], 0
            if (g, salt) != key:
                key, asked, last = (g, salt), [], None
            if node == last:  # a set that two partitions have sent
                continue
            last = node
            row = (node, component, n, *(own(i) for own in raw))
            held.append(row)
            size += len(row[3])
            if not role:
                asked.append(row)
    if asked and held:
        yield key, asked, held
    K.give_back()


def _values(column):
    """The array of each row of a column of lists, or of binaries that hold 64-bit numbers."""
    if pa.types.is_binary(column.type):
        return lambda i: np.frombuffer(column[i].as_buffer(), np.uint64).copy()
    flat, ends = column.flatten().to_numpy(), np.append(0, np.cumsum(column.value_lengths().to_numpy()))
    return lambda i: flat[ends[i] : ends[i + 1]].copy()


def _prune(batches, num: int, den: int):
    """Members that may still reach T with one of another component, by what their index shingles share and where they first meet."""
    for (g, salt), asked, held in _groups(batches, 8 * GROUP):
        size, component = (np.array([r[c] for r in held]) for c in (2, 1))
        tokens, place = (np.concatenate([r[c] for r in held]) for c in (3, 4))
        owner = np.repeat(np.arange(len(held)), [len(r[3]) for r in held])
        order = np.argsort(tokens, kind="stable")
        tokens, owner, place = tokens[order], owner[order], place[order]
        may_ask, may_answer = [], np.zeros(len(held), bool)
        for q, (_, own, n, shingles, at) in enumerate(asked):
            lo = np.searchsorted(tokens, shingles)
            times = np.searchsorted(tokens, shingles, side="right") - lo
            spots = np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
            who, first, common = np.unique(owner[spots], return_index=True, return_counts=True)
            m = size[who]
            need = -(-num * (n + m) // (num + den))
            left = np.minimum(n - np.repeat(at, times)[first], m - place[spots][first])
            beyond = -(-num * np.maximum(n, m) // den) - 1
            may = (left >= need) & (common + beyond >= need) & (np.minimum(n, m) * den >= np.maximum(n, m) * num) & (component[who] != own)
            may_answer[who[may]] = True
            if may.any():
                may_ask.append(q)
        if may_ask:
            rows = [(0, *asked[q][:2]) for q in may_ask] + [(1, *held[r][:2]) for r in np.flatnonzero(may_answer)]
            columns = [[g] * len(rows), [salt] * len(rows), *zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["g", "salt", "role", "node", "component"])


def _shared_entries(batches, several):
    """(node, n, rare, pos, token) of index shingles that a bitmap says several sets may have."""
    for batch in batches:
        flat = batch.column(3).flatten().to_numpy()
        size = batch.column(3).value_lengths().to_numpy()
        at = np.flatnonzero(bitmap.contains(several.value, np.ascontiguousarray(flat)))
        row = np.repeat(np.arange(batch.num_rows), size)[at]
        pos = at - (np.cumsum(size) - size)[row]
        own = [batch.column(c).take(pa.array(row)) for c in range(3)]
        yield pa.RecordBatch.from_arrays([*own, pa.array(pos.astype(np.int32)), pa.array(flat[at])], ["node", "n", "rare", "pos", "token"])


def _search(batches, num: int, den: int):
    """Links (a, b) between each group's queries and records, where they join two components that the group has not joined before."""
    key, root = None, {}

    def find(x):
        while (up := root.get(x, x)) != x:
            x = up
        return x

    for group, asked, held in _groups(batches, GROUP):
        if group != key:
            key, root = group, {}
        a, b, lists = [], [], Lists([r[3] for r in held])
        for node, component, _, query in asked:
            own = find(component)
            if all(find(r[1]) == own for r in held):
                continue
            for r in lists.reach(query, num, den):
                x, y = find(component), find(held[r][1])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    a.append(node)
                    b.append(held[r][0])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


class Join:
    """The stages of one self-join."""

    def __init__(self, texts: DataFrame, k: int, num: int, den: int):
        self.texts, self.k, self.num, self.den = texts, k, num, den
        self.spark, self.paths = texts.sparkSession, {}

    def table(self, df: DataFrame, label: str) -> DataFrame:
        out, path = write_table(df, label)
        self.paths.setdefault(label, []).append(path)
        return out

    def drop(self, *labels: str) -> None:
        """Delete tables that nothing will read again."""
        for path in [p for x in labels for p in self.paths.pop(x, [])]:
            drop_table(self.spark, path)

    def reachable(self, common, nx, ny):
        """Whether a pair may reach T: shared index entries, and at most what one set has beyond its index."""
        beyond = lambda n: F.ceil(self.num * n / self.den) - 1
        need = F.ceil(self.num * (nx + ny) / (self.num + self.den))
        return (common + F.greatest(beyond(nx), beyond(ny)) >= need) & (F.least(nx, ny) * self.den >= F.greatest(nx, ny) * self.num)

    def dealt(self, rows: DataFrame, own: DataFrame, *what: str) -> DataFrame:
        """``rows`` (g, salt, role, node, component), each with n and ``what`` of its node, a group together."""
        return self.gathered(rows.join(own.select("node", "n", *what), "node").select("g", "salt", "role", "node", "component", "n", *what))

    def gathered(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(parallelism(self.spark), "g", "salt").sortWithinPartitions("g", "salt", "role", "node")

    def links(self, rows: DataFrame, nodes: DataFrame) -> DataFrame:
        """Links (a, b: nodes) between queries and records of one (g, salt)."""
        wanted = self.table(rows.select("node").distinct().join(nodes.select("node", "doc_id", "n", "f1", "f2"), "node"), "wanted")
        bits = bitmap.build(wanted.select("doc_id").filter("doc_id is not null"), bitmap.bits_for(wanted.count()))
        shared = self.spark.sparkContext.broadcast(bits)
        k, num, den = self.k, self.num, self.den
        found = self.texts.mapInArrow(lambda it: _sets(it, shared, k), "f1 long, f2 long, words binary")
        asked = rows.join(wanted.select("node", "n", "f1", "f2"), "node")  # short rows learn whose set they need, so that sets travel by fingerprint once and then to their searches
        both = found.join(asked, ["f1", "f2"]).select("g", "salt", "role", "node", "component", "n", "words")
        out = self.table(self.gathered(both).mapInArrow(lambda it: _search(it, num, den), "a long, b long"), "links")
        shared.unpersist()
        self.drop("wanted")
        return out

    def run(self) -> tuple[DataFrame, DataFrame]:
        """(doc_id, n, f1, f2) for each row, and (f1, f2, first) for each node: the smallest doc_id of its component."""
        frequent = self.spark.sparkContext.broadcast(frequent_shingles(self.texts.select("text"), self.k))
        rows = self.table(self.texts.mapInArrow(Index(frequent, self.k, self.num, self.den), "doc_id long, n long, f1 long, f2 long, rare long, prefix array<long>"), "index")
        nodes = rows.filter("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("doc_id"), F.first("rare").alias("rare"), F.first("prefix").alias("prefix"))
        full = self.table(nodes.withColumn("node", F.monotonically_increasing_id()), "full")
        rows = self.table(rows.select("doc_id", "n", "f1", "f2"), "rows")
        nodes = self.table(full.select("node", "n", "f1", "f2", "doc_id"), "nodes")
        self.drop("index")
        postings, stars = self.star(full)
        self.drop("full", "several", "entries")
        component = self.table(connected_components(self.links(stars, nodes)), "components")
        self.drop("stars")
        rest = self.mixed_lists(postings, component)
        if not rest.isEmpty():
            more = self.links(rest, nodes)
            if not more.isEmpty():
                component = self.table(merge_components(component, more), "components")
        self.drop("postings", "feasible", "lists", "rest")
        named = nodes.select("node", "n", "f1", "f2", "doc_id").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = named.groupBy("component").agg(F.min("doc_id").alias("first"))
        return rows, named.join(least, "component").select("n", "f1", "f2", "first")

    def star(self, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The lists of two members or more, and each list's most ordinary member as a query for the others that may reach T."""
        several = nodes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("sets")).filter("sets > 1").select("token")
        several = self.table(several, "several")
        hits = self.spark.sparkContext.broadcast(bitmap.build(several, bitmap.bits_for(several.count())))
        entries = nodes.select("node", "n", "rare", "prefix").mapInArrow(lambda it: _shared_entries(it, hits), "node long, n long, rare long, pos int, token long")
        entries = self.table(entries, "entries")
        hits.unpersist()
        ordinary = F.struct(F.round(F.col("rare") / F.col("n"), 2).alias("odd"), (-F.col("n")).alias("m"), "node", "n", "pos")
        first = entries.groupBy("token").agg(F.min(ordinary).alias("x"), F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
        first = self.table(first.select("token", F.col("x.node").alias("a"), F.col("x.n").alias("na"), F.col("x.pos").alias("pa")), "stars")
        postings = self.table(entries.drop("rare").join(first, "token"), "postings")
        pairs = postings.filter("node <> a").groupBy("a", F.col("node").alias("b"), F.col("na").alias("nx"), F.col("n").alias("ny")).agg(F.count("*").alias("common"), F.bool_or(self.in_time("na", "pa", "n", "pos")).alias("early"))
        pairs = self.table(pairs.filter(F.col("early") & self.reachable(F.col("common"), F.col("nx"), F.col("ny"))).select("a", "b"), "stars")
        degree = self.table(pairs.groupBy("a").agg(F.count("*").alias("degree")), "stars")
        blocks = F.ceil(F.col("degree") / GROUP).cast("int")
        queries = degree.select(F.col("a").alias("g"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("node"), F.col("a").alias("component"))
        records = pairs.join(degree, "a").select(F.col("a").alias("g"), F.pmod(F.xxhash64("b"), blocks).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("node"), F.col("b").alias("component"))
        return postings, self.table(queries.unionByName(records), "stars")

    def mixed_lists(self, postings: DataFrame, component: DataFrame) -> DataFrame:
        """For lists that hold several components: members outside the largest as queries, in blocks, among all members.

        Lists of two are done, as one of them was the other's query. Lists with
        the same most ordinary member go together, so that a set travels once.
        Members that can't reach T with any other are left out: first by size
        and place alone, then by a merge of the groups' index shingles.
        """
        entries = postings.select("token", "a", "node", "n", "pos").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
        several = entries.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"), F.min("n").alias("least"))
        several = self.table(several.filter("low <> high and members > 2").select("token", "least"), "lists")
        smallest = F.greatest("least", F.ceil(self.num * F.col("n") / self.den))
        feasible = F.col("n") - F.col("pos") >= F.ceil(self.num * (F.col("n") + smallest) / (self.num + self.den))
        kept = self.table(entries.join(several, "token").filter(feasible).select("token", "a", "node", "component"), "feasible")
        mixed = kept.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("token")
        mixed = self.table(mixed, "lists")
        members = self.table(kept.join(mixed, "token").select(F.col("a").alias("g"), "node", "component").distinct(), "feasible")
        by = members.groupBy("g", "component").agg(F.count("*").alias("members"))
        lists = by.groupBy("g").agg(F.max_by("component", F.struct("members", "component")).alias("largest"), F.max("members").alias("major"), F.sum("members").alias("members"))
        lists = self.table(lists.select("g", "largest", F.ceil((F.col("members") - F.col("major")) / ASKED).cast("int").alias("blocks")), "lists")
        both = members.join(lists, "g").filter("blocks > 0")
        salt = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        rows = both.select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"), (F.when(F.col("component") != F.col("largest"), salt)).alias("own"), "node", "component")
        rows = rows.select("g", "salt", F.when(F.col("own") == F.col("salt"), 0).otherwise(1).alias("role"), "node", "component")
        index = postings.join(members.select("node").distinct(), "node").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("x"))
        index = index.select("node", "n", F.col("x.token").alias("tokens"), F.col("x.pos").alias("places"))
        num, den = self.num, self.den
        found = self.dealt(rows, index, "tokens", "places").mapInArrow(lambda it: _prune(it, num, den), "g long, salt int, role int, node long, component long")
        return self.table(found.groupBy("g", "salt", "node", "component").agg(F.min("role").alias("role")), "rest")

    def in_time(self, nx: str, px: str, ny: str, py: str):
        """Whether sets that first meet at these places of their order may still reach T, by size and by what is left."""
        n, m, left = F.col(nx), F.col(ny), F.least(F.col(nx) - F.col(px), F.col(ny) - F.col(py))
        return (left >= F.ceil(self.num * (n + m) / (self.num + self.den))) & (F.least(n, m) * self.den >= F.greatest(n, m) * self.num)


def components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``: the smallest doc_id reachable by links, itself included.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A null, empty or
    wordless text has an empty set and links with nothing; fewer words than
    ``k`` are one shingle. Repeated rows and equal sets are linked; a null
    doc_id takes part, but names no component (the others' smallest does, null
    where there is none). An empty table gives an empty one.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows, named = Join(texts, k, num, den).run()
    out = rows.join(named, ["n", "f1", "f2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Of each component's documents the one with the smallest doc_id, in the columns of ``docs``; documents without words stay.

    Rows that repeat a doc_id are one document, so they stay or go together;
    rows with a null doc_id, a null or an empty text stay. Texts of any length
    are compared whole. An empty table gives an empty one; any column names
    will do, as only doc_id and text are read.
    """
    found = components(docs.select("doc_id", "text"), k, num, den)
    gone = found.filter((F.col("n_shingles") > 0) & (F.col("component_id") != F.col("doc_id"))).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
