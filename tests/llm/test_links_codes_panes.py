"""SimHash links, product codes and window panes against brute force."""

import itertools
import math
import re
import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mnemoria.llm import code_compression, panes, simhash_join
from mnemoria.llm.common import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def plain_fingerprint(text, k=3):
    words = WORD.findall((text or "").translate(LOW))
    cuts = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(c.encode(), 42) for c in cuts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, bits=3):
    """prints: a list of (id, fingerprint); each row's smallest reachable id."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= bits:
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(prints))]


@pytest.mark.parametrize("sets", [simhash_join.PAIRS, simhash_join.TRIPLES])
def test_position_sets_meet_every_five(sets):
    assert all(any(set(s) <= set(five) for s in sets) for five in itertools.combinations(range(8), 5))


def test_simhash_of_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in simhash_join.components(docs).collect()}
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    assert {d: int(r["fingerprint"], 16) for d, r in got.items()} == dict(rows)
    assert [got[d]["component_id"] for d, _ in rows] == plain_components(rows)


@pytest.mark.parametrize(("sets", "block"), [("PAIRS", 512), ("PAIRS", 7), ("TRIPLES", 7)])
def test_links_of_dense_groups(spark, monkeypatch, sets, block):
    """Fingerprints around a few centres, so that keys hold many; small blocks lose nothing."""
    monkeypatch.setattr(simhash_join, "PAIRS_UP_TO", 1 << 26 if sets == "PAIRS" else -1)
    rng = np.random.default_rng(3)
    prints = set()
    for centre in rng.integers(0, 1 << 63, 4, dtype=np.uint64).tolist() + [0]:
        for _ in range(40):
            flips = rng.choice(64, rng.integers(0, 6), replace=False)
            prints.add(centre ^ sum(1 << int(b) for b in flips))
    rows = list(enumerate(sorted(prints)))
    known = spark.createDataFrame([(d, f - (1 << 64) if f >> 63 else f) for d, f in rows], "doc_id long, fp long")
    monkeypatch.setattr(simhash_join, "fingerprints", lambda docs, k: known)
    got = {r["doc_id"]: r["component_id"] for r in simhash_join.components(known, block=block).collect()}
    assert [got[d] for d, _ in rows] == plain_components(rows)


def test_simhash_odd_rows(spark):
    schema = "doc_id long, text string, fp string, key string, first string, of string, component string, members string"
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [(3, None), (1, ""), (2, " \n\t"), (None, "x"), (5, "x"), (5, "x"), (6, "X"), (7, long), (8, long + " end"), (None, "alone here"), (9, "é'ß 日本 \U0001F600 it's")]
    docs = spark.createDataFrame([(*r, *"abcdef") for r in rows], schema)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash_join.components(docs).collect()), key=str)
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    assert got == sorted(((d, f"{f:016x}", c) for (d, f), c in zip(prints, plain_components(prints), strict=True)), key=str)
    assert simhash_join.components(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="3 differing bits"):
        simhash_join.components(docs, max_bits=4)


def plain_codes(rows, parts, entries, rounds, scale=1024):
    """rows: (id, label, vector), ids distinct; Lloyd in Python integers."""
    whole = {i: [math.floor(scale * x) for x in v] for i, _, v in rows}
    width = len(next(iter(whole.values()))) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(whole[i], p) for i in sorted(whole)[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((far(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for v in whole.values():
                own.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if e in own else c for e, c in enumerate(books[p])]
    found = {i: [near(cut(v, p), books[p]) for p in range(parts)] for i, v in whole.items()}
    return {i: ("".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for i, f in found.items()}, books


def test_codes(spark):
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 5 == 0 else i % 3, (rng.normal(size=12) * rng.choice([0.01, 1, 30])).round(3).tolist()) for i in range(150)]
    rows += [(150 + i, 1, rows[i][2]) for i in range(20)]  # ties
    want, _ = plain_codes(rows, 4, 16, 3)
    got = code_compression.compress(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), entries=16, rounds=3).collect()
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == want
    sums = {}
    for i, label, _ in rows:
        sums[label] = sums.get(label, 0) + want[i][1]
    assert all(r["label_error"] == sums[rows[r["vec_id"]][1]] for r in got)
    assert len({r["codebooks_sha256"] for r in got}) == 1


def test_bounds_leave_no_nearer_entry():
    rng = np.random.default_rng(9)
    for spread in (1, 40, 1 << 26):
        x = rng.integers(-spread, spread + 1, (500, 16))
        book = np.concatenate([rng.integers(-spread, spread + 1, (60, 16)), x[:4], x[:4]])
        index, error = code_compression.Codebook(book).nearest(x)
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (index == d.argmin(1)).all() and (error == d.min(1)).all()


def test_odd_vectors_for_codes(spark):
    rows = [(1, 1, [1.0, 0.0, 2.0]), (2, 1, None), (3, 1, [float("nan"), 1.0, 1.0]), (4, 1, [1.0, None, 1.0]), (5, None, [0.5, 0.5, 0.5]), (5, None, [0.5, 0.5, 0.5]), (None, 2, [1.0, 1.0, 1.0]), (6, 1, [1.0]), (7, 1, []), (8, 1, [float("inf"), 1.0, 1.0])]
    v = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, label int, embedding array<double>, v string, code string")
    got = code_compression.compress(v, rounds=2).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in got) == [(False, 1), (False, 5), (False, 5), (True, 0)]
    assert all(r["error"] == 0 and len(r["code"]) == 8 for r in got)
    assert code_compression.compress(v.limit(0)).count() == 0


def plain_panes(rows, n, due_hours, closed_hours):
    hour, zero, us = 3_600_000_000, datetime(1970, 1, 1), timedelta(microseconds=1)
    batches, seen = {}, {}
    for r in rows:
        if r["ts"] is not None:
            at = r["arrived_at"] or r["ts"]
            value = r["value"] if r["value"] is not None and math.isfinite(r["value"]) else None
            row = (r["ts"], at, r["kind"] is not None, r["kind"] or "", value is not None, value or 0, "none" if r["kind"] is None else r["kind"])
            seen[r["click_id"]] = min(row, seen.get(r["click_id"], row))
    for i, (ts, at, *_, some, value, kind) in seen.items():
        day = (at - zero).days
        b = min(n - 1, day % n + max(0, zlib.crc32(("" if i is None else str(i)).encode()) % 30 - 23))
        event = (ts - zero) // us - (day - day % n) * 24 * hour
        batches.setdefault(b, []).append((event, event // hour, kind, i, math.floor(100 * value + 0.5) if some else 0))
    mark, state, out = -math.inf, {}, []
    for b in range(n):
        before = {k: tuple(v) for k, v in state.items()}
        fresh = set()
        for _, h, kind, i, cents in batches.get(b, []):
            if mark >= (h + 1 + closed_hours) * hour:
                out.append((b, h, i, 1, cents, "late", kind))
            else:
                pane = state.setdefault((h, kind), [0, 0, False])
                pane[0], pane[1] = pane[0] + 1, pane[1] + cents
                fresh.add((h, kind))
        for (h, kind), pane in list(state.items()):
            if not pane[2] and mark >= (h + 1 + due_hours) * hour:
                out.append((b, h, -1, pane[0], pane[1], "emit", kind))
                pane[2] = True
            elif pane[2] and (h, kind) in fresh:
                out += [(b, h, -1, *before[h, kind][:2], "retract", kind), (b, h, -1, pane[0], pane[1], "replace", kind)]
            if mark >= (h + 1 + closed_hours) * hour:
                del state[h, kind]
            elif b == n - 1 and not pane[2]:
                out.append((b, h, -1, pane[0], pane[1], "final", kind))
        mark = max([mark, *(e for e, *_ in batches.get(b, []))])
    return sorted(out, key=str)


def test_odd_clicks(spark):
    """Nulls, repeats, ties, early and late rows, days before 1970, clashing columns; batches without rows."""
    zero = datetime(1970, 1, 1)
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        at = zero + timedelta(days=int(rng.choice([0, 2, 5, 7, -4])), seconds=int(rng.integers(0, 86400)), microseconds=int(rng.integers(0, 10**6)))
        ts = at - timedelta(hours=int(rng.choice([0, 0, 1, 30, 70])))
        rows.append((i, ts, at, ["view", None, "", "none", "x" * 3000][int(rng.integers(0, 5))], float(rng.normal() * 50)))
    rows += rows[:30] + [(1000, None, zero, "view", 1.0), (1001, zero, None, None, None), (None, zero, zero, "view", 2.0), (None, zero, zero, "click", 3.0), (1002, zero, zero, "view", float("nan")), (1003, zero, zero, "view", float("inf")), (7, zero, zero, "a", 1.0)]
    schema = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, kind string, value double, batch string, hour string, event string, shard string, ends string"
    clicks = spark.createDataFrame([(*r, *"abcde") for r in rows], schema)
    got = panes.panes_with_revisions(clicks, n_batches=5, shards=6, spread=3, due_hours=1, closed_hours=24)
    want = plain_panes(clicks.collect(), 5, 1, 24)
    assert sorted(map(tuple, got.select("batch", "hour", "click_id", "n_rows", "cents", "record", "kind").collect()), key=str) == want
    assert {"late", "emit", "retract", "replace", "final"} <= {r[5] for r in want}


def test_panes_of_an_empty_table_and_a_batch_fed_twice(spark):
    schema = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, kind string, value double"
    assert panes.panes_with_revisions(spark.createDataFrame([], schema), n_batches=2, shards=2).count() == 0
    one = spark.createDataFrame([(1, datetime(1970, 1, 1, 5), datetime(1970, 1, 1, 5), "view", 0.125)], schema)
    base = f"{shared_dir(spark)}/panes-twice"
    panes.write_feed(panes.clicks_by_batch(one, 1), f"{base}/feed", 1, 2, 2)
    for _ in range(2):  # a start that finds nothing new changes nothing
        panes.run_batch(spark, f"{base}/feed", f"{base}/checkpoint", f"{base}/changes", 0)
    assert [tuple(r) for r in spark.read.parquet(f"{base}/changes").collect()] == [(0, 5, -1, 1, 13, "final", "view")]
