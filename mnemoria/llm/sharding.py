"""Sharding by fixed virtual slots.

A record's content hash puts it into one of ``n_slots`` virtual slots, which
never change; a small versioned map says which shard holds a slot. The map is
fitted to the slots' bytes (largest first, to the lightest shard) and edited,
slot by slot, when shards are added or loads drift. Equal texts share a slot.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import plain, replacing

#: Rows of a slot are numbered in so many independent runs, so that a hot slot is no single task.
RUNS = 64
ADDED = ("size", "text_crc32", "virtual_slot", "shard", "slot")


def with_slots(docs: DataFrame, n_slots: int = 4096) -> DataFrame:
    """Adds size (UTF-8 bytes + 1), text_crc32, virtual_slot (by the text's hash) and run (by the whole row's key)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({
        "size": (F.octet_length(text) + 1).cast("long"),
        "text_crc32": F.crc32(text.cast("binary")),
        "virtual_slot": F.pmod(F.xxhash64(text), F.lit(n_slots)).cast("int"),
        "run": F.pmod(F.xxhash64(F.col("doc_id"), F.lit("run")), F.lit(RUNS)).cast("int"),
    })


def slot_bytes(slotted: DataFrame) -> dict[int, int]:
    """Bytes of each virtual slot; at most ``n_slots`` rows reach the driver."""
    return {r[0]: r[1] for r in slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect()}


def fit_map(load: dict[int, int], n_shards: int, n_slots: int = 4096) -> dict[int, int]:
    """Slot to shard, sizes near equal: the largest slot left goes to the lightest shard; ties to the lower number."""
    heap = [(0, shard) for shard in range(n_shards)]
    out = {}
    for slot in sorted(range(n_slots), key=lambda s: (-load.get(s, 0), s)):
        held, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (held + load.get(slot, 0), shard))
    return out


def rebalance(old: dict[int, int], load: dict[int, int], n_shards: int) -> dict[int, int]:
    """An edited map for ``n_shards``: slots only leave shards above the mean, the fewest bytes that level them."""
    held = {s: 0 for s in range(n_shards)}
    new, homeless = {}, []
    for slot, shard in old.items():
        if shard < n_shards:
            new[slot] = shard
            held[shard] += load.get(slot, 0)
        else:
            homeless.append(slot)
    mean = sum(load.get(s, 0) for s in old) / max(n_shards, 1)
    for shard in range(n_shards):
        for slot in sorted((s for s in new if new[s] == shard), key=lambda s: (-load.get(s, 0), s)):
            size = load.get(slot, 0)
            if size and held[shard] - size >= mean:
                held[shard] -= size
                homeless.append(slot)
    for slot in sorted(homeless, key=lambda s: (-load.get(s, 0), s)):
        shard = min(held, key=lambda s: (held[s], s))
        new[slot] = shard
        held[shard] += load.get(slot, 0)
    return new


def map_table(spark: SparkSession, mapping: dict[int, int], load: dict[int, int], version: int) -> DataFrame:
    rows = [(version, slot, shard, load.get(slot, 0)) for slot, shard in sorted(mapping.items())]
    return spark.createDataFrame(rows, "version int, virtual_slot int, shard int, bytes long")


def save_map(spark: SparkSession, path: str, mapping: dict[int, int], load: dict[int, int]) -> int:
    """Appends a new version of the map at ``path`` and returns its number; older ones stay readable."""
    version = latest_version(spark, path) + 1
    map_table(spark, mapping, load, version).coalesce(1).write.mode("append").partitionBy("version").parquet(path)
    return version


def latest_version(spark: SparkSession, path: str) -> int:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return 0
    return spark.read.parquet(path).agg(F.max("version")).first()[0] or 0


def load_map(spark: SparkSession, path: str, version: int | None = None) -> dict[int, int]:
    """The map of a version, the latest if none is given."""
    version = version or latest_version(spark, path)
    return {r[0]: r[1] for r in spark.read.parquet(path).filter(F.col("version") == version).select("virtual_slot", "shard").collect()}


def assign_shards(docs: DataFrame, n_shards: int = 8, n_slots: int = 4096, mapping: dict[int, int] | None = None) -> DataFrame:
    """``docs`` plus size, text_crc32, virtual_slot, shard and slot, a row's place in its shard, gapless from 0.

    Texts of any length are hashed whole. Without ``mapping`` one is fitted to the slots' bytes. Null texts have size
    1 and share a slot with empty ones; repeated rows each get a place; ties in
    doc_id are ordered by the text, equal rows among themselves in any order; an
    empty table gives an empty one; input columns with these names are
    replaced, all others stay. Places are numbered by (slot, run) first, from a table of at most
    n_slots * RUNS counts, so that no task holds a whole shard or hot slot.
    """
    spark = docs.sparkSession
    inner, names = plain(replacing(docs, *ADDED), "doc_id", "text")
    slotted = with_slots(inner, n_slots)
    if mapping is None:
        mapping = fit_map(slot_bytes(slotted), n_shards, n_slots)
    shards = F.broadcast(map_table(spark, mapping, {}, 0).select("virtual_slot", "shard"))  # n_slots rows
    counts = slotted.groupBy("virtual_slot", "run").agg(F.count("*").alias("n")).join(shards, "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot", "run").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("virtual_slot", "run", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("virtual_slot", "run").orderBy("doc_id", "text_crc32", F.xxhash64("text"))) - 1
    placed = slotted.withColumn("place", place)
    out = placed.join(F.broadcast(base), ["virtual_slot", "run"])  # n_slots * RUNS rows at most
    return out.select(*[F.col(c).alias(n) for c, n in names.items()], "size", "text_crc32", "virtual_slot", "shard", (F.col("base") + F.col("place")).cast("long").alias("slot"))
