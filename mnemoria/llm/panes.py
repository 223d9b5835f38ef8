"""Window panes with revisions: sums made in tasks, one stateful operator by shards of panes.

A pane is a kind and an hour of event time. Each batch's rows are summed by
pane in the tasks that read them, before any shuffle, so a pane with most rows
sends a row for each task. The sums go to shards by a hash of their pane; a
shard (``applyInPandasWithState``) holds the totals of its live panes and
decides what is published, revised and forgotten. Rows of closed panes pass
beside it. A row without clicks wakes each shard in each batch, so that panes
without new rows fall due and are closed.

The watermark of a batch comes from what earlier batches were fed; it is
written beside the feed and is a constant of the batch's plan.

Rows: null ``ts`` are dropped; of rows with one ``click_id`` (null counts as an
id) the least by (ts, arrived_at, kind, value) stays, so repeated rows count
once and ties don't matter; a null ``arrived_at`` counts as ``ts``; null kinds
are ``none``; a null, infinite or NaN value counts 0 cents. Kinds of any length
are taken whole. Other columns are not read, so they may have any name. An
empty table gives an empty result. Sums beyond a long end the query.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .common import parallelism, shared_dir

HOUR = 3_600_000_000
FEED = "shard int, hour long, kind string, click_id long, cents long, ends boolean, event long"
MARKS = "batch int, watermark long, last boolean"
SUMS = "shard int, hour long, kind string, n_rows long, cents long"
TOTALS = "hours array<long>, kinds array<string>, n_rows array<long>, cents array<long>, emitted array<boolean>"
CHANGES = "batch long, hour long, click_id long, n_rows long, cents long, record string, kind string"
#: A watermark before all time.
NEVER = -(1 << 62)
#: Panes that a task sums up before it sends them.
HELD = 1 << 16


def reached(hour, watermark: int, wait_hours: int):
    """Whether the watermark is ``wait_hours`` past the end of the hour (a number or a column)."""
    return (hour + 1 + wait_hours) * HOUR <= watermark


def sums_by_pane(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows and punctuation (shard, hour, kind, cents, ends) to the sums of their panes; a punctuation row stays, as a pane without rows."""

    def out():
        keys = list(sums)
        return pd.DataFrame({"shard": [k[0] for k in keys], "hour": [k[1] for k in keys], "kind": [k[2] for k in keys], "n_rows": [sums[k][0] for k in keys], "cents": [sums[k][1] for k in keys]})

    sums: dict[tuple[int, int, str], list[int]] = {}
    for frame in frames:
        # halves of 32 bits, as pandas' own sums of longs wrap around
        parts = frame.assign(n_rows=(~frame["ends"].astype(bool)).astype("int64"), high=frame["cents"] // (1 << 32), low=frame["cents"] % (1 << 32))
        parts = parts.groupby(["shard", "hour", "kind"], as_index=False)[["n_rows", "high", "low"]].sum()
        for shard, hour, kind, n, high, low in zip(*(parts[c].tolist() for c in parts.columns), strict=True):
            pane = sums.setdefault((shard, hour, kind), [0, 0])
            pane[0] += n
            pane[1] += (high << 32) + low
        if len(sums) >= HELD:
            yield out()
            sums.clear()
    if sums:
        yield out()


class Shard:
    """The totals of a shard's live panes and whether they are out, brought forward by one batch. Take more shards where kinds are many."""

    def __init__(self, batch: int, watermark: int, last: bool, due_after: int, closed_after: int):
        self.batch, self.watermark, self.last, self.due_after, self.closed_after = batch, watermark, last, due_after, closed_after

    def __call__(self, key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        panes: dict[tuple[int, str], list] = {}
        if state.exists:
            hours, kinds, n_rows, cents, emitted = state.get
            panes = {(h, k): [n, c, e] for h, k, n, c, e in zip(hours, kinds, n_rows, cents, emitted, strict=True)}
        fresh: dict[tuple[int, str], list[int]] = {}
        for frame in frames:
            for hour, kind, n, c in zip(*(frame[x].tolist() for x in ("hour", "kind", "n_rows", "cents")), strict=True):
                if n:
                    pane = fresh.setdefault((hour, kind), [0, 0])
                    pane[0] += n
                    pane[1] += c
        out = []
        line = lambda pane, record: out.append((self.batch, hour, -1, pane[0], pane[1], record, kind))
        for (hour, kind), (n, c) in fresh.items():
            pane = panes.setdefault((hour, kind), [0, 0, False])
            if pane[2]:
                line(pane, "retract")
            pane[0] += n
            pane[1] += c
            if not -(1 << 63) <= pane[1] < 1 << 63:
                raise OverflowError(f"the cents of pane {hour}, {kind} are beyond a long")
            if pane[2]:
                line(pane, "replace")
        for (hour, kind), pane in list(panes.items()):
            is_due = reached(hour, self.watermark, self.due_after)
            if not pane[2] and (is_due or self.last):
                line(pane, "emit" if is_due else "final")
                pane[2] = True
            if reached(hour, self.watermark, self.closed_after):
                del panes[hour, kind]
        if panes:
            state.update(([k[0] for k in panes], [k[1] for k in panes], *([v[i] for v in panes.values()] for i in range(3))))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["batch", "hour", "click_id", "n_rows", "cents", "record", "kind"])


def micros(ts) -> F.Column:
    """Microseconds since 1970 of a timestamp as its own clock reads, zone or not."""
    hours = F.unix_date(F.to_date(ts)).cast("long") * 24 + F.hour(ts)
    return hours * HOUR + F.minute(ts).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def clicks_by_batch(clicks: DataFrame, n_batches: int) -> DataFrame:
    """Each click once: batch, event (microseconds since 1970), kind, click_id, cents. Days repeat every ``n_batches`` days."""
    rows = clicks.filter(F.col("ts").isNotNull()).select("click_id", "ts", F.coalesce("arrived_at", "ts").alias("arrived_at"), "kind", "value")
    once = rows.groupBy("click_id").agg(F.min(F.struct("ts", "arrived_at", "kind", "value")).alias("r")).select("click_id", "r.*")
    day = F.unix_date(F.to_date("arrived_at")).cast("long")
    q = F.pmod(day, F.lit(n_batches))
    delay = F.greatest(F.lit(0), F.crc32(F.coalesce(F.col("click_id").cast("string"), F.lit("")).cast("binary")) % 30 - 23)
    x = F.col("value").cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return once.select(
        F.least(F.lit(n_batches - 1), q + delay).cast("int").alias("batch"), (micros(F.col("ts")) - (day - q) * F.lit(24 * HOUR)).alias("event"), F.coalesce("kind", F.lit("none")).alias("kind"), "click_id",
        F.when(finite, F.floor(F.when(finite, x) * 100 + 0.5)).otherwise(0).cast("long").alias("cents"),
    )


def write_feed(rows: DataFrame, path: str, n_batches: int, shards: int, spread: int) -> None:
    """Rows (batch, event, kind, click_id, cents) and a row to wake each shard, in a folder for each batch; the batches' watermarks beside it.

    Only the greatest event time of each batch comes to the driver. ``spread``
    has no use any more: sums are made before panes are dealt out.
    """
    spark = rows.sparkSession
    hour = F.expr(f"(event - pmod(event, {HOUR}L)) div {HOUR}L")
    shard = F.pmod(F.xxhash64(hour, F.col("kind")), F.lit(shards)).cast("int")
    rows.select("batch", shard.alias("shard"), hour.alias("hour"), "kind", "click_id", "cents", F.lit(False).alias("ends"), "event").write.partitionBy("batch").parquet(path)
    tops = {r[0]: r[1] for r in spark.read.schema(f"{FEED}, batch int").parquet(path).groupBy("batch").agg(F.max("event")).collect()}
    seen = NEVER
    marks = []
    for b in range(n_batches):
        marks.append((b, seen, b == n_batches - 1))
        seen = max(seen, tops.get(b, NEVER))
    spark.createDataFrame(marks, MARKS).coalesce(1).write.parquet(f"{path}-marks")
    wake = spark.range(n_batches).select(F.col("id").cast("int").alias("batch")).crossJoin(spark.range(shards).select(F.col("id").cast("int").alias("shard"))).repartition(1)  # shards x batches: a parameter
    none = F.lit(0).cast("long")
    wake.select("batch", "shard", none.alias("hour"), F.lit("").alias("kind"), none.alias("click_id"), none.alias("cents"), F.lit(True).alias("ends"), F.lit(None).cast("long").alias("event")).write.mode("append").partitionBy("batch").parquet(path)


def pane_changes(feed: DataFrame, batch: int, watermark: int, last: bool, due_hours: int = 2, closed_hours: int = 72) -> DataFrame:
    """The streaming plan of one batch: rows and punctuation (FEED) to changes (CHANGES)."""
    is_late = ~F.col("ends") & reached(F.col("hour"), watermark, closed_hours)
    late = feed.filter(is_late).select(F.lit(batch).cast("long").alias("batch"), "hour", "click_id", F.lit(1).cast("long").alias("n_rows"), "cents", F.lit("late").alias("record"), "kind")
    sums = feed.filter(~is_late).select("shard", "hour", "kind", "cents", "ends").mapInPandas(sums_by_pane, SUMS)
    shard = Shard(batch, watermark, last, due_hours, closed_hours)
    return sums.groupBy("shard").applyInPandasWithState(shard.__call__, CHANGES, TOTALS, "append", GroupStateTimeout.NoTimeout).unionByName(late)


#: Settings of the streaming query alone: a session's own values come back after each start.
STREAM = {
    # A task reads its shards' values whole and writes them whole; files of changes are all that takes.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
    # A start ends with its batch: its stores close with their tasks instead of waiting, with memory, for a maintenance round.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def run_batch(spark, feed_path: str, checkpoint: str, out: str, batch: int, **hours: int) -> None:
    """Start the query anew on its checkpoint, feed it one batch and wait for its end."""
    mark = spark.read.schema(MARKS).parquet(f"{feed_path}-marks").filter(F.col("batch") == batch).first()
    before = {k: spark.conf.get(k, None) for k in STREAM}
    try:
        for k, v in STREAM.items():
            spark.conf.set(k, v)
        feed = spark.readStream.schema(FEED).parquet(f"{feed_path}/batch={{{batch}}}")  # a pattern: files of earlier batches, which a start looks at again, lie elsewhere
        query = pane_changes(feed, batch, mark["watermark"], mark["last"], **hours).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()


def panes_with_revisions(clicks: DataFrame, n_batches: int = 12, shards: int | None = None, spread: int = 16, due_hours: int = 2, closed_hours: int = 72) -> DataFrame:
    """Changes of all panes over all batches; the query is started anew for each batch.

    Everything lies in a new folder below ``spark.checkpoint.dir``: the feed, the
    checkpoint with the state, and the changes. A lost executor costs the tasks
    it ran; a lost driver can go on with the batch at which it stopped.
    """
    spark = clicks.sparkSession
    base = f"{shared_dir(spark)}/mnemoria/panes-{uuid.uuid4().hex}"
    shards = shards or max(64, parallelism(spark))
    write_feed(clicks_by_batch(clicks, n_batches), f"{base}/feed", n_batches, shards, spread)
    for b in range(n_batches):
        run_batch(spark, f"{base}/feed", f"{base}/checkpoint", f"{base}/changes", b, due_hours=due_hours, closed_hours=closed_hours)
    return spark.read.schema(CHANGES).parquet(f"{base}/changes")
