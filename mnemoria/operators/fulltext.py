"""A stored inverted index: segments of posting blocks, BM25 search that skips blocks which can't reach the top.

A segment is two tables. ``documents`` is the forward index: id, window, length
and each term with its count. Documents stand in order of length and are cut
into windows of ``WINDOW``, so that documents of a window have similar lengths.
``postings`` has a row for each (term, window): number of postings, greatest
count, least length, and the postings themselves; it is partitioned by a hash
of the term and sorted by term. A term that every document has is many rows,
never one group.

Writes append a segment; documents of earlier segments with the same id are
buried, with their terms, so that document frequencies stay those of the live
documents. A merge rewrites live documents as one segment. Each write is a new
version (``sources.versions``); older ones stay readable.

A search reads postings of the queries' terms only. The greatest count and the
least length of a (term, window) bound its share of any document's score there
(the share grows with the count and falls with the length, whatever the average
length is by now); bounds of a query's terms add up to a bound of the window.
The windows of highest bound are scored first; their k-th score is a threshold
that the final k-th score can't fall below, so only windows whose bound reaches
it are opened.

Null texts are documents without terms: they count in N and in the average.
Null ids can't be stored. Of rows with one id in one write the least text stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..sources import store, versions

WINDOW, BUCKETS = 128, 64
#: Ids of buried documents are sent to the tasks up to this number; more are joined by a shuffle.
SENT = 2_000_000
DOCUMENTS = "id long, window long, length int, terms array<struct<term:string,tf:int>>"
POSTINGS = "term string, window long, n int, max_tf int, min_length int, postings array<struct<id:long,tf:int,length:int>>, bucket int"
#: Windows of a query that are scored to get a threshold.
PILOT = 4
#: Scores are ranked as rounded; a bound this much lower may still tie.
ROUNDING = 1e-6


def _rank() -> Column:
    return F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "id"))


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def forward(docs: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, length, terms): each document's number of index words and its terms with their counts.

    Only ids are shuffled, to find those of several rows; texts stay in their
    tasks, which count the words of a batch of documents.
    """
    rows = docs.filter(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("text"))
    again = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    if not again.isEmpty():
        again = store.stored(again, "fulltext-again")
        least = rows.join(again, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
        rows = rows.join(again, "id", "left_anti").unionByName(least)
    words = rows.select("id", F.coalesce(X.index_tokens(F.col("text")), F.array().cast("array<string>")).alias("words"))
    return store.stored(words.mapInArrow(_counted, "id long, length int, terms array<struct<term:string,tf:int>>"), "fulltext-forward")  # sorting looks at it twice


def _counted(batches):
    """Batches of (id, words) to (id, length, terms)."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        words = batch.column("words")
        sizes = np.diff(words.offsets.to_numpy())
        coded = words.flatten().cast(pa.string()).dictionary_encode()
        place: dict[str, int] = {}
        stems = np.array([place.setdefault(X.stem_word(w), len(place)) for w in coded.dictionary.to_pylist()], np.int64)
        most = max(1, len(place))
        pairs, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * most + stems[coded.indices.to_numpy()], return_counts=True)
        terms = pa.StructArray.from_arrays([pa.array(list(place), pa.string()).take(pa.array(pairs % most)), pa.array(tf.astype(np.int32))], ["term", "tf"])
        starts = np.searchsorted(pairs, np.arange(len(sizes) + 1) * most).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(pa.array(starts), terms)], ["id", "length", "terms"])


def _blocks(batches):
    """Batches of (id, window, length, terms), windows one after the other, to the rows of ``POSTINGS`` but for their bucket; a window that a task's end cuts gives two rows of a term."""
    import numpy as np
    import pyarrow as pa

    def blocks(rows: pa.RecordBatch) -> pa.RecordBatch:
        lists = rows.column("terms")
        sizes = np.diff(lists.offsets.to_numpy())
        items = lists.flatten()
        coded, doc = items.field("term").cast(pa.string()).dictionary_encode(), np.repeat(np.arange(len(sizes)), sizes)
        code, tf = coded.indices.to_numpy().astype(np.int64), items.field("tf").to_numpy()
        window, length, ids = (rows.column(c).to_numpy()[doc] for c in ("window", "length", "id"))
        order = np.lexsort((doc, code, window))
        code, window, length, ids, tf = (x[order] for x in (code, window, length, ids, tf))
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (window[1:] != window[:-1])
        starts = np.flatnonzero(new)
        n = np.diff(np.append(starts, len(code))).astype(np.int32)
        most, least = (np.maximum.reduceat(tf, starts), np.minimum.reduceat(length, starts)) if len(starts) else (tf, length)
        postings = pa.StructArray.from_arrays([pa.array(ids), pa.array(tf), pa.array(length)], ["id", "tf", "length"])
        own = pa.ListArray.from_arrays(pa.array(np.append(starts, len(code)).astype(np.int32)), postings)
        return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[starts])), pa.array(window[starts]), pa.array(n), pa.array(most), pa.array(least), own], ["term", "window", "n", "max_tf", "min_length", "postings"])

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        window = batch.column("window").to_numpy()
        cut = int(np.searchsorted(window, window[-1])) if (np.diff(window) >= 0).all() else batch.num_rows
        if held and (cut or held[-1].column("window")[-1].as_py() != int(window[0])):  # the windows held so far end here
            held.append(batch.slice(0, cut))
            yield blocks(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            held = []
        elif cut:
            yield blocks(pa.Table.from_batches([batch.slice(0, cut)]).combine_chunks().to_batches()[0])
        if cut < batch.num_rows:
            held.append(batch.slice(cut))
    if held:
        yield blocks(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def write_segment(path: str, rows: DataFrame) -> dict:
    """The tables of one segment from (id, length, terms), and its statistics."""
    spark = rows.sparkSession
    own = versions.part(path, "segment")
    packed = rows.select("id", "length", F.array_join("terms.term", " ").alias("words"), F.col("terms.tf").alias("tf"))  # terms hold no space; shuffled so, they are half as large
    order = packed.repartitionByRange("length", "id").sortWithinPartitions("length", "id")
    at = F.monotonically_increasing_id()  # partition << 33 | row
    none = F.array().cast("array<struct<term:string,tf:int>>")
    terms = F.when(F.size("tf") == 0, none).otherwise(F.arrays_zip(F.split("words", " ").alias("term"), F.col("tf").alias("tf")))
    order.select("id", F.shiftright(at, 7).alias("window"), "length", terms.alias("terms")).write.parquet(f"{own}/documents")
    assert WINDOW == 1 << 7
    docs = spark.read.schema(DOCUMENTS).parquet(f"{own}/documents")
    blocks = docs.mapInArrow(_blocks, POSTINGS.removesuffix(", bucket int"))  # a window's documents lie together: nothing is shuffled
    blocks.withColumn("bucket", bucket(F.col("term"))).sortWithinPartitions("bucket", "term", "window").write.partitionBy("bucket").parquet(f"{own}/postings")
    said = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
    return {"path": own, "n": said["n"], "words": said["words"]}


def _sent(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= SENT else ids


class FullText:
    """The index at ``path`` as of one version."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path
        self.about = versions.read(spark, path, version)

    @property
    def version(self) -> int:
        return self.about["version"]

    @staticmethod
    def create(spark: SparkSession, path: str, docs: DataFrame, id_column: str = "id", column: str = "atomic_text") -> FullText:
        segment = write_segment(path, forward(docs, id_column, column))
        return FullText(spark, path, versions.publish(spark, path, {"segments": [segment], "dead": []}, 0))

    def documents(self) -> DataFrame:
        """(segment, id, window, length, terms) of all segments, buried ones too."""
        return self._all("documents", DOCUMENTS)

    def postings(self) -> DataFrame:
        return self._all("postings", POSTINGS)

    def _all(self, kind: str, schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], f"segment int, {schema}")
        for i, s in enumerate(self.about["segments"]):
            own = self.spark.read.schema(schema).parquet(f"{s['path']}/{kind}").select(F.lit(i).alias("segment"), "*")
            out = own if i == 0 else out.unionByName(own)
        return out

    def dead(self) -> DataFrame:
        """(segment, id, length, terms) of buried documents."""
        schema = "segment int, id long, length int, terms array<struct<term:string,tf:int>>"
        paths = self.about["dead"]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _buried(self) -> DataFrame:
        """(segment, id) of buried documents."""
        return _sent(self.dead().select("segment", "id"))

    def live(self) -> DataFrame:
        return self.documents().join(self._buried(), ["segment", "id"], "left_anti")

    def _bury(self, ids: DataFrame) -> list[str]:
        own = versions.part(self.path, "dead")
        hit = self.documents().select("segment", "id").join(ids.select(F.col("id").cast("long")).distinct(), "id", "left_semi")
        hit = store.stored(hit.join(self._buried(), ["segment", "id"], "left_anti"), "fulltext-hit")  # ids alone are shuffled where they are many
        self.documents().join(_sent(hit), ["segment", "id"], "left_semi").select("segment", "id", "length", "terms").write.parquet(own)
        return [*self.about["dead"], own]

    def append(self, docs: DataFrame, id_column: str = "id", column: str = "atomic_text") -> FullText:
        """New and changed documents; the version before stays as it is."""
        segment = write_segment(self.path, forward(docs, id_column, column))
        dead = self._bury(self.spark.read.schema(DOCUMENTS).parquet(f"{segment['path']}/documents").select("id"))
        about = {"segments": [*self.about["segments"], segment], "dead": dead}
        return FullText(self.spark, self.path, versions.publish(self.spark, self.path, about, self.version))

    def delete(self, ids: DataFrame) -> FullText:
        about = {"segments": self.about["segments"], "dead": self._bury(ids)}
        return FullText(self.spark, self.path, versions.publish(self.spark, self.path, about, self.version))

    def merge(self) -> FullText:
        """Live documents as one segment, without buried ones; texts are not needed."""
        segment = write_segment(self.path, self.live().select("id", "length", "terms"))
        return FullText(self.spark, self.path, versions.publish(self.spark, self.path, {"segments": [segment], "dead": []}, self.version))

    def stats(self) -> tuple[int, float]:
        """Live documents and their average length."""
        gone = self.dead().agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
        n = sum(s["n"] for s in self.about["segments"]) - gone["n"]
        words = sum(s["words"] for s in self.about["segments"]) - gone["words"]
        return n, words / n if n else 0.0

    def search(self, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, pilot: int = PILOT) -> DataFrame:
        """(query_id, id, score, rank) of the k best live documents; ``queries`` has query_id and query."""
        _, opened, asked, share = self._windows(queries, k, k1, b, pilot)
        return self._scored(opened, asked, share).withColumn("rank", _rank()).filter(F.col("rank") <= k)

    def opened(self, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, pilot: int = PILOT) -> DataFrame:
        """(query_id, windows, opened): windows that hold a term of the query, and those that a search opens."""
        bounds, opened, _, _ = self._windows(queries, k, k1, b, pilot)
        most = bounds.groupBy("query_id").agg(F.count("*").alias("windows"))
        return most.join(opened.groupBy("query_id").agg(F.count("*").alias("opened")), "query_id")

    def _windows(self, queries: DataFrame, k: int, k1: float, b: float, pilot: int):
        """Bounds of all windows that hold a term of a query, those to be opened, the queries' terms with their weights, and a posting's share."""
        n, average = self.stats()

        def share(tf: Column, length: Column) -> Column:
            return tf * (k1 + 1) / (tf + (F.lit(1 - b) + length * b / (average or 1.0)) * k1)

        terms = queries.select("query_id", F.explode(F.array_distinct(X.index_words(F.col("query")))).alias("term"))
        wanted = store.stored(terms.select("term", bucket(F.col("term")).alias("bucket")).distinct(), "fulltext-terms")
        read = [r[0] for r in wanted.select("bucket").distinct().collect()]  # BUCKETS numbers at most
        heads = self.postings().filter(F.col("bucket").isin(read)).select("segment", "bucket", "term", "window", "n", "max_tf", "min_length")
        heads = store.stored(heads.join(wanted, ["bucket", "term"]), "fulltext-heads")
        buried = self.dead().select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("gone"))
        df = heads.groupBy("term").agg(F.sum("n").alias("df")).join(buried, "term", "left").withColumn("df", F.col("df") - F.coalesce("gone", F.lit(0))).filter("df > 0")
        idf = df.select("term", F.log(F.lit(1.0) + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        asked = store.stored(terms.join(idf, "term"), "fulltext-asked")
        bound = F.sum(F.col("idf") * share(F.col("max_tf"), F.col("min_length")))
        bounds = store.stored(heads.join(asked, "term").groupBy("query_id", "segment", "window").agg(bound.alias("bound")), "fulltext-bounds")
        first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "window"))
        tried = self._scored(bounds.withColumn("r", first).filter(F.col("r") <= pilot), asked, share)
        floor = tried.withColumn("rank", _rank()).filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        opened = bounds.join(floor, "query_id", "left").filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 2 * ROUNDING))
        return bounds, store.stored(opened.select("query_id", "segment", "window"), "fulltext-opened"), asked, share

    def _scored(self, windows: DataFrame, asked: DataFrame, share) -> DataFrame:
        """(query_id, id, score) of live documents in (query_id, segment, window)."""
        wanted = windows.select("query_id", "segment", "window").join(asked, "query_id").withColumn("bucket", bucket(F.col("term")))
        held = self.postings().select("segment", "bucket", "term", "window", "postings").join(asked.select("term").distinct(), "term", "left_semi")
        opened = held.join(wanted, ["segment", "bucket", "term", "window"])
        each = opened.select("query_id", "segment", "idf", F.explode("postings").alias("p")).select("query_id", "segment", F.col("p.id").alias("id"), (F.col("idf") * share(F.col("p.tf"), F.col("p.length"))).alias("s"))
        live = each.join(self._buried(), ["segment", "id"], "left_anti")
        return live.groupBy("query_id", "id").agg(F.sum("s").alias("score"))
