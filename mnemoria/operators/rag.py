"""Documents: chunks, their merging, and the index on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.wordlists import EXTENSIONS


def chunks(docs: DataFrame, source: str, text: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """(id source#n, source, idx, text)."""
    rows = docs.select(F.col(source).cast("string").alias("source"), F.posexplode(X.word_chunks(F.col(text), size, overlap)).alias("idx", "text"))
    return rows.select(F.concat_ws("#", "source", "idx").alias("id"), "source", "idx", "text")


def merge_adjacent(found: DataFrame, most: int = 1000) -> DataFrame:
    """Chunks of a source that follow each other, while their tokens fit ``most``; the best score stays.

    Runs of any number merge: the source of a merged run is its last chunk.
    """
    ordered = F.array_sort(F.collect_list(F.struct("idx", "text", "score", X.tokens_floor_chars(F.col("text")).alias("tokens"))))
    grouped = found.groupBy("source").agg(ordered.alias("items"))
    kind = "array<struct<first:int,last:int,text:string,score:double,tokens:bigint>>"

    def one(x):
        return F.struct(x["idx"].alias("first"), x["idx"].alias("last"), x["text"].alias("text"), x["score"].alias("score"), x["tokens"].alias("tokens"))

    def step(acc, x):
        prev = F.get(acc, F.size(acc) - 1)
        joins = (F.size(acc) > 0) & (prev["last"] + 1 == x["idx"]) & (prev["tokens"] + x["tokens"] <= most)
        both = F.struct(prev["first"].alias("first"), x["idx"].alias("last"), F.concat(prev["text"], F.lit("\n"), x["text"]).alias("text"), F.greatest(prev["score"], x["score"]).alias("score"), (prev["tokens"] + x["tokens"]).alias("tokens"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(acc, F.array(one(x))))

    return grouped.select("source", F.explode(F.aggregate("items", F.array().cast(kind), step)).alias("m")).select("source", "m.*")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def read_corpus(spark: SparkSession, root: str, extensions=EXTENSIONS) -> DataFrame:
    """(path, text) of all files below ``root`` with a known extension; PDF needs a parser and is left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kept = rows.filter(extension(F.col("path")).isin(*[e for e in extensions if e != ".pdf"]))
    return kept.select("path", F.decode("content", "UTF-8").alias("text"), "length", "modificationTime")


def checksum(files: DataFrame) -> DataFrame:
    """One SHA-256 over path, size and time of all files, in order: the key of a stored index."""
    line = F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
    return files.agg(F.sha2(F.concat_ws(";", F.sort_array(F.collect_list(line))), 256).alias("checksum"))


def stored_index(spark: SparkSession, root: str, store: str, build) -> DataFrame:
    """The chunks of ``root``, from ``store``/<checksum> if that is there, else built and written."""
    files = read_corpus(spark, root)
    path = f"{store}/{checksum(files).first()[0]}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        build(files).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
