"""Lexical search: LIKE terms, overlap, BM25, Jaccard, edit distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring as R
from ..functions import text as X
from ..sources import store


def like_any(rows: DataFrame, column: str, terms: list[str]) -> DataFrame:
    """Rows that hold any term, whatever its case; no terms, no rows."""
    return rows.filter(X.contains_any(F.col(column), terms))


def like_fallback(facts: DataFrame, words: list[str], k: int = 10) -> DataFrame:
    """Matches by importance, then newest; the overlap score rides along and doesn't order them."""
    array = F.array(*[F.lit(w) for w in words])
    low = F.lower("atomic_text")
    keywords = F.array_join(X.index_words(F.col("atomic_text")), " ")
    hits = facts.filter(X.contains_any(F.col("atomic_text"), words)).orderBy(F.desc("importance"), F.desc("created_at"), F.desc("id")).limit(k)
    return hits.withColumn("score", R.overlap_score(array, low, keywords))


def postings(docs: DataFrame, id_column: str = "id", column: str = "atomic_text") -> DataFrame:
    """(id, term, tf, length); stems are made after the explode, in generated code."""
    words = docs.select(F.col(id_column).alias("id"), X.index_tokens(F.col(column)).alias("words"))
    raw = words.select("id", F.size("words").alias("length"), F.explode("words").alias("raw"))
    return raw.groupBy("id", "length", X.stem(F.col("raw")).alias("term")).agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, id_column: str = "id", column: str = "atomic_text") -> DataFrame:
    """(query_id, id, score, rank); ``queries`` has query_id and query.

    Texts are cut into words once: the postings of the queries' terms are
    stored, and with them a row for each document (its term is no word), from
    which the number of documents and their average length come.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(X.index_words(F.col("query")))).alias("term"))
    wanted = terms.select("term").distinct().withColumn("wanted", F.lit(True))
    words = docs.select(F.col(id_column).alias("id"), X.index_tokens(F.col(column)).alias("words"))
    own = F.array(F.concat(F.lit("\0"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    each = words.select("id", F.size("words").alias("length"), F.explode(F.concat(F.coalesce("words", F.array().cast("array<string>")), own)).alias("raw"))
    found = each.select("id", "length", X.stem(F.col("raw")).alias("term")).join(wanted, "term", "left").filter(F.col("wanted") | F.col("term").startswith("\0"))
    kept = store.stored(found.groupBy("term", "id", "length").agg(F.count("*").alias("tf")), "bm25-terms")
    about = kept.filter(F.col("term").startswith("\0"))
    stats = about.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"), (F.sum(F.col("length") * F.col("tf")).cast("double") / F.sum(F.when(F.col("length").isNotNull(), F.col("tf")))).alias("average"))
    tf = kept.filter(~F.col("term").startswith("\0"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + (F.lit(1 - b) + F.col("length") * b / F.col("average")) * k1)
    scored = tf.join(df, "term").join(terms, "term").crossJoin(F.broadcast(stats)).groupBy("query_id", "id").agg(F.sum(idf * weight).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def keyword_topn(docs: DataFrame, n: int = 20, id_column: str = "id", column: str = "atomic_text") -> DataFrame:
    """(id, keyword, n, rank): each document's most frequent stems, ties by the word."""
    counted = postings(docs, id_column, column).select("id", F.col("term").alias("keyword"), F.col("tf").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "keyword"))).filter(F.col("rank") <= n)


def expand_query(query: DataFrame, hints: DataFrame, max_terms: int) -> DataFrame:
    """The query with the most frequent hint terms that it lacks, up to ``max_terms`` terms in all."""
    own = query.select("query", X.rag_keywords(F.col("query")).alias("own"))
    words = hints.select(F.explode(X.rag_keywords(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    free = words.crossJoin(F.broadcast(own)).filter(~F.array_contains("own", F.col("term")))
    top = free.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n"), "term"))).filter(F.col("rank") <= max_terms - F.size("own"))
    more = top.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]), " ").alias("more"))
    return own.join(more, "query", "left").select("query", F.concat_ws(" ", "query", "more").alias("expanded"))
