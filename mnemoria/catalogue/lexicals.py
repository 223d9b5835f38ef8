"""Lexical search and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as R
from ..functions import text as X
from ..functions import wordlists as W
from ..operators import lexical, rag, similarity
from ..operators.fulltext import FullText
from ..sources import store
from ..sources import tables as T
from .registry import ORACLES, query, whole
from .vectors import bench_queries

FACTS = T.FACTS_SQL
TERMS = ["thion", "onth", "queque"]
quoted = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(words))
TOKENS = "list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{Nd}}]+'), lambda t: t <> '')"
STOPPED = f"list_filter({TOKENS}, lambda t: strlen(t) >= 2 AND t NOT IN ({quoted(W.INDEX_STOPWORDS).replace('{', '{{')}))"
WHITE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
FIELDS = "list_filter(regexp_split_to_array({c}, '" + WHITE.replace("{", "{{").replace("}", "}}") + "'), lambda t: t <> '')"
STEM = X.stem_sql("w")


@query(f"""SELECT conv_id, turn FROM conversations WHERE {' OR '.join(f"contains(lower(text), '{t}')" for t in TERMS)}""")
def like_any_search(spark, sf):
    return lexical.like_any(T.turns(spark, sf), "content", TERMS).select("conv_id", "turn")


@query(f"""WITH {FACTS}, h AS (SELECT * FROM facts WHERE {' OR '.join(f"contains(lower(atomic_text), '{t}')" for t in TERMS)} ORDER BY importance DESC, created_at DESC, id DESC LIMIT 10),
w AS (SELECT id, unnest({STOPPED.format(c='atomic_text')}) AS w FROM h), k AS (SELECT id, string_agg({STEM}, ' ') AS kw FROM w GROUP BY id)
SELECT h.id, round(({' + '.join(f"(CASE WHEN contains(lower(atomic_text), '{t}') THEN 1e0 ELSE 0 END) + (CASE WHEN contains(kw, '{t}') THEN 0.5e0 ELSE 0 END)" for t in TERMS)}) / 3, 6) AS score FROM h JOIN k ON k.id = h.id""")
def like_fallback_score(spark, sf):
    return lexical.like_fallback(T.facts(spark, sf), TERMS).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH w AS (SELECT doc_id, {FIELDS.format(c='lower(text)')} AS words FROM documents),
b AS (SELECT doc_id, len(words) AS n, list_transform(words, lambda t: trim(t, '.,!?;:"''()[]{{}}')) AS bare FROM w),
t AS (SELECT doc_id, n, len(list_filter(bare, lambda t: t = 'then')) AS a, len(list_filter(bare, lambda t: t = 'the')) AS b FROM b)
SELECT doc_id, round((CASE WHEN a > 0 THEN a * 2.5e0 / (a + 1.5e0 * (0.25e0 + 0.75e0 * n / 100)) ELSE 0 END + CASE WHEN b > 0 THEN b * 2.5e0 / (b + 1.5e0 * (0.25e0 + 0.75e0 * n / 100)) ELSE 0 END) / 2, 6) AS score FROM t""")
def saturated_tf_score(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", F.round(R.saturated_tf(F.array(F.lit("then"), F.lit("the")), F.col("text")), 6).alias("score"))


@query(f"""WITH d AS (SELECT doc_id AS id, {STOPPED.format(c='text')} AS ws FROM documents), n AS (SELECT count(*) AS n, avg(len(ws)) AS av FROM d),
x AS (SELECT id, len(ws) AS len, unnest(ws) AS w FROM d), p AS (SELECT id, len, {STEM} AS term FROM x), tf AS (SELECT id, len, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qx AS (SELECT item_id AS query_id, unnest({STOPPED.format(c='text')}) AS w FROM benchmark WHERE item_id < 10 AND item_id IN (SELECT vec_id FROM embeddings)), q AS (SELECT DISTINCT query_id, {STEM} AS term FROM qx),
s AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len / av))) AS score FROM tf JOIN df USING (term) JOIN q USING (term), n GROUP BY query_id, id),
r AS (SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS INTEGER) AS rank FROM s) SELECT query_id, id, score, rank FROM r WHERE rank <= 10""")
def bm25_topk(spark, sf, some="item_id < 10"):
    q = bench_queries(spark, sf, some).select("query_id", F.col("text").alias("query"))
    docs = T.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("atomic_text"))
    return lexical.bm25(docs, q).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


whole(bm25_topk, " item_id < 10 AND", "true")


def _texts(spark, sf):
    return T.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("atomic_text"))


def _searched(index, spark, sf):
    found = index.search(bench_queries(spark, sf).select("query_id", F.col("text").alias("query")))
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(ORACLES["bm25_topk"])
def fulltext_insert_then_search(spark, sf):
    """An index of a third of the documents; the others are appended, and searched without a rebuild."""
    docs = _texts(spark, sf)
    index = FullText.create(spark, store.scratch(spark, "fulltext"), docs.filter("id % 3 = 0"))
    return _searched(index.append(docs.filter("id % 3 <> 0")), spark, sf)


@query(ORACLES["bm25_topk"].replace("AS ws FROM documents)", "AS ws FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 4 THEN text || ' ' || text ELSE text END AS text FROM documents WHERE doc_id % 10 <> 3))"))
def fulltext_after_changes(spark, sf):
    """Documents deleted and changed, then all merged into one segment."""
    docs = _texts(spark, sf)
    index = FullText.create(spark, store.scratch(spark, "fulltext"), docs)
    changed = docs.filter("id % 10 = 4").withColumn("atomic_text", F.concat("atomic_text", F.lit(" "), "atomic_text"))
    return _searched(index.delete(docs.filter("id % 10 = 3")).append(changed).merge(), spark, sf)


def similar_sql(sets: str, keep: str = "true") -> str:
    """Pairs of classes of equal sets (id, m) that share a member, with what they share, where ``keep`` holds."""
    return f"""WITH {sets}, c AS (SELECT min(id) AS id, m FROM s WHERE len(m) > 0 GROUP BY m), e AS (SELECT id, len(m) AS n, unnest(m) AS t FROM c),
p AS (SELECT x.id AS a, y.id AS b, any_value(x.n) + any_value(y.n) AS size2, count(*) AS shared FROM e x JOIN e y ON x.t = y.t AND x.id < y.id GROUP BY x.id, y.id)
SELECT a, b, CAST(shared AS INTEGER) AS shared, CAST(size2 - shared AS INTEGER) AS total FROM p WHERE {keep}"""


WORD_SETS = f"s AS (SELECT doc_id AS id, list_sort(list_distinct({FIELDS.format(c='lower(text)')})) AS m FROM documents)"
KEYWORD_SETS = f"w AS (SELECT doc_id, unnest({STOPPED.format(c='text')}) AS w FROM documents), s AS (SELECT doc_id AS id, list_sort(list(DISTINCT {STEM})) AS m FROM w GROUP BY doc_id)"
NAME_SETS = "s AS (SELECT p_partkey AS id, list_sort(list_distinct(list_transform(range(1, length(p_name) - 1), lambda i: substr(lower(p_name), i, 3)))) AS m FROM part)"


def _sets(spark, sf, kind):
    if kind == "names":
        return T.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.length("p_name") >= 3, X.trigrams(F.lower("p_name"))).alias("members"))
    text = F.col("text")
    return T.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), (X.fields(F.lower(text)) if kind == "words" else X.index_words(text)).alias("members"))


@query(f"""WITH d AS (SELECT doc_id, list_distinct({FIELDS.format(c='lower(text)')}) AS w FROM documents)
SELECT x.doc_id AS a, y.doc_id AS b, round(CASE WHEN len(x.w) = 0 AND len(y.w) = 0 THEN 1e0 WHEN len(x.w) = 0 OR len(y.w) = 0 THEN 0e0 ELSE len(list_intersect(x.w, y.w)) / CAST(len(list_distinct(list_concat(x.w, y.w))) AS DOUBLE) END, 6) AS score FROM d x JOIN d y ON x.doc_id < y.doc_id""")
def word_jaccard_pairs(spark, sf):
    """Every two documents; the result is as large as that."""
    return similarity.all_jaccard(_sets(spark, sf, "words"))


@query(f"""WITH d AS (SELECT doc_id, unnest({STOPPED.format(c='text')}) AS w FROM documents), k AS (SELECT doc_id, list(DISTINCT {STEM}) AS ks FROM d GROUP BY doc_id)
SELECT x.doc_id AS a, y.doc_id AS b, round(len(list_intersect(x.ks, y.ks)) / CAST(len(list_distinct(list_concat(x.ks, y.ks))) AS DOUBLE), 6) AS score FROM k x JOIN k y ON x.doc_id < y.doc_id""")
def keyword_jaccard(spark, sf):
    return similarity.all_jaccard(_sets(spark, sf, "keywords").filter(F.size("members") > 0))


@query(similar_sql(WORD_SETS, "shared * 10 >= (size2 - shared) * 6"))
def similar_by_words(spark, sf):
    return similarity.similar_sets(_sets(spark, sf, "words"), 6, 10)


@query(similar_sql(KEYWORD_SETS, "shared * 10 >= (size2 - shared) * 6"))
def similar_by_keywords(spark, sf):
    return similarity.similar_sets(_sets(spark, sf, "keywords"), 6, 10)


@query(similar_sql(NAME_SETS, "shared * 10 >= (size2 - shared) * 6"))
def similar_names(spark, sf):
    return similarity.similar_sets(_sets(spark, sf, "names"), 6, 10)


@query("""WITH n AS (SELECT s_suppkey AS id, lower(s_name) AS s FROM supplier WHERE s_suppkey <= 40), g AS (SELECT id, s, list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) AS t FROM n)
SELECT x.id AS a, y.id AS b, round(CASE WHEN x.s = y.s THEN 1e0 ELSE len(list_intersect(x.t, y.t)) / CAST(len(list_distinct(list_concat(x.t, y.t))) AS DOUBLE) END, 6) AS score FROM g x JOIN g y ON x.id < y.id""")
def trigram_name_similarity(spark, sf, some="s_suppkey <= 40"):
    n = T.read(spark, sf, "supplier").filter(some).select(F.col("s_suppkey").alias("id"), F.lower("s_name").alias("s"))
    # a name without trigrams stands for itself, so that equal ones are alike
    sets = n.select("id", F.when(F.length("s") >= 3, X.trigrams(F.col("s"))).when(F.col("s").isNotNull(), F.array("s")).alias("members"))
    return similarity.all_jaccard(sets)


whole(trigram_name_similarity, " WHERE s_suppkey <= 40", "true")


@query("SELECT p.p_partkey AS id, q.w AS word FROM part p, (VALUES ('blue'), ('colt'), ('hat'), ('large')) q(w) WHERE levenshtein(lower(split_part(p_name, ' ', 1)), q.w) <= 2")
def edit_distance_match(spark, sf):
    p = T.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lower(F.element_at(F.split("p_name", " "), 1)).alias("w"))
    words = F.explode(F.array(*[F.lit(w) for w in ("blue", "colt", "hat", "large")])).alias("word")
    return p.select("id", "w", words).filter(F.levenshtein("w", "word", 2) >= 0).select("id", "word")


@query(f"""WITH d AS (SELECT doc_id AS id, unnest({STOPPED.format(c='text')}) AS w FROM documents), k AS (SELECT id, {STEM} AS keyword, count(*) AS n FROM d GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY n DESC, keyword) AS INTEGER) AS rank FROM k) SELECT id, keyword, n, rank FROM r WHERE rank <= 20""")
def keyword_topn_per_doc(spark, sf):
    return lexical.keyword_topn(T.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("atomic_text")))


@query(f"WITH d AS (SELECT unnest({TOKENS.format(c='text')}) AS w FROM documents) SELECT {STEM} AS stem, count(*) AS n FROM d GROUP BY 1")
def stem_tokens(spark, sf):
    words = T.read(spark, sf, "documents").select(F.explode(X.tokenize(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return words.groupBy(X.stem(F.col("w")).alias("stem")).agg(F.sum("n").alias("n"))


@query(f"""WITH w AS (SELECT item_id, list_filter(list_transform({FIELDS.format(c='lower(text)')}, lambda t: regexp_replace(t, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')), lambda t: strlen(t) >= 2 AND t NOT IN ({quoted(W.QUERY_STOPWORDS)})) AS k FROM benchmark)
SELECT item_id, array_to_string(k, ' ') AS keywords FROM w""")
def query_keywords(spark, sf):
    return T.read(spark, sf, "benchmark").select("item_id", F.array_join(X.query_keywords(F.col("text")), " ").alias("keywords"))


@query(f"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: strlen(t) > 2 AND t NOT IN ({quoted(W.TURN_STOPWORDS)})) AS k FROM conversations) SELECT conv_id, turn, array_to_string(k, ' ') AS terms FROM w""")
def like_terms(spark, sf):
    return T.turns(spark, sf).select("conv_id", "turn", F.array_join(X.like_terms(F.col("content")), " ").alias("terms"))


@query(f"WITH d AS (SELECT doc_id, unnest({STOPPED.format(c='text')}) AS w FROM documents) SELECT {STEM} AS term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM d GROUP BY 1")
def term_document_frequency(spark, sf):
    p = lexical.postings(T.read(spark, sf, "documents"), "doc_id", "text")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query("""WITH c AS (SELECT 'c' || c_custkey AS name FROM customer) SELECT name, sha256(lower(trim(name))) AS key, left(sha256(name), 32) AS short FROM c""")
def hash_keys(spark, sf):
    c = T.read(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"))
    return c.select("name", X.hash_key(F.col("name")).alias("key"), X.short_hash(F.col("name")).alias("short"))


@query(f"""WITH w AS (SELECT doc_id, {FIELDS.format(c='text')} AS words FROM documents), i AS (SELECT doc_id, words, unnest(range(0, greatest(0, CAST(ceil((len(words) - 128) / 112e0) AS BIGINT)) + 1)) AS idx FROM w WHERE len(words) > 0)
SELECT CAST(doc_id AS VARCHAR) || '#' || idx AS id, CAST(idx AS INTEGER) AS idx, sha256(array_to_string(list_slice(words, idx * 112 + 1, idx * 112 + 128), ' ')) AS h FROM i""")
def word_chunks(spark, sf):
    return rag.chunks(T.read(spark, sf, "documents"), "doc_id", "text", 128, 16).select("id", "idx", F.sha2("text", 256).alias("h"))


@query()
def chunk_merge(spark, sf):
    c = rag.chunks(T.read(spark, sf, "documents"), "doc_id", "text", 64, 8).withColumn("score", F.pmod(F.xxhash64("id"), F.lit(100)) / 100.0)
    return rag.merge_adjacent(c.filter("score > 0.3"), 300).select("source", "first", "last", F.round("score", 6).alias("score"), "tokens")


@query(f"""WITH s AS (SELECT {FIELDS.format(c="lower('thion onth')")} AS own),
w AS (SELECT doc_id, unnest(list_distinct(list_filter(list_transform({FIELDS.format(c='lower(text)')}, lambda t: trim(t, '.,!?;:"''()[]{{}}')), lambda t: strlen(t) >= 2 AND t NOT IN ({quoted(W.RAG_STOPWORDS)})))) AS term FROM documents),
n AS (SELECT term, count(*) AS n FROM w GROUP BY term), t AS (SELECT term, n FROM n, s WHERE NOT list_contains(own, term) ORDER BY n DESC, term LIMIT 6)
SELECT 'thion onth ' || string_agg(term, ' ' ORDER BY n DESC, term) AS expanded FROM t""")
def query_expansion(spark, sf):
    q = spark.createDataFrame([("thion onth",)], "query string")
    return lexical.expand_query(q, T.read(spark, sf, "documents").select("text"), 8).select("expanded")


@query("""SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS n FROM pages""")
def page_text(spark, sf):
    return T.read(spark, sf, "pages").select("page_id", F.length(X.strip_html(F.col("html"))).cast("long").alias("n"))
