"""Extraction and query analysis on all documents, turns and queries; tests compare literal English rows with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import hooks
from ..functions import scoring as R
from ..functions import text as X
from ..functions import wordlists as W
from ..operators import extract as E
from ..sources import tables as T
from ..streaming import salience
from .registry import ORACLES, literal, query

LINES = [
    (1, "Maria Lopez works at Acme and lives in Lisbon."), (2, "John is Mary's husband."), (3, "Dr. Alan Grant met Ellie Sattler in Montana."), (4, "Peter joined Initech last year and moved to New York yesterday."),
    (5, "My sister Anna is a member of Greenpeace."), (6, "Released 2024-03-05 in Germany for $1,200.50, not 10% less?"), (7, "I saw him 3 days ago and will see her in 2 weeks."), (8, "why does the cat sleep so much?"),
    (9, "Blue Widget Company opened an office at Boston on March 5, 2024"), (10, "nothing here"),
]
QUESTIONS = [
    (1, "What is my name?"), (2, "Why did Anna Smith move to Paris last year?"), (3, "Compare the difference between coffee and tea"), (4, "Where do I live?"), (5, "When is my meeting with Bob"), (6, "tell me more about \"Project X\" if you would"),
    (7, "How should I not forget the password that never changed since 2019?"), (8, "pizza"), (9, "Is it good?"), (10, "Which city did Maria visit before March and could she have liked it more than Rome or Oslo or Berlin, assuming she went?"),
]
esc = lambda s: s.replace("'", "''")
LINES_SQL = "l AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{esc(t)}')" for i, t in LINES) + ") v(id, text))"
Q_SQL = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{esc(t)}')" for i, t in QUESTIONS) + ") v(id, text))"


def lines(spark, sf):
    return spark.createDataFrame(LINES, "id int, text string")


def questions(spark, sf):
    return spark.createDataFrame(QUESTIONS, "id int, text string")


def documents(spark, sf):
    return T.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def benchmark(spark, sf):
    return T.read(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")


DOCUMENTS_SQL, BENCHMARK_SQL = "l AS (SELECT doc_id AS id, text FROM documents)", "q AS (SELECT item_id AS id, text FROM benchmark)"


def whole(f, rows, *sql):
    """The same query over a whole table; ``sql``: pairs of a text and a new one in its SQL there, where that can be said."""

    def run(spark, sf):
        return f(spark, sf, rows)

    own = ORACLES[f.__name__]
    literal(f, run)
    if sql:
        for old, new in sql:
            assert old in own
            own = own.replace(old, new)
        ORACLES[f.__name__] = own


FIXED = [("today", "2024-02-01"), ("yesterday", "2024-01-31"), ("tomorrow", "2024-02-02"), ("last week", "the week of 2024-01-25"), ("this week", "the week of 2024-02-01"), ("next week", "the week of 2024-02-08"), ("last month", "January 2024"), ("this month", "February 2024"), ("next month", "March 2024"), ("last year", "2023"), ("this year", "2024"), ("next year", "2025"), ("3 days ago", "2024-01-29"), ("2 weeks ago", "2024-01-18"), ("in 2 weeks", "by 2024-02-15"), ("in 3 days", "by 2024-02-04"), ("this morning", "on 2024-02-01 morning"), ("tonight", "on 2024-02-01 evening"), ("last night", "on 2024-01-31 evening"), ("recently", "around 2024-02-01")]


def _nested(column: str) -> str:
    for phrase, value in FIXED:
        column = f"regexp_replace({column}, '(?i)\\b{phrase}\\b', '{value}', 'g')"
    return column


@query(f"WITH {LINES_SQL} SELECT id, {_nested('text')} AS anchored FROM l")
def temporal_anchor(spark, sf, rows=lines):
    return rows(spark, sf).select("id", E.anchor_times(F.col("text"), T.now()).alias("anchored"))


def _rel_sql() -> str:
    parts = []
    for kind, confidence, pattern in W.RELATIONS:
        p = esc(pattern)
        label = f"unnest(regexp_extract_all(text, '{p}', 3))" if kind == "kin" else f"'{kind}'"
        parts.append(f"SELECT id, unnest(regexp_extract_all(text, '{p}', 1)) AS source, unnest(regexp_extract_all(text, '{p}', 2)) AS target, {label} AS relation_type, {confidence}e0 AS confidence FROM l")
    return f"WITH {LINES_SQL} " + " UNION ALL ".join(parts)


@query(_rel_sql())
def relation_regex(spark, sf, rows=lines):
    return E.relations(rows(spark, sf))


@query(f"""WITH {LINES_SQL}, m AS (SELECT id, 1 AS i, 'person' AS entity_type, unnest(regexp_extract_all(text, '{W.TITLED}', 2)) AS name FROM l UNION ALL SELECT id, 2, 'person', unnest(regexp_extract_all(text, '{W.MY_RELATIVE}', 2)) FROM l
UNION ALL SELECT id, 3, 'organization', unnest(regexp_extract_all(text, '{W.COMPANY}', 0)) FROM l UNION ALL SELECT id, 4, 'place', unnest(regexp_extract_all(text, '{W.LOCATION}', 2)) FROM l),
k AS (SELECT *, lower(name) AS key FROM m WHERE lower(name) NOT IN ({', '.join("'" + w + "'" for w in W.COMMON_WORDS)})) SELECT id, key, arg_max(name, i) AS name, arg_max(entity_type, i) AS entity_type FROM k GROUP BY id, key""")
def entity_regex(spark, sf, rows=lines):
    return E.entities(rows(spark, sf))


@query(f"""WITH {LINES_SQL} SELECT id, regexp_matches(trim(text), '\\?$') AS is_question, regexp_matches(text, '{esc(W.NEGATION)}') AS is_negation, regexp_matches(text, '{W.NUMBER}') OR regexp_matches(text, '{W.CURRENCY}') AS has_numbers,
CAST(len(regexp_extract_all(text, '{W.DATE_YMD}')) + len(regexp_extract_all(text, '{W.DATE_MDY}')) + len(regexp_extract_all(text, '{W.DATE_WRITTEN}')) AS INTEGER) AS n_times,
array_to_string(list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(text, '{W.CITY}', 2), regexp_extract_all(text, '{W.COUNTRY}', 0)), regexp_extract_all(text, '{W.STATE}', 0)))), ',') AS places FROM l""")
def metadata_flags(spark, sf, rows=lines):
    m = E.metadata(F.col("text"))
    return rows(spark, sf).select("id", m["is_question"].alias("is_question"), m["is_negation"].alias("is_negation"), m["has_numbers"].alias("has_numbers"), F.size(m["times"]).alias("n_times"), F.array_join(m["places"], ",").alias("places"))


@query()
def specificity_score(spark, sf):
    m = E.metadata(F.col("text"), noted=True)
    return E.noted(documents(spark, sf)).select("id", F.round(m["specificity"], 6).alias("specificity"), F.date_format(m["anchor"], "yyyy-MM-dd").alias("anchor"))


REPLIES = [(1, "FACT|pref|0.9|likes tea\nFACT|Goal|abc|run | swim\nnoise\nENTITY|people|Bob\nREL|Bob|knows|Ann|0.6"), (2, "FACT|bio|7|born in 1990\nFACT|x|0.2|\nENTITY|company|Acme\nREL|Bob|works_at|Acme|high")]
REPLY_SQL = "r AS (SELECT id, pos - 1 AS line, trim(raw) AS raw FROM (SELECT id, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM (VALUES " + ", ".join(f"({i}, " + " || chr(10) || ".join(f"'{x}'" for x in t.split(chr(10))) + ")" for i, t in REPLIES) + ") v(id, t)))"


def replies(spark, sf):
    return spark.createDataFrame(REPLIES, "id int, reply string")


def replies_of_turns(spark, sf):
    """No table holds replies: those of the stand-in to every turn, with its names and each name's follower."""
    names, low = E.capitalised(F.col("content")), F.lit("|0.6")
    entities = F.transform(names, lambda n: F.concat(F.lit("ENTITY|"), E.entity_type(n), F.lit("|"), n))
    pairs = F.transform(F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0))), lambda n, i: F.concat(F.lit("REL|"), F.get(names, i), F.lit("|before|"), n, low))
    fact = hooks.facts_by_rule(F.regexp_replace("content", r"\s+", " "))
    return T.turns(spark, sf).filter("content is not null").select("id", F.array_join(F.concat(F.array(fact), entities, pairs), "\n").alias("reply"))


@query(f"""WITH {REPLY_SQL}, f AS (SELECT id, line, lower(trim(split_part(raw, '|', 2))) AS c, try_cast(split_part(raw, '|', 3) AS DOUBLE) AS i, trim(regexp_extract(raw, '^FACT\\|[^|]*\\|[^|]*\\|(.*)$', 1)) AS fact FROM r WHERE starts_with(raw, 'FACT|'))
SELECT id, CAST(line AS INTEGER) AS line, CASE WHEN c IN ('pref', 'preference') THEN 'preference' WHEN c IN ('goal', 'task') THEN 'task' WHEN c IN ('bio') THEN 'biographical' ELSE 'other' END AS category, greatest(0e0, least(1e0, coalesce(i, 0.5e0))) AS importance, fact FROM f WHERE fact <> ''""")
def parse_fact_lines(spark, sf, rows=replies):
    return E.parse_facts(rows(spark, sf))


@query(f"""WITH {REPLY_SQL} SELECT id, CAST(line AS INTEGER) AS line, CASE split_part(raw, '|', 2) WHEN 'people' THEN 'person' WHEN 'company' THEN 'organization' END AS entity_type, split_part(raw, '|', 3) AS name FROM r WHERE starts_with(raw, 'ENTITY|')""")
def parse_entity_lines(spark, sf, rows=replies):
    return E.parse_entities(rows(spark, sf))


@query(f"""WITH {REPLY_SQL} SELECT id, CAST(line AS INTEGER) AS line, split_part(raw, '|', 2) AS source, split_part(raw, '|', 3) AS relation_type, split_part(raw, '|', 4) AS target, coalesce(try_cast(split_part(raw, '|', 5) AS DOUBLE), 0.8e0) AS confidence FROM r WHERE starts_with(raw, 'REL|')""")
def parse_relation_lines(spark, sf, rows=replies):
    return E.parse_relations(rows(spark, sf))


@query("""SELECT * FROM (VALUES (1, 'ADD', CAST(NULL AS BIGINT), 'new'), (2, 'UPDATE', 12, 'changed'), (3, 'NOOP', NULL, 'unclear'), (4, 'DELETE', 3, ''), (5, 'NOOP', NULL, '')) t(id, op, target, reason)""")
def parse_decisions(spark, sf, rows=None):
    replied = rows(spark, sf) if rows else spark.createDataFrame([(1, "ADD|new"), (2, "update 12| changed "), (3, "MAYBE|unclear"), (4, "DELETE [3]"), (5, "")], "id int, reply string")
    d = E.parse_decision(F.col("reply"))
    return replied.select("id", d["op"].alias("op"), d["target"].alias("target"), d["reason"].alias("reason"))


@query()
def coref_replace(spark, sf):
    """State along each conversation; tests hold it, and the same as a stream, against a plain loop."""
    return salience.resolved(T.turns(spark, sf))


def n_of(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{esc(pattern)}', 0))"


def steps(n: str, pairs, last) -> str:
    return "CASE " + " ".join(f"WHEN {n} <= {a} THEN {b}e0" for a, b in pairs) + f" ELSE {last}e0 END"


ENTITIES_SQL = f"len(list_distinct(list_concat(list_filter(regexp_extract_all(text, '\\b{W.NAMES}\\b', 1), lambda n: n NOT IN ({', '.join(chr(39) + w + chr(39) for w in dict.fromkeys(W.QUERY_NOT_NAMES))})), list_transform(regexp_extract_all(text, '{esc(W.QUOTED)}', 0), lambda s: substr(s, 2, length(s) - 2)))))"
COMPLEX_SQL = f"""x AS (SELECT id, text, {steps("len(list_filter(regexp_split_to_array(text, ' +'), lambda t: t <> ''))", ((4, 0.1), (9, 0.3), (14, 0.5), (24, 0.7)), 0.9)} AS length, {steps(ENTITIES_SQL, ((0, 0.1), (1, 0.2), (2, 0.4), (3, 0.6)), 0.8)} AS entity, {steps(n_of(W.TEMPORAL), ((0, 0.0), (1, 0.3), (2, 0.5)), 0.7)} AS temporal,
CASE WHEN regexp_matches(text, '{W.HARD_QUESTION}') THEN 0.8e0 WHEN regexp_matches(text, '{W.MEDIUM_QUESTION}') THEN 0.5e0 WHEN regexp_matches(text, '{W.EASY_QUESTION}') THEN 0.3e0 WHEN NOT ends_with(text, '?') THEN 0.2e0 ELSE 0.4e0 END AS question,
{steps(n_of(W.QUERY_NEGATION), ((0, 0.0), (1, 0.2), (2, 0.4)), 0.6)} AS negation, {steps(n_of(W.COMPARISON), ((0, 0.0), (1, 0.4), (2, 0.6)), 0.8)} AS comparison, {steps(n_of(W.CONDITIONAL), ((0, 0.0), (1, 0.3)), 0.5)} AS conditional FROM q),
y AS (SELECT *, 0.15e0 * length + 0.25e0 * entity + 0.15e0 * temporal + 0.2e0 * question + 0.05e0 * negation + 0.1e0 * comparison + 0.1e0 * conditional AS c FROM x)"""


@query(f"WITH {Q_SQL}, {COMPLEX_SQL} SELECT id, length, entity, temporal, question, negation, comparison, conditional, round(c, 6) AS complexity FROM y")
def complexity_breakdown(spark, sf, rows=questions):
    return rows(spark, sf).select("id", *[v.alias(k) for k, v in R.complexity_parts(F.col("text")).items()], F.round(R.complexity(F.col("text")), 6).alias("complexity"))


@query(f"WITH {Q_SQL}, {COMPLEX_SQL} SELECT id, least(20, CAST(floor(5 * (1 + 2 * c) + 0.5e0) AS INTEGER)) AS k FROM y")
def dynamic_k(spark, sf, rows=questions):
    return rows(spark, sf).select("id", R.dynamic_k(R.complexity(F.col("text"))).alias("k"))


@query(f"""WITH {Q_SQL} SELECT id, CASE WHEN regexp_matches(lower(text), '{W.COMPARISON}') THEN 'comparison' WHEN regexp_matches(text, '{W.HARD_QUESTION}') THEN 'causal' WHEN starts_with(lower(text), 'when') OR regexp_matches(text, '{W.TEMPORAL}') THEN 'temporal'
WHEN starts_with(lower(text), 'where') THEN 'spatial' WHEN regexp_matches(text, '{W.EASY_QUESTION}') THEN 'factual' ELSE 'open' END AS class FROM q""")
def query_class(spark, sf, rows=questions):
    return rows(spark, sf).select("id", R.query_class(F.col("text")).alias("class"))


@query(f"""WITH {LINES_SQL}, w AS (SELECT id, text, lower(text) AS t, list_filter(regexp_split_to_array(lower(text), ' +'), lambda x: x <> '') AS ws FROM l)
SELECT id, round((CASE WHEN contains(t, 'lisbon') THEN 0.5e0 ELSE 0 END + CASE WHEN contains(t, 'acme') THEN 0.5e0 ELSE 0 END), 6) AS term,
CASE WHEN len(ws) < 3 THEN 0.3e0 WHEN len(ws) < 10 THEN 0.7e0 WHEN len(ws) < 30 THEN 1e0 WHEN len(ws) < 50 THEN 0.8e0 ELSE 0.6e0 END AS length,
CASE WHEN t = 'lisbon acme' THEN 1e0 WHEN starts_with(t, 'lisbon acme') OR ends_with(t, 'lisbon acme') THEN 0.8e0 WHEN contains(t, 'lisbon acme') THEN 0.6e0 ELSE 0e0 END AS exact,
round((CASE WHEN len(list_filter(ws, lambda x: levenshtein('lisbon', x) <= 2)) > 0 THEN 0.5e0 ELSE 0 END + CASE WHEN len(list_filter(ws, lambda x: levenshtein('acme', x) <= 2)) > 0 THEN 0.5e0 ELSE 0 END), 6) AS fuzzy,
round(CASE WHEN contains(t, 'lisbon') THEN 1 - (strpos(t, 'lisbon') - 1) / CAST(strlen(t) AS DOUBLE) WHEN contains(t, 'acme') THEN 1 - (strpos(t, 'acme') - 1) / CAST(strlen(t) AS DOUBLE) ELSE 0.5e0 END, 6) AS position FROM w""")
def rerank_features(spark, sf, rows=lines):
    parts = R.rerank_parts(F.lit("Lisbon Acme"), F.col("text"))
    return rows(spark, sf).select("id", *[F.round(v, 6).alias(k) for k, v in parts.items()])


@query()
def capitalised_entities(spark, sf):
    return documents(spark, sf).select("id", F.explode(E.capitalised(F.col("text"))).alias("name")).select("id", "name", E.entity_type(F.col("name")).alias("entity_type"))


@query(f"""WITH {LINES_SQL}, w AS (SELECT id, unnest(regexp_split_to_array(lower(text), ' +')) AS w FROM l), c AS (SELECT id, w, count(*) AS n FROM w GROUP BY ALL) SELECT id, max(n) >= 3 AS bad FROM c GROUP BY id""")
def repeated_word_test(spark, sf, rows=lines):
    return rows(spark, sf).select("id", E.bad_resolution(F.col("text")).alias("bad"))


@query(f"WITH {LINES_SQL} SELECT id, CASE WHEN strlen(text) > 40 THEN left(text, 40) || '...' ELSE text END AS cut FROM l")
def truncate_tokens(spark, sf, rows=lines):
    return rows(spark, sf).select("id", X.truncate_tokens(F.col("text"), 10).alias("cut"))


def decisions_of_facts(spark, sf):
    """A stand-in's decision for each document: every third names the one before it."""
    i = F.col("id").cast("string")
    reply = F.when(F.col("id") % 3 == 0, F.concat(F.lit("UPDATE ["), (F.col("id") - 1).cast("string"), F.lit("]|"), F.left("text", F.lit(20)))).otherwise(F.concat(F.lit("ADD|"), i))
    return documents(spark, sf).select("id", reply.alias("reply"))


for _f in (temporal_anchor, relation_regex, entity_regex, metadata_flags, truncate_tokens):
    whole(_f, documents, (LINES_SQL, DOCUMENTS_SQL))
whole(rerank_features, documents)  # edit distances count characters here and bytes in SQL
for _f in (repeated_word_test,):
    whole(_f, documents, (LINES_SQL, DOCUMENTS_SQL), ("regexp_split_to_array(lower(text), ' +')", r"regexp_split_to_array(lower(text), '\s+')"))
for _f in (complexity_breakdown, dynamic_k, query_class):
    whole(_f, benchmark, (Q_SQL, BENCHMARK_SQL))
for _f in (parse_fact_lines, parse_entity_lines, parse_relation_lines):
    whole(_f, replies_of_turns)
whole(parse_decisions, decisions_of_facts)
