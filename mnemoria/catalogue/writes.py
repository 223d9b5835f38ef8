"""The write path: conversations ingested in three epochs, and what the tables then hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import wordlists as W
from ..sources import store
from ..sources import tables as T
from ..streaming import memory
from .registry import query
from .texts import _nested, esc

SAID = f"""t AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, trim(coalesce(role, '') || ': ' || coalesce(text, '') || chr(10), ' ' || chr(9) || chr(10) || chr(13) || chr(12)) AS said, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id * 60 + turn) AS created_at FROM conversations),
f AS (SELECT id, conv_id, turn, created_at, said, strlen(said) >= {memory.LEAST} AS encoded, CASE WHEN strlen(said) >= {memory.LEAST} THEN {_nested("said")} ELSE said END AS text FROM t)"""
FOUND = f"""m AS (SELECT id, created_at, 1 AS i, 'person' AS entity_type, unnest(regexp_extract_all(said, '{W.TITLED}', 2)) AS name FROM f WHERE encoded UNION ALL SELECT id, created_at, 2, 'person', unnest(regexp_extract_all(said, '{W.MY_RELATIVE}', 2)) FROM f WHERE encoded
UNION ALL SELECT id, created_at, 3, 'organization', unnest(regexp_extract_all(said, '{W.COMPANY}', 0)) FROM f WHERE encoded UNION ALL SELECT id, created_at, 4, 'place', unnest(regexp_extract_all(said, '{W.LOCATION}', 2)) FROM f WHERE encoded),
k AS (SELECT id, created_at, lower(name) AS key, max({{'i': i, 'name': name}}).name AS name, arg_max(entity_type, i) AS entity_type FROM m WHERE lower(name) NOT IN ({', '.join("'" + w + "'" for w in W.COMMON_WORDS)}) GROUP BY id, created_at, lower(name))"""


def _ingested(spark, sf) -> str:
    """The tables' folder after three epochs, the second of them tried twice and the last turns sent again."""
    turns = T.turns(spark, sf).select("conv_id", "turn", "role", "content", "created_at")
    target = store.scratch(spark, "memory")
    third = F.col("turn") % 3
    for epoch in (0, 1, 1, 2):
        memory.write_epoch(turns.filter((third == epoch) | ((third == 0) if epoch == 2 else F.lit(False))), epoch, target, T.now())
    return target


@query(f"WITH {SAID} SELECT id, conv_id, turn, sha256(text) AS h, 'other' AS category, 0.5e0 AS importance FROM f")
def ingest_facts(spark, sf):
    return memory.facts(spark, _ingested(spark, sf)).select("id", "conv_id", "turn", F.sha2("atomic_text", 256).alias("h"), "category", "importance")


@query(f"WITH {SAID}, {FOUND} SELECT lower(trim(name)) AS normalized_name, arg_min(name, {{'a': created_at, 'b': id, 'c': name}}) AS name, arg_min(entity_type, {{'a': created_at, 'b': id, 'c': name}}) AS entity_type, count(*) AS mention_count FROM k GROUP BY 1")
def ingest_entities(spark, sf):
    return memory.entities(spark, _ingested(spark, sf))


def _edges() -> str:
    parts = []
    for kind, confidence, pattern in W.RELATIONS:
        p = esc(pattern)
        label = f"unnest(regexp_extract_all(text, '{p}', 3))" if kind == "kin" else f"'{kind}'"
        parts.append(f"SELECT id, created_at, unnest(regexp_extract_all(text, '{p}', 1)) AS source, unnest(regexp_extract_all(text, '{p}', 2)) AS target, {label} AS relation_type, {confidence}e0 AS confidence FROM f WHERE encoded")
    return "e AS (" + " UNION ALL ".join(parts) + ")"


@query(f"WITH {SAID}, {_edges()} SELECT lower(trim(source)) AS source, lower(trim(target)) AS target, relation_type, max(confidence) AS confidence, arg_min(id, {{'a': created_at, 'b': id}}) AS fact_id FROM e GROUP BY 1, 2, 3")
def ingest_relations(spark, sf):
    return memory.relations(spark, _ingested(spark, sf))


@query(f"WITH {SAID}, {FOUND}, n AS (SELECT id // 1000 AS conv_id, count(DISTINCT lower(trim(name))) AS n_entities FROM k GROUP BY 1) SELECT conv_id, min(created_at) AS started_at, max(created_at) AS ended_at, count(*) AS fact_count, coalesce(any_value(n_entities), 0) AS n_entities FROM f LEFT JOIN n USING (conv_id) GROUP BY conv_id")
def ingest_episodes(spark, sf):
    return memory.episodes(spark, _ingested(spark, sf))
