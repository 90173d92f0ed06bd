"""Queries of the general corpus operators: nested records and units."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import nested, units
from tessera.session import table

Query = Callable[[SparkSession, str], DataFrame]

FIELDS = {
    "plan_question": ["id", "question"], "plan_kpi": [], "question": ["id", "answer", "stronger_side", "confidence"], "question_claim": [], "judge_claim": [],
    "claim_review": ["claim", "status", "flag"], "review_source": [], "resolution": ["claim", "resolution"], "anchor": [],
}


def _flat(entity: str) -> Query:
    return lambda s, d: nested.event_tables(table(s, d, "run_events")).flat(entity, FIELDS[entity])


def _tables(s: SparkSession, d: str) -> DataFrame:
    """The tables that all readable records fall apart into: how many rows and parents each has."""
    items, fields = nested.recursive_tables(table(s, d, "run_events"), "event_id", "data")
    n = fields.groupBy("item_id").agg(F.count("*").alias("n"))
    return items.join(n, "item_id", "left").groupBy("table").agg(F.count("*").alias("rows"), F.count_distinct("parent_id").alias("parents"), F.max("ordinal").alias("longest"), F.sum("n").alias("fields"))


def _amounts(s: SparkSession, d: str) -> DataFrame:
    return units.run_amounts(table(s, d, "runs"), table(s, d, "fx"), table(s, d, "common_units"))


def queries() -> dict[str, Query]:
    return {
        "p3_found": lambda s, d: nested.event_tables(table(s, d, "run_events")).found(),
        **{f"p3_{e}": _flat(e) for e in FIELDS},
        "p3_tables": lambda s, d: _tables(s, d),
        "p6_found": lambda s, d: _amounts(s, d).select("run_id", "line_no", "amount").distinct(),
        "p6_amounts": _amounts,
        "p6_rejected": lambda s, d: units.run_rejected(table(s, d, "runs"), table(s, d, "fx"), table(s, d, "common_units")),
    }


def _decoded(x: str) -> str:
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND regexp_matches(json_extract_string({x}, '$'), '^\\s*[\\[{{\"]') AND json_valid(json_extract_string({x}, '$')) THEN CAST(json_extract_string({x}, '$') AS JSON) ELSE {x} END"


def _members(x: str, scalar: bool) -> str:
    named = f"list_transform(list_sort(json_keys({x})), lambda k: json_extract({x}, '$.\"' || k || '\"'))"
    is_map = f"json_type({x}) = 'OBJECT'" + ("" if scalar else f" AND len(list_filter({named}, lambda z: json_type(z) NOT IN ('OBJECT', 'NULL'))) = 0")
    return f"CASE WHEN {x} IS NULL OR json_type({x}) = 'NULL' THEN [] WHEN json_type({x}) = 'ARRAY' THEN json_extract({x}, '$[*]') WHEN {is_map} THEN {named} ELSE [{x}] END"


# entity -> (record kind, path, scalar items, child entity, child field)
NESTED = {
    "plan_question": ("planner", "$.plan.key_questions", False, "plan_kpi", "kpis"), "question": ("judge", "$.questions", False, "question_claim", "unsupported_claims"), "judge_claim": ("judge", "$.unsupported_claims", True, None, None),
    "claim_review": ("news_verify", "$.claim_reviews", False, "review_source", "sources"), "resolution": ("review", "$.report.resolutions", False, "anchor", "anchors"),
}
TREES = (
    """WITH raw AS (SELECT DISTINCT event_id, lower(trim(event)) AS kind, trim(regexp_replace(data, '^\\s*```\\w*\\s*|\\s*```\\s*$', '', 'g')) AS t FROM run_events WHERE data IS NOT NULL AND lower(trim(event)) IN ('planner', 'judge', 'news_verify', 'review')),
dec AS (SELECT event_id, kind, CASE WHEN starts_with(t, '"') AND json_valid(t) THEN json_extract_string(t, '$') ELSE t END AS t FROM raw),
ok AS (SELECT event_id, kind, CAST(t AS JSON) AS j FROM dec WHERE json_valid(t)),
body AS (SELECT event_id, kind, coalesce(j -> '$.update.decision', j -> '$.update.reply', j -> '$.decision', j -> '$.reply', j -> '$.update', j) AS b FROM ok),
held AS ("""
    + " UNION ALL ".join(f"SELECT event_id, '{e}' AS entity, {str(scalar).lower()} AS scalar, b -> '{path}' AS x FROM body WHERE kind = '{kind}'" for e, (kind, path, scalar, _, _) in NESTED.items())
    + f"""), plain AS (SELECT event_id, entity, scalar, {_decoded('x')} AS x FROM held),
lists AS (SELECT event_id, entity, CASE WHEN scalar THEN {_members('x', True)} ELSE {_members('x', False)} END AS l FROM plain),
one AS (SELECT * FROM (SELECT event_id, entity, unnest(l) AS value, generate_subscripts(l, 1) AS pos FROM lists) WHERE json_type(value) <> 'NULL'),
below AS (SELECT event_id, entity, pos, CASE entity """
    + " ".join(f"WHEN '{e}' THEN value -> '$.{child}'" for e, (_, _, _, _, child) in NESTED.items() if child)
    + f""" END AS x FROM one WHERE json_type(value) = 'OBJECT'),
belowp AS (SELECT event_id, entity, pos, {_decoded('x')} AS x FROM below),
belowl AS (SELECT event_id, entity, pos, {_members('x', True)} AS l FROM belowp),
two AS (SELECT * FROM (SELECT event_id, entity AS parent, CASE entity """
    + " ".join(f"WHEN '{e}' THEN '{c}'" for e, (_, _, _, c, _) in NESTED.items() if c)
    + """ END AS entity, pos, unnest(l) AS value, generate_subscripts(l, 1) AS child_pos FROM belowl) WHERE json_type(value) <> 'NULL'),
items AS (SELECT event_id, entity, pos AS parent_pos, 0 AS child_pos, value, CAST(event_id AS VARCHAR) AS parent_id, concat_ws('/', event_id, entity, pos) AS item_id FROM one
          UNION ALL SELECT event_id, entity, pos, child_pos, value, concat_ws('/', event_id, parent, pos), concat_ws('/', event_id, parent, pos, child_pos) FROM two),
scalars AS (SELECT event_id, 'verdict' AS entity, CASE WHEN json_type(b -> '$.verdict') = 'OBJECT' THEN b ->> '$.verdict.text' ELSE b ->> '$.verdict' END AS t FROM body WHERE kind IN ('judge', 'review')
            UNION ALL SELECT event_id, 'converged', CASE WHEN json_type(b -> '$.converged') = 'OBJECT' THEN b ->> '$.converged.text' ELSE b ->> '$.converged' END FROM body WHERE kind = 'judge')"""
)


def _flat_sql(entity: str) -> str:
    cols = ", ".join(f"value ->> '$.{f}' AS {f}" for f in FIELDS[entity]) or "value ->> '$' AS item"
    return f"{TREES} SELECT DISTINCT event_id, parent_id, item_id, CAST(parent_pos AS INT) AS parent_pos, CAST(child_pos AS INT) AS child_pos, {cols} FROM items WHERE entity = '{entity}'"


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"""{TREES} SELECT DISTINCT event_id, entity, CAST(parent_pos AS INT) AS parent_pos, CAST(child_pos AS INT) AS child_pos FROM items
UNION ALL SELECT DISTINCT event_id, entity, 0, 0 FROM scalars WHERE (entity = 'verdict' AND NOT regexp_full_match(t, '[\\s\\x{{00a0}}\\x{{3000}}]*')) OR (entity = 'converged' AND (lower(trim(t)) IN ('true', 'yes', 'y', '1', 't', 'on') OR abs(TRY_CAST(t AS DOUBLE)) > 0))""",
        **{f"p3_{e}": _flat_sql(e) for e in FIELDS},
    }
