"""All queries of the core by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.operators import shapes
from colloquy.plans import dialogue, mining, models, searches, tables, texts
from colloquy.plans.registry import Query, Registry
from colloquy.session import table

R = Registry()
PARTS = [texts.R, tables.R, searches.R, models.R, mining.R, dialogue.R, R]


def _as_list(v: str) -> str:
    """SQL: the list that a JSON value stands for; a lone value is a list of one, a string may hold a list."""
    inner = f"({v} ->> '$')"
    decoded = f"json_valid({inner}) and json_type(try_cast({inner} as json)) = 'ARRAY'"
    return f"""case json_type({v}) when 'ARRAY' then {v} when 'OBJECT' then json_array({v}) when 'VARCHAR' then case when {decoded} then try_cast({inner} as json) when trim({inner}) = '' then null else json_array({v}) end
    when 'NULL' then null else case when {v} is null then null else json_array({v}) end end"""


def _elements(source: str, keys: str, v: str, pos: str) -> str:
    """SQL: (keys, pos, e) of the elements of ``v`` that are not null."""
    return f"(select {keys}, i::int as {pos}, json_extract(l, '$[' || i || ']') as e from (select {keys}, l, unnest(generate_series(0, json_array_length(l)::bigint - 1)) as i from (select {keys}, {_as_list(v)} as l from {source}) where l is not null and json_array_length(l) > 0) where json_type(json_extract(l, '$[' || i || ']')) <> 'NULL')"


_P6_CTES = f"""with raw as (select distinct raw_id, try_cast(payload as json) as j from raw_records where json_valid(payload)),
ss as (select raw_id, pos1, e from {_elements("(select raw_id, j -> '$.export.sessions' as v from raw)", "raw_id", "v", "pos1")}),
tt as (select raw_id, pos1, pos2, e from {_elements("(select raw_id, pos1, e -> '$.turns' as v from ss)", "raw_id, pos1", "v", "pos2")}),
en as (select raw_id, pos1, pos2, pos3, e from {_elements("(select raw_id, pos1, pos2, e -> '$.entities' as v from tt)", "raw_id, pos1, pos2", "v", "pos3")}),
tg as (select raw_id, pos1, pos2, pos3, e from {_elements("(select raw_id, pos1, pos2, e -> '$.tags' as v from tt)", "raw_id, pos1, pos2", "v", "pos3")}),
lg as (select session_id, generate_subscripts(turns, 1) - 1 as p, unnest(turns) as t from chat_logs), ne as (select id, generate_subscripts(entities, 1) - 1 as p, unnest(entities) as t from ner_examples), nt as (select id, generate_subscripts(tags, 1) - 1 as p, unnest(tags) as t from ner_examples)
"""

_P6_SQL = f"""{_P6_CTES}select raw_id as root_id, 'sessions' as path, pos1, -1 as pos2, -1 as pos3, coalesce(e ->> '$.specialty', '') as val from ss union select raw_id, 'turns', pos1, pos2, -1, coalesce(e ->> '$.role', '') from tt
union select raw_id, 'entities', pos1, pos2, pos3, coalesce(e ->> '$.label', '') from en union select raw_id, 'tags', pos1, pos2, pos3, coalesce(e ->> '$', '') from tg
union select session_id, 'turns', p::int, -1, -1, coalesce(t.role, '') from lg where t is not null union select id, 'entities', p::int, -1, -1, coalesce(t.label, '') from ne where t is not null union select id, 'tags', p::int, -1, -1, t from nt where t is not null"""

#: A list or object as text gives no number; what is no whole number gives null.
_WHOLE = "case when regexp_full_match({0}, '\\s*[+-]?[0-9]+\\s*') then try_cast({0} as int) end"
_P6_TYPED = {
    "sessions": "select raw_id as root_id, pos1, e ->> '$.session_id' as session_id, e ->> '$.specialty' as specialty, " + _WHOLE.format("(e ->> '$.triage_level')") + " as triage_level from ss",
    "turns": "select raw_id as root_id, pos1, pos2, e ->> '$.role' as role, e ->> '$.text' as text from tt union select session_id, p::int, -1, t.role, t.text from lg where t is not null",
    "entities": "select raw_id as root_id, pos1, pos2, pos3, e ->> '$.label' as label, e ->> '$.text' as text, " + _WHOLE.format("(e ->> '$.span.from')") + " as \"from\", " + _WHOLE.format("(e ->> '$.span.upto')") + " as upto from en union select id, p::int, -1, -1, t.label, t.text, null, null from ne where t is not null",
    "tags": "select raw_id as root_id, pos1, pos2, pos3, coalesce(e ->> '$', '') as tag from tg union select id, p::int, -1, -1, t from nt where t is not null",
}
_P6_TYPED_SQL = {kind: f"{_P6_CTES}select distinct * from ({sql})" for kind, sql in _P6_TYPED.items()}

@R.query(_P6_SQL)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return shapes.found(*(table(spark, d, t) for t in ("chat_logs", "ner_examples", "raw_records")))


@R.query()
def p6_subtypes(spark: SparkSession, d: str) -> DataFrame:
    """The typed rows of all kinds in the JSON exports."""
    return shapes.subtypes(shapes.explode_json(table(spark, d, "raw_records")))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return shapes.all_rows(*(table(spark, d, t) for t in ("chat_logs", "ner_examples", "raw_records")))


@R.query(_P6_TYPED_SQL["sessions"])
def p6_sessions(spark: SparkSession, d: str) -> DataFrame:
    return shapes.subtype(_rows(spark, d), "sessions", shape=False)


@R.query(_P6_TYPED_SQL["turns"])
def p6_turns(spark: SparkSession, d: str) -> DataFrame:
    return shapes.subtype(_rows(spark, d), "turns", shape=False)


@R.query(_P6_TYPED_SQL["entities"])
def p6_entities(spark: SparkSession, d: str) -> DataFrame:
    return shapes.subtype(_rows(spark, d), "entities", shape=False)


@R.query(_P6_TYPED_SQL["tags"])
def p6_tags(spark: SparkSession, d: str) -> DataFrame:
    return shapes.subtype(_rows(spark, d), "tags", shape=False)


@R.query()
def p6_variants(spark: SparkSession, d: str) -> DataFrame:
    """The states of all rows with their numbers."""
    return shapes.variants(_rows(spark, d))


def queries() -> dict[str, Query]:
    return {name: q for part in PARTS for name, q in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.sql.items()}
