"""The engine's functions under names for SQL: ``register(spark)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tessera.functions import numbers as N, periods as P
from tessera.operators.figures import parse_tables


@udtf(returnType="tbl int, row int, caption string, units string, currency string, grp string, label string, heading string, value string")
class TableFigures:
    """Every figure of a page's tables with its heading: ``SELECT t.* FROM pages, LATERAL parse_tables(html) t``."""

    def eval(self, html: str) -> Iterator[tuple]:
        for r in parse_tables(html):
            for heading, value in r["cells"]:
                yield r["tbl"], r["row"], r["caption"], r["units"], r["currency"], r["grp"], r["label"], heading, value


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_functions() -> dict[str, str]:
    """name -> CREATE FUNCTION text; plain SQL, so Catalyst inlines them."""
    marks = " ".join(f"WHEN rlike(x, {_text(m)}) THEN {_text(n)}" for n, m in P.MARKS)
    date = _text(rf"(?i)\b{P.MONTHS}\b\.?\s+\d{{1,2}},?\s+\d{{4}}|\b\d{{4}}-\d\d-\d\d\b")
    unit = f"lower(regexp_extract(x, {_text(rf'(?i)\d\s?({N.SCALE}){N.END}')}, 1))"
    scale = f"CASE WHEN {unit} IN ('trillion', 't') THEN 1000000000000 WHEN {unit} IN ('billion', 'b') THEN 1000000000 WHEN {unit} IN ('million', 'm') THEN 1000000 WHEN {unit} IN ('thousand', 'k') THEN 1000 ELSE 1 END"
    value = f"try_cast(replace(regexp_extract(x, {_text(f'({N.NUM})')}, 1), ',', '') AS DECIMAL(20,6)) * cast({scale} AS DECIMAL(13,0))"
    plain = f"regexp_replace(regexp_replace(cast({value} AS STRING), {_text(r'(\.\d*?)0+$')}, '$1'), {_text(r'\.$')}, '')"
    bare = f"NOT rlike(x, {_text(rf'(?i)\d\s?(?:x|{N.SCALE}){N.END}')})"
    lead, words, nouns, num = _text(rf"(?i)^{N.LEAD}"), N.one_of(N.SCALE_WORDS), N.one_of(N.NOUNS), N.NUM
    body = f"transform(regexp_extract_all(x, {_text(N.MENTION)}, 0), m -> named_struct('led', length(regexp_replace(m, {lead}, '')) < length(m), 'body', regexp_replace(m, {lead}, '')))"
    money = _text(rf"(?i)(?:US)?\$\s?{num}(?:\s*{words}{N.END}|\s?[{''.join(N.SCALE_LETTERS)}]{N.END})?")
    parts = (
        f"transform({body}, b -> named_struct('led', b.led, 'sign', regexp_extract(b.body, {_text(r'^\D*')}, 0), 'digits', regexp_extract(b.body, {_text(f'({num})')}, 1), "
        f"'tail', regexp_extract(b.body, {_text(rf'^\D*{num}(.*)$')}, 1), 'money', regexp_extract(b.body, {money}, 0)))"
    )
    spaced = lambda y: f"regexp_replace({y}, {_text(r'\s+')}, ' ')"
    small = f"rlike(p.digits, {_text(r'^\d{1,3}(?:\.\d+)?$')})"
    claim = (
        f"CASE WHEN p.money <> '' THEN {spaced('p.money')} WHEN rlike(p.tail, {_text(r'(?i)%$|^\s?x$')}) THEN {spaced('concat(p.digits, p.tail)')} WHEN rlike(p.tail, {_text(r'(?i)^\s+times\s')}) AND {small} THEN p.digits "
        f"WHEN rlike(p.tail, {_text(rf'(?i)\s{nouns}$')}) THEN CASE WHEN NOT rlike(p.digits, {_text(r'^(?:19|20)\d\d$')}) OR rlike(p.tail, {_text(rf'(?i)^\s+{words}')}) THEN {spaced('concat(p.digits, p.tail)')} END "
        f"WHEN (p.led AND {small} AND NOT rlike(p.tail, {_text(r'^\.\d')})) OR (rlike(p.digits, {_text(r'^\d{1,4}\.\d{1,4}$')}) AND NOT rlike(p.sign, {_text(r'[$€£¥,/:\-]')}) AND p.tail = '') THEN p.digits END"
    )
    once = f"aggregate(filter(transform({parts}, p -> {claim}), c -> c IS NOT NULL), cast(array() AS ARRAY<STRING>), (got, c) -> CASE WHEN exists(got, y -> lower(y) = lower(c)) THEN got ELSE array_append(got, c) END)"
    return {
        "period_class": f"CREATE OR REPLACE TEMPORARY FUNCTION period_class(x STRING) RETURNS STRING RETURN CASE WHEN x IS NULL THEN 'unstated' {marks} WHEN rlike(x, {date}) THEN 'period ended' ELSE 'unstated' END",
        "extract_claims": f"CREATE OR REPLACE TEMPORARY FUNCTION extract_claims(x STRING) RETURNS ARRAY<STRING> RETURN {once}",
        "normalize_number": f"CREATE OR REPLACE TEMPORARY FUNCTION normalize_number(x STRING) RETURNS STRING RETURN CASE WHEN {value} IS NULL THEN NULL WHEN rlike(x, {_text(r'%\s*$')}) THEN concat({plain}, '%') WHEN {value} > 0 AND {value} < 1 AND {bare} THEN concat({plain}, ' [ambiguous fraction-or-percent]') ELSE {plain} END",
    }


def register(spark: SparkSession) -> list[str]:
    """Register the functions; their names."""
    for ddl in sql_functions().values():
        spark.sql(ddl)
    spark.udtf.register("parse_tables", TableFigures)
    return [*sql_functions(), "parse_tables"]
