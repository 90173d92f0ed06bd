"""Queries over statement tables, labels and units, on small pages of our own where no table holds HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import numbers as N, periods as P
from tessera.operators import figures as G
from tessera.session import table

PAGE = """<html><head><title>x</title></head><body><nav>Home | News</nav><h1>Harbour results</h1><p>Sales rose in the quarter.</p>
<p>Statements of income (in thousands of USD)</p>
<table><tr><td></td><td colspan="2">Three Months Ended</td><td colspan="2">Six Months Ended</td></tr>
<tr><td></td><td>July 4, 2026</td><td>July 5, 2025</td><td>July 4, 2026</td><td>July 5, 2025</td></tr>
<tr><td>Revenue:</td></tr>
<tr><td>Docks</td><td>$1,200</td><td>$1,000</td><td>$2,300</td><td>$2,000</td></tr>
<tr><td>Ferries</td><td>800</td><td>(50)</td><td>1,500</td><td>1,400</td></tr>
<tr><td>Total revenue</td><td>$2,000</td><td>$950</td><td>$3,800</td><td>$3,400</td></tr>
<tr><td>Net income</td><td>$100</td><td>60</td><td>90</td><td>70</td></tr></table>
<table><tr><td>Gross margin</td><td>41.5%</td><td>40.0%</td><td>41.0%</td><td>39.5%</td></tr></table><script>var a = 1;</script></body></html>"""


def _records(s: SparkSession, d: str) -> DataFrame:
    return G.table_records(s.createDataFrame([(1, PAGE)], "doc_id bigint, html string"), "doc_id", "html")


def statement_tables(s: SparkSession, d: str) -> DataFrame:
    """Figures with their headings: stacked headings, groups, units, a table that takes over headings."""
    return _records(s, d).select("tbl", "label", "grp", "heading", "value", N.accounting(F.col("value")).alias("amount"), "units")


def statement_periods(s: SparkSession, d: str) -> DataFrame:
    r = _records(s, d)
    return r.select("heading").distinct().select("heading", P.period_class(F.col("heading")).alias("period"), P.ended(F.col("heading")).alias("ended"))


def statement_kinds(s: SparkSession, d: str) -> DataFrame:
    return G.table_kinds(_records(s, d), "doc_id").select("tbl", F.array_join("kinds", ",").alias("kinds"))


def page_text(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(1, PAGE)], "doc_id bigint, html string").select("doc_id", F.explode(F.split(G.html_to_text("html"), "\n")).alias("line")).filter("line like '%.'")


UNITS = [("Net income per share", "", "1.25", "thousands"), ("Gross margin", "", "41.5%", "thousands"), ("Number of stores", "", "120", "thousands"), ("Revenue", "", "900", "millions"), ("Debt (in billions)", "", "9", "thousands"), ("Diluted", "Earnings per share", "1.1", "millions")]


def row_unit_cases(s: SparkSession, d: str) -> DataFrame:
    x = s.createDataFrame(UNITS, "label string, grp string, value string, units string")
    return x.select("label", G.row_units(F.col("label"), F.col("grp"), F.col("value"), F.col("units")).alias("unit"))


WANTED = ["Polished brass", "Economy", "STANDARD ANODIZED TIN", "promo steel part"]


def kpi_best_match(s: SparkSession, d: str) -> DataFrame:
    """Wanted measures against the part types as row labels."""
    rows = table(s, d, "part").select(F.col("p_type").alias("label"))
    return G.best_label(s.createDataFrame([(x,) for x in WANTED], "name string"), rows, 0.3)


def evidence_carry(s: SparkSession, d: str) -> DataFrame:
    """Evidence lines under the block heading that serves them, twelve lines at most."""
    p = table(s, d, "runs").filter("evidence is not null").select(F.col("id").alias("run_id"), "evidence").distinct()
    lines = p.select("run_id", F.posexplode(F.split("evidence", "\n")).alias("pos", "line"))
    got = G.carry_headings(lines, "run_id", "pos", F.col("line").rlike(r"^(\[|--)"), F.col("line"), 12)
    return got.groupBy("run_id").agg(F.count("*").alias("n_lines"), F.count("heading").alias("n_headed"), F.count_distinct("heading").alias("headings"))


def queries() -> dict:
    fs = [statement_tables, statement_periods, statement_kinds, page_text, row_unit_cases, kpi_best_match, evidence_carry]
    return {f.__name__: f for f in fs}


_T = "Three Months Ended July 4, 2026|Three Months Ended July 5, 2025|Six Months Ended July 4, 2026|Six Months Ended July 5, 2025".split("|")
_ROWS = [(0, "Docks", "Revenue", ["$1,200", "$1,000", "$2,300", "$2,000"], [1200, 1000, 2300, 2000]), (0, "Ferries", "Revenue", ["800", "(50)", "1,500", "1,400"], [800, -50, 1500, 1400]), (0, "Total revenue", "Revenue", ["$2,000", "$950", "$3,800", "$3,400"], [2000, 950, 3800, 3400]),
         (0, "Net income", None, ["$100", "60", "90", "70"], [100, 60, 90, 70]), (1, "Gross margin", None, ["41.5%", "40.0%", "41.0%", "39.5%"], [41.5, 40, 41, 39.5])]


def _expected() -> str:
    q = lambda x: "NULL" if x is None else f"'{x}'"
    rows = [f"({t}, '{label}', {q(g)}, '{h}', '{v}', {float(a)}, {q('thousands' if t == 0 else None)})" for t, label, g, vs, xs in _ROWS for h, v, a in zip(_T, vs, xs, strict=True)]
    return "SELECT tbl, label, grp, heading, value, CAST(amount AS DOUBLE) AS amount, units FROM (VALUES " + ", ".join(rows) + ") t(tbl, label, grp, heading, value, amount, units)"


STOPS = "['the', 'a', 'an', 'of', 'and', 'in', 'to', 'for', 'on', 'at', 'by', 'with', 'as', 'is', 'was', 'were', 'are', 'it', 'its', 'that', 'this', 'or', 'from', 'be']"


def oracle_sql() -> dict[str, str]:
    w = lambda x: f"list_filter(list_distinct(regexp_extract_all(lower({x}), '([a-z0-9]{{2,}})', 1)), lambda w: NOT list_contains({STOPS}, w))"
    names = ", ".join(f"('{x}')" for x in WANTED)
    return {
        "evidence_carry": """WITH p AS (SELECT DISTINCT id AS run_id, evidence FROM runs WHERE evidence IS NOT NULL), l AS (SELECT run_id, unnest(string_split(evidence, chr(10))) AS line, generate_subscripts(string_split(evidence, chr(10)), 1) AS pos FROM p),
g AS (SELECT *, starts_with(line, '[') OR starts_with(line, '--') AS h, count(*) FILTER (starts_with(line, '[') OR starts_with(line, '--')) OVER (PARTITION BY run_id ORDER BY pos) AS g FROM l),
c AS (SELECT *, max(CASE WHEN h THEN line END) OVER (PARTITION BY run_id, g) AS head, count(*) FILTER (NOT h) OVER (PARTITION BY run_id, g ORDER BY pos) AS n FROM g)
SELECT run_id, count(*) AS n_lines, count(CASE WHEN n <= 12 THEN head END) AS n_headed, count(DISTINCT CASE WHEN n <= 12 THEN head END) AS headings FROM c WHERE NOT h GROUP BY run_id""",
        "statement_tables": _expected(),
        "statement_periods": "SELECT * FROM (VALUES ('Three Months Ended July 4, 2026', 'quarter', DATE '2026-07-04'), ('Three Months Ended July 5, 2025', 'quarter', DATE '2025-07-05'), ('Six Months Ended July 4, 2026', 'YTD (H1)', DATE '2026-07-04'), ('Six Months Ended July 5, 2025', 'YTD (H1)', DATE '2025-07-05')) t(heading, period, ended)",
        "statement_kinds": "SELECT * FROM (VALUES (0, 'income'), (1, '')) t(tbl, kinds)",
        "page_text": "SELECT 1::BIGINT AS doc_id, 'Sales rose in the quarter.' AS line",
        "row_unit_cases": "SELECT * FROM (VALUES ('Net income per share', 'per share'), ('Gross margin', 'percent'), ('Number of stores', 'count'), ('Revenue', 'millions'), ('Debt (in billions)', 'billions'), ('Diluted', 'per share')) t(label, unit)",
        "kpi_best_match": f"""WITH n AS (SELECT name, {w('name')} AS a FROM (VALUES {names}) t(name)), l AS (SELECT label, {w('label')} AS b FROM (SELECT DISTINCT p_type AS label FROM part)),
p AS (SELECT name, label, round(CASE WHEN lower(name) = lower(label) THEN 1.0 WHEN contains(lower(label), lower(name)) OR contains(lower(name), lower(label)) THEN 0.9 ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) END, 6) AS score FROM n, l WHERE len(list_intersect(a, b)) > 0)
SELECT name, x.l AS label, -x.s AS score FROM (SELECT name, min({{'s': -score, 'l': label}}) AS x FROM p WHERE score >= 0.3 GROUP BY name)""",
    }
