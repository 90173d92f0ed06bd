"""Queries that trace claims to evidence and check them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import numbers as N, periods as P
from tessera.operators import claims as C, governor as G
from tessera.session import table

# The SQL states the forms of claims and anchors in its own words: RE2 has no look-behind, so what precedes a mention is matched with it.
SQL_LEAD = r"(?:price[ -]to[ -](?:free[ -]cash[ -]flow|earnings|book|sales)|EV/EBITDA|EV/EBIT|EV/Sales|EV/Revenue|P/FCF|P/E|P/S|P/B|PEG[ -]ratio|PE[ -]ratio|PEG|PE|multiple|ratio)(?:\s*\([^)]{0,40}\))?\s*(?:stands[ -]at|around|near|was|of|at|is|=|:)?\s*(?:(?:about|roughly|approximately)\s+|~)?"
SQL_WORDS = "(?:thousand|million|billion|trillion)"
SQL_NOUN = "(?:revenue|earnings|eps|margins|margin|growth|upside|downside|shares|units|customers)"
SQL_TIMES = r"\s+times\s+(?:(?:its|the|trailing|forward|next[ -]year|next[ -]year's|this[ -]year|this[ -]year's|twelve[ -]month|TTM|GAAP|non-GAAP|adjusted)\s+)*(?:earnings|sales|revenue|book[ -]value|book|EBITDA|EBIT|free[ -]cash[ -]flow|cash[ -]flow|EPS)\b"
SQL_NUM = r"[0-9][0-9,]*(?:\.[0-9]+)?"
SQL_TAIL = rf"(?:\s*(?:-|–|\bto\b)\s*[0-9]+(?:\.[0-9]+)?\s*%|\s*%|\s?x\b|{SQL_TIMES}|(?:\s+{SQL_WORDS})?\s+{SQL_NOUN}\b|\s*{SQL_WORDS}\b|\s?[TBMK]\b|\s?(?:times|percent|bn)\b|\.|\w+)"
SQL_MENTION = rf"(?i)(?:^|[^A-Za-z0-9.\-/]|(?:^|[^0-9])[-/])((?:{SQL_LEAD})?(?:US)?[$€£¥,/:\-]?\s?{SQL_NUM}{SQL_TAIL}?)"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_canon(raw: str) -> str:
    """SQL of the canonical form of a claim."""
    num = f"nullif(replace(regexp_extract({raw}, '([0-9][0-9,]*(?:\\.[0-9]+)?)', 1), ',', ''), '')"
    unit = f"lower(regexp_extract({raw}, '(?i)[0-9]\\s?(trillion|billion|million|thousand|[TBMK])\\b', 1))"
    scale = f"CASE WHEN {unit} IN ('trillion','t') THEN 1e12 WHEN {unit} IN ('billion','b') THEN 1e9 WHEN {unit} IN ('million','m') THEN 1e6 WHEN {unit} IN ('thousand','k') THEN 1e3 ELSE 1.0 END"
    v = f"(TRY_CAST({num} AS DECIMAL(20,6)) * CAST({scale} AS DECIMAL(13,0)))"
    d = f"regexp_replace(regexp_replace(CAST({v} AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"
    bare = f"NOT regexp_matches({raw}, '(?i)[0-9]\\s?(?:x|trillion|billion|million|thousand|[TBMK])\\b')"
    return f"CASE WHEN {v} IS NULL THEN NULL WHEN regexp_matches({raw}, '%\\s*$') THEN {d} || '%' WHEN {v} > 0 AND {v} < 1 AND {bare} THEN {d} || ' [ambiguous fraction-or-percent]' ELSE {d} END"


RANGE = r"^\s*[+-]?[0-9.,]+\s*%?\s*(?:-|–|to)\s*[0-9.,]+\s*%\s*$"
SQL_RANGE_ENDS = "list_transform(regexp_extract_all({raw}, '([0-9][0-9,]*(?:\\.[0-9]+)?)', 1), lambda x: regexp_replace(regexp_replace(CAST(TRY_CAST(replace(x, ',', '') AS DECIMAL(20,6)) AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') || '%')"
LINES = r"""
packets AS (SELECT DISTINCT id AS run_id, evidence FROM runs WHERE evidence IS NOT NULL),
raw_lines AS (SELECT run_id, evidence, unnest(string_split(evidence, chr(10))) AS line, generate_subscripts(string_split(evidence, chr(10)), 1) AS ord FROM packets),
lines AS (SELECT run_id, ord, regexp_extract(line, '^- ([^:]*): (.*?)(?:\s+\[source: ([^\]]*)\])?$', 1) AS label,
                 regexp_extract(line, '^- ([^:]*): (.*?)(?:\s+\[source: ([^\]]*)\])?$', 2) AS value,
                 nullif(regexp_extract(line, '^- ([^:]*): (.*?)(?:\s+\[source: ([^\]]*)\])?$', 3), '') AS source_tag, line
          FROM raw_lines WHERE starts_with(line, '- '))"""
SQL_FIGURE = r"(?i)[$]?\s?[0-9][0-9,]*(?:\.[0-9]+)?\s*(?:%|x\b|trillion|billion|million|thousand|[TBMK]\b|percent\b)?"
MARKS = f"""
line_raw AS (SELECT run_id, ord, regexp_matches(line, '(?i)^\\s*-\\s+[^:"“]*(?:%|percent|margin|rate|ratio|yield|growth)[^:"“]*:') AND NOT regexp_matches(line, '^\\s*-\\s+\\[Q[0-9]') AS share, trim(unnest(regexp_extract_all(line, '{SQL_FIGURE}'))) AS raw FROM lines),
one AS (SELECT run_id, ord, share, raw, {sql_canon('raw')} AS c FROM line_raw),
marks AS (SELECT DISTINCT run_id, ord, canon FROM (
            SELECT run_id, ord, c AS canon FROM one
            UNION ALL SELECT run_id, ord, c || '%' FROM one WHERE NOT ends_with(c, '%') AND (regexp_matches(raw, '(?i)percent$')
              OR (share AND NOT contains(c, '[') AND NOT regexp_matches(raw, '(?i)[0-9]\\s?(?:trillion|billion|million|thousand|[TBMK])$')))
            UNION ALL SELECT o.run_id, o.ord, {sql_canon("(o.raw || ' ' || u.unit)")} FROM one o JOIN (SELECT run_id, ord, line, lower(regexp_extract(line, '(?i)\\(?(?:units?:\\s*|in\\s+)(thousand|million|billion)s\\b', 1)) AS unit FROM lines) u ON u.run_id = o.run_id AND u.ord = o.ord
              WHERE u.unit <> '' AND regexp_full_match(o.raw, '[$]?\\s?[0-9]{{1,3}}(?:,[0-9]{{3}})+(?:\\.[0-9]+)?')) WHERE canon IS NOT NULL)"""
CLAIMS = f"""
said AS (SELECT DISTINCT run_id, id AS turn_id, text FROM turns WHERE text IS NOT NULL),
seen AS (SELECT run_id, turn_id, unnest(regexp_extract_all(text, {quoted(SQL_MENTION)}, 1)) AS m, generate_subscripts(regexp_extract_all(text, {quoted(SQL_MENTION)}, 1), 1) AS k FROM said),
cutup AS (SELECT *, regexp_replace(m, {quoted('(?i)^' + SQL_LEAD)}, '') AS body FROM seen),
named AS (SELECT *, length(body) < length(m) AS led, regexp_extract(body, '^[^0-9]*') AS sign, regexp_extract(body, '{SQL_NUM}') AS num FROM cutup),
tailed AS (SELECT *, substr(body, length(sign) + length(num) + 1) AS tail, regexp_replace(regexp_extract(body, '(?i)(?:US)?[$]\\s?{SQL_NUM}(?:\\s*{SQL_WORDS}\\b|\\s?[TBMK]\\b)?'), '\\s+', ' ', 'g') AS money FROM named),
all_claims AS (SELECT run_id, turn_id, k, CASE WHEN money <> '' THEN money
    WHEN regexp_matches(tail, '(?i)%$|^\\s?x$') THEN regexp_replace(num || tail, '\\s+', ' ', 'g')
    WHEN regexp_matches(tail, '(?i)^\\s+times\\s') AND regexp_full_match(num, '[0-9]{{1,3}}(?:\\.[0-9]+)?') THEN num
    WHEN regexp_matches(tail, '(?i)\\s{SQL_NOUN}$') THEN CASE WHEN NOT regexp_full_match(num, '(?:19|20)[0-9][0-9]') OR regexp_matches(tail, '(?i)^\\s+{SQL_WORDS}') THEN regexp_replace(num || tail, '\\s+', ' ', 'g') END
    WHEN led AND regexp_full_match(num, '[0-9]{{1,3}}(?:\\.[0-9]+)?') AND NOT regexp_matches(tail, '^\\.[0-9]') THEN num
    WHEN regexp_full_match(num, '[0-9]{{1,4}}\\.[0-9]{{1,4}}') AND tail = '' AND NOT regexp_matches(sign, '[$€£¥,/:\\-]') THEN num END AS claim FROM tailed),
claims AS (SELECT run_id, turn_id, arg_min(claim, k) AS claim FROM all_claims WHERE claim IS NOT NULL GROUP BY run_id, turn_id, lower(claim))"""


def _lines(s: SparkSession, d: str) -> DataFrame:
    return C.tracing_lines(C.evidence_lines(table(s, d, "runs")))


def _traced(s: SparkSession, d: str) -> DataFrame:
    return C.trace(C.text_claims(table(s, d, "turns")), C.anchors(_lines(s, d)))


def numeric_claim_trace(s: SparkSession, d: str) -> DataFrame:
    return _traced(s, d)


def grounding_by_run(s: SparkSession, d: str) -> DataFrame:
    return C.grounding(_traced(s, d), "run_id")


def anchor_set_forms(s: SparkSession, d: str) -> DataFrame:
    return C.anchors(_lines(s, d))


def evidence_packet_lines(s: SparkSession, d: str) -> DataFrame:
    return C.evidence_lines(table(s, d, "runs")).select("run_id", "ord", "label", "value", "source_tag")


def figure_sources_top1(s: SparkSession, d: str) -> DataFrame:
    return C.figure_sources(C.text_claims(table(s, d, "turns")), _lines(s, d)).select("run_id", "claim", "ord", "rank")


def mislabeled_figures(s: SparkSession, d: str) -> DataFrame:
    """Each packet figure read under the label of the line above it: those whose own labels all name another period."""
    lines = _lines(s, d)
    above = lines.select("run_id", (F.col("ord") + 1).alias("ord"), F.col("label").alias("context")).distinct()
    each = lines.select("run_id", "ord", F.explode(N.claims(F.col("value"))).alias("claim")).filter(~N.is_range(F.col("claim")))
    return C.mislabeled(each.join(above, ["run_id", "ord"]).select("run_id", "claim", "context"), lines).select("run_id", "claim", "context", "claim_period", "labels")


def range_claim_trace(s: SparkSession, d: str) -> DataFrame:
    """Guidance ranges: traced only if both ends are anchors of other lines of the run."""
    lines = _lines(s, d)
    ranges = lines.select("run_id", "ord", F.explode(N.claims(F.col("value"))).alias("claim")).filter(N.is_range(F.col("claim")))
    ends = ranges.select("run_id", "ord", "claim", F.explode(N.range_ends(F.col("claim"))).alias("canon"))
    marks = C.anchors(lines).select("run_id", F.col("ord").alias("at"), "canon")
    met = ends.join(marks, ["run_id", "canon"], "left").withColumn("hit", F.coalesce((F.col("at") != F.col("ord")).cast("int"), F.lit(0)))
    return met.groupBy("run_id", "ord", "claim", "canon").agg(F.max("hit").alias("hit")).groupBy("run_id", "ord", "claim").agg(F.when(F.min("hit") == 1, "CITED").otherwise("FLAGGED").alias("status"))


CASES = ["$4.74T", "4.74 trillion", "1,234", "0.52", "52%", "16.16x", "$91.0 billion", "30-40%", "25.2%", "$1,029,633", "7 percent", "US$12.5 million"]


def normalize_number_cases(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(x,) for x in CASES], "raw string").select("raw", N.canonical(F.col("raw")).alias("canon"))


CELLS = ["(2,057)", "$1,029,633", "21.8%", "—", "$(7,604)", "n/a", "-12.5", "1,204"]


def accounting_cells(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(x,) for x in CELLS], "cell string").select("cell", N.accounting(F.col("cell")).alias("value"), N.figure_cell(F.col("cell")).alias("is_figure"))


def honest_rounding(s: SparkSession, d: str) -> DataFrame:
    """Rounded restatements of retail prices met by the price they round."""
    parts = table(s, d, "part").filter("p_retailprice is not null")
    values = parts.select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("value"))
    claims = values.select("key", F.round("value", 0).alias("claim_value"), F.lit(0).alias("digits")).unionByName(values.select("key", (F.round("value", 1) + 0.2).alias("claim_value"), F.lit(1).alias("digits")))
    return C.rounded_sources(claims, values).select("key", F.round("claim_value", 4).alias("claim_value"), "digits", F.round("source_value", 4).alias("source_value"))


def recompute_derived_pairs(s: SparkSession, d: str) -> DataFrame:
    """Growth stated for each order's customer recomputed from the two totals it names."""
    o = table(s, d, "orders")
    two = o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo")).filter("hi > lo and lo > 0")
    claims = two.select(F.col("o_custkey").alias("key"), F.round((F.col("hi") / F.col("lo") - 1) * 100, 1).alias("claim_value"), F.lit(True).alias("is_percent"), F.lit(1).alias("digits"))
    values = two.select(F.col("o_custkey").alias("key"), F.explode(F.array("hi", "lo")).alias("value"))
    return C.recompute(claims, values).select("key", "claim_value", F.round("implied", 3).alias("implied"), "ok")


def scenario_direction_check(s: SparkSession, d: str) -> DataFrame:
    """Parts as scenarios: size as a multiple of a twenty-fifth of the supply cost, against the retail price; even keys claim an upside."""
    cost = table(s, d, "lineitem").groupBy("l_partkey").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("sold"))
    p = table(s, d, "part").join(cost, F.col("p_partkey") == F.col("l_partkey"))
    side = F.when(F.col("p_partkey") % 2 == 0, "upside").otherwise("downside")
    implied = F.col("p_size") * F.col("sold") / 25
    gap = G.gap_pct(implied, F.col("p_retailprice"))
    return p.select("p_partkey", side.alias("side"), F.round(gap, 4).alias("gap_pct"), G.contradicts(side, implied, F.col("p_retailprice")).alias("contradiction"))


def advice_before_disclaimer(s: SparkSession, d: str) -> DataFrame:
    return C.advice(table(s, d, "turns"))


def absence_claims(s: SparkSession, d: str) -> DataFrame:
    """Claimed absences in runs whose packet notes a failure, here also the notes of what was unavailable."""
    return C.absences(table(s, d, "turns"), table(s, d, "runs"), [*C.FAILED, r"unavailable:"]).select("turn_id", F.col("pos").cast("int").alias("pos"), F.md5("sentence").alias("digest"))


def governed_verdicts(s: SparkSession, d: str) -> DataFrame:
    """The governor over every message of a judge or reviewer, from claims to the stamped text and its status."""
    t = table(s, d, "turns").filter(F.lower(F.trim("agent")).isin("judge", "review")).select("run_id", F.col("id").alias("turn_id"), "text")
    got = G.govern(t, table(s, d, "runs"), [*C.FAILED, r"unavailable:"])
    return got.withColumn("digest", F.md5("text")).drop("text")


# Written cases: a packet, and verdicts that cite, flag, round, mislabel, contradict, claim absences and advise.
CASE_PACKET = """[QUOTE & VALUATION]
- Price (current): $375.80  [source: market/quote]
- Market cap: $4.74T  [source: market/quote]
- P/E (trailing): 38.61  [source: market/ratios]
- EPS (TTM): $8.12  [source: market/ratios]
- Revenue growth (quarter): 85.5%  [source: filing/10-Q]
[KEY QUESTIONS]
- Asked: does 64% hold?  [source: planner]
- KPI value not found: backlog"""
CASE_VERDICTS = [
    (1, "The cap of $4.74 trillion is 38.61 times trailing earnings. This is research, not financial advice."),
    (2, "Upside of 20-50% rests on 64% growth. Investors should buy. Not investment advice. You should wait."),
    (3, "A trailing P/E near 38.6 is held. The company does not disclose its backlog."),
    (4, "Revenue growth of 85.5% for the full year is rare; at 46.28x the $8.12 EPS implies material downside. For research purposes only."),
    (5, "2026 revenue rose (anchors: $8.12 (TTM)) as listed (see the sources). Not financial advice."),
    (6, None),
]


def governor_cases(s: SparkSession, d: str) -> DataFrame:
    """The governor on written cases: what each verdict is found to be, and its stamped text."""
    v = s.createDataFrame([(7, k, t) for k, t in CASE_VERDICTS], "run_id bigint, turn_id bigint, text string")
    return G.govern(v, s.createDataFrame([(7, CASE_PACKET)], "id bigint, evidence string")).drop("run_id")


def claim_trace_cases(s: SparkSession, d: str) -> DataFrame:
    """The claims of the written cases with their status; both occur."""
    v = s.createDataFrame([(7, k, t) for k, t in CASE_VERDICTS], "run_id bigint, id bigint, text string")
    lines = C.tracing_lines(C.evidence_lines(s.createDataFrame([(7, CASE_PACKET)], "id bigint, evidence string")))
    return C.trace(C.text_claims(v), C.anchors(lines)).drop("run_id")


def stamp_flagged(s: SparkSession, d: str) -> DataFrame:
    """The texts with their flagged claims stamped: how many claims, and the digest of the text with the stamps taken out again."""
    got = C.stamped(_traced(s, d), table(s, d, "turns"))
    return got.select("turn_id", "tags", F.md5(F.replace(F.col("text"), F.lit(" [UNGROUNDED]"), F.lit(""))).alias("digest"), (F.length("text") > F.length(F.replace(F.col("text"), F.lit(" [UNGROUNDED]"), F.lit("")))).alias("stamped"))


HEADINGS = ["13 Weeks Ended July 4, 2026", "Six Months", "Nine Months Ended", "Year Ended December 31, 2025", "Growth", "TTM", "Forward P/E", "July 4, 2026", "Q2 2026", "FY2025", "Change", "O/(U)", "", "26 weeks"]


def period_classes(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(x,) for x in HEADINGS], "heading string").select("heading", P.period_class(F.col("heading")).alias("period"))


def evidence_periods(s: SparkSession, d: str) -> DataFrame:
    """Evidence lines by the period class of their label, over all packets."""
    return C.evidence_lines(table(s, d, "runs")).groupBy(P.period_class(F.col("label")).alias("period")).agg(F.count("*").alias("n_lines"), F.count_distinct("run_id").alias("n_runs"))


BANDS = ["low-thirties", "mid-to-high twenties", "high-single-digit", "33% to 34%", "33 to 34%", "between 33 and 34%", "twenties", "flat", "low single digit", "about 12%", "none"]


def worded_bands(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(x,) for x in BANDS], "text string").withColumn("band", N.worded_band(F.col("text"))).select("text", F.col("band.lo").alias("lo"), F.col("band.hi").alias("hi"))


def number_spellings(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(x,) for x in ["$9B", "4.74 trillion", "52%", "12.5 million"]], "raw string").select("raw", F.explode(N.variants(F.col("raw"))).alias("spelling"))


def corroborate_verbatim(s: SparkSession, d: str) -> DataFrame:
    """Percentages claimed by a run's debate that stand word for word in the sections the run fetched: number of sections each.

    The numbers of both sides are extracted, so the join is on (run, number), not on containment.
    """
    pct = F.lit(r"(\d+(?:\.\d+)?)\s?%")
    claimed = table(s, d, "turns").filter("text is not null").select("run_id", F.explode(F.regexp_extract_all("text", pct, F.lit(1))).alias("number")).distinct()
    held = table(s, d, "sections").filter("text is not null").select("run_id", "section_id", F.explode(F.array_distinct(F.regexp_extract_all("text", pct, F.lit(1)))).alias("number")).distinct()
    return claimed.join(held, ["run_id", "number"]).groupBy("run_id", "number").agg(F.count("*").alias("n_sections"))


def queries() -> dict:
    fs = [numeric_claim_trace, grounding_by_run, anchor_set_forms, evidence_packet_lines, figure_sources_top1, mislabeled_figures, range_claim_trace, normalize_number_cases, accounting_cells, honest_rounding,
          recompute_derived_pairs, scenario_direction_check, advice_before_disclaimer, absence_claims, governed_verdicts, governor_cases, claim_trace_cases, stamp_flagged, period_classes, evidence_periods, worded_bands, number_spellings, corroborate_verbatim]
    return {f.__name__: f for f in fs}


def _values(rows: list[str], name: str) -> str:
    return "(VALUES " + ", ".join("('" + x.replace("'", "''") + "')" for x in rows) + f") t({name})"


def sql_period(x: str, changes: bool = True) -> str:
    marks = " ".join(f"WHEN regexp_matches({x}, '{m.replace('(?![a-z])', '(?:[^a-zA-Z]|$)')}') THEN '{n}'" for n, m in (P.MARKS if changes else P.MARKS[1:]))
    date = rf"(?i)\b{P.MONTHS}\b\.?\s+\d{{1,2}},?\s+\d{{4}}|\b\d{{4}}-\d\d-\d\d\b"
    return f"CASE WHEN {x} IS NULL THEN 'unstated' {marks} WHEN regexp_matches({x}, '{date}') THEN 'period ended' ELSE 'unstated' END"


TRACED = f"""WITH {LINES}, {MARKS}, {CLAIMS},
need AS (SELECT run_id, turn_id, claim, unnest({SQL_RANGE_ENDS.format(raw='claim')}) AS canon FROM claims WHERE regexp_matches(claim, '{RANGE}')
         UNION ALL SELECT run_id, turn_id, claim, {sql_canon('claim')} FROM claims WHERE NOT regexp_matches(claim, '{RANGE}')),
known AS (SELECT DISTINCT run_id, canon FROM marks),
traced AS (SELECT n.run_id, turn_id, claim, CASE WHEN min(CASE WHEN k.canon IS NULL THEN 0 ELSE 1 END) = 1 THEN 'CITED' ELSE 'FLAGGED' END AS status
FROM need n LEFT JOIN known k ON k.run_id = n.run_id AND k.canon = n.canon GROUP BY n.run_id, turn_id, claim)"""


#: Sentences without look-behind: the break is marked first, then split at.
SQL_SENTENCES = r"""said AS (SELECT DISTINCT run_id, id AS turn_id, text FROM turns WHERE text IS NOT NULL),
sentences AS (SELECT run_id, turn_id, text, trim(x, ' ') AS sentence, row_number() OVER (PARTITION BY run_id, turn_id, text ORDER BY k) - 1 AS pos FROM (
  SELECT run_id, turn_id, text, unnest(l) AS x, generate_subscripts(l, 1) AS k FROM (SELECT *, string_split(regexp_replace(regexp_replace(text, '([.!?])\s+([A-Z0-9$(])', '\1' || chr(30) || '\2', 'g'), '([.!?])\s+([A-Z0-9$(])', '\1' || chr(30) || '\2', 'g'), chr(30)) AS l FROM said)) WHERE trim(x, ' ') <> '')"""
GOVERNED = """SELECT CAST(turn_id AS BIGINT) AS turn_id, claims, cited, flagged, mislabeled, scenario, absence, advice, disclaimed, status, text FROM (VALUES
(1, 2, 2, 0, 0, 0, 0, 0, true, 'clean', 'The cap of $4.74 trillion is 38.61 times trailing earnings. This is research, not financial advice.'),
(2, 2, 0, 2, 0, 0, 0, 1, true, 'annotated', 'Upside of 20-50% [UNGROUNDED — no evidence anchor] rests on 64% [UNGROUNDED — no evidence anchor] growth. Investors should buy. Not investment advice. You should wait.'),
(3, 1, 1, 0, 0, 0, 1, 0, false, 'annotated', 'A trailing P/E near 38.6 is held. The company does not disclose its backlog. [UNKNOWN, NOT ABSENT — the packet records a failure]' || chr(10) || chr(10) || 'This is investment research for educational purposes, not financial advice.'),
(4, 3, 2, 1, 1, 1, 0, 0, true, 'annotated', 'Revenue growth of 85.5% [MISLABELED — another period in the evidence] for the full year is rare; at 46.28x [UNGROUNDED — no evidence anchor] the $8.12 EPS implies material downside. [SCENARIO CHECK — the arithmetic says otherwise] For research purposes only.'),
(5, 1, 1, 0, 0, 0, 0, 0, true, 'clean', '2026 revenue rose as listed. Not financial advice.'),
(6, 0, 0, 0, 0, 0, 0, 0, false, 'amended', NULL)) t(turn_id, claims, cited, flagged, mislabeled, scenario, absence, advice, disclaimed, status, text)"""


def oracle_sql() -> dict[str, str]:
    return {
        "numeric_claim_trace": f"{TRACED} SELECT * FROM traced",
        "grounding_by_run": f"{TRACED} SELECT run_id, count(*) AS claims, count(*) FILTER (status = 'CITED') AS cited, round(count(*) FILTER (status = 'CITED') * 100.0 / count(*), 2) AS grounding_pct FROM traced GROUP BY run_id",
        "stamp_flagged": f"{TRACED} SELECT turn_id, CAST(count(DISTINCT claim) AS INT) AS tags, md5(max(text)) AS digest, true AS stamped FROM traced JOIN (SELECT DISTINCT id AS turn_id, text FROM turns WHERE text IS NOT NULL) USING (turn_id) WHERE status = 'FLAGGED' GROUP BY turn_id",
        "anchor_set_forms": f"WITH {LINES}, {MARKS} SELECT run_id, CAST(ord AS INT) AS ord, canon FROM marks",
        "evidence_packet_lines": f"WITH {LINES} SELECT run_id, CAST(ord AS INT) AS ord, label, value, source_tag FROM lines",
        "figure_sources_top1": f"""WITH {LINES}, {MARKS}, {CLAIMS},
need AS (SELECT run_id, claim, len(forms) AS n, unnest(forms) AS canon FROM (SELECT DISTINCT run_id, claim, CASE WHEN regexp_matches(claim, '{RANGE}') THEN {SQL_RANGE_ENDS.format(raw='claim')} ELSE [{sql_canon('claim')}] END AS forms FROM claims)),
whole AS (SELECT c.run_id, c.claim, m.ord FROM need c JOIN marks m ON m.run_id = c.run_id AND m.canon = c.canon GROUP BY c.run_id, c.claim, m.ord, c.n HAVING count(DISTINCT c.canon) = c.n)
SELECT run_id, claim, CAST(best.ord AS INT) AS ord, best.rank AS rank FROM (
SELECT w.run_id, w.claim, min({{'rank': CASE WHEN l.source_tag IS NULL THEN 1 ELSE 0 END, 'ord': l.ord}}) AS best FROM whole w JOIN lines l ON l.run_id = w.run_id AND l.ord = w.ord GROUP BY w.run_id, w.claim)""",
        "mislabeled_figures": f"""WITH {LINES},
v AS (SELECT run_id, label, {sql_period('label', False)} AS lp, trim(unnest(regexp_extract_all(value, '{SQL_FIGURE}'))) AS raw FROM lines),
marks AS (SELECT run_id, label, lp, {sql_canon('raw')} AS canon FROM v),
{CLAIMS.replace("SELECT DISTINCT run_id, id AS turn_id, text FROM turns WHERE text IS NOT NULL", "SELECT DISTINCT run_id, ord AS turn_id, value AS text FROM lines").strip()},
above AS (SELECT DISTINCT run_id, ord + 1 AS ord, label AS context FROM lines),
c AS (SELECT DISTINCT c.run_id, c.claim, a.context, {sql_period('a.context', False)} AS cp, {sql_canon('c.claim')} AS canon FROM claims c JOIN above a ON a.run_id = c.run_id AND a.ord = c.turn_id WHERE NOT regexp_matches(c.claim, '{RANGE}')),
bad(x, y) AS (VALUES ('quarter', 'ttm'), ('quarter', 'annual'), ('quarter', 'forward'), ('ttm', 'annual'), ('ttm', 'forward'), ('YTD (H1)', 'quarter'), ('YTD (H1)', 'ttm'), ('YTD (H1)', 'annual'), ('YTD (H1)', 'YTD (9M)'), ('YTD (9M)', 'quarter'), ('YTD (9M)', 'ttm'), ('YTD (9M)', 'annual')),
pairs AS (SELECT x, y FROM bad UNION SELECT y, x FROM bad)
SELECT c.run_id, c.claim, c.context, c.cp AS claim_period, count(*) AS labels FROM c JOIN marks m ON m.run_id = c.run_id AND m.canon = c.canon LEFT JOIN pairs p ON p.x = c.cp AND p.y = m.lp
WHERE c.cp NOT IN ('unstated', 'period ended') GROUP BY c.run_id, c.claim, c.context, c.cp HAVING count(p.x) = count(*)""",
        "range_claim_trace": f"""WITH {LINES}, {MARKS},
{CLAIMS.replace("SELECT DISTINCT run_id, id AS turn_id, text FROM turns WHERE text IS NOT NULL", "SELECT DISTINCT run_id, ord AS turn_id, value AS text FROM lines").strip()},
r AS (SELECT DISTINCT run_id, turn_id AS ord, claim, unnest({SQL_RANGE_ENDS.format(raw='claim')}) AS canon FROM claims WHERE regexp_matches(claim, '{RANGE}')),
h AS (SELECT r.run_id, r.ord, r.claim, r.canon, max(CASE WHEN m.ord <> r.ord THEN 1 ELSE 0 END) AS hit FROM r LEFT JOIN marks m ON m.run_id = r.run_id AND m.canon = r.canon GROUP BY r.run_id, r.ord, r.claim, r.canon)
SELECT run_id, CAST(ord AS INT) AS ord, claim, CASE WHEN min(hit) = 1 THEN 'CITED' ELSE 'FLAGGED' END AS status FROM h GROUP BY run_id, ord, claim""",
        "normalize_number_cases": f"SELECT raw, {sql_canon('raw')} AS canon FROM {_values(CASES, 'raw')}",
        "accounting_cells": f"""SELECT cell, CASE WHEN regexp_matches(b, '^\\(.*\\)$|^-') THEN -v ELSE v END AS value, regexp_full_match(cell, '[\\s$(]*-?[\\d,]+(?:\\.\\d+)?[\\s)%x]*') AS is_figure
FROM (SELECT cell, b, TRY_CAST(nullif(regexp_extract(b, '^\\(?-?(\\d+(?:\\.\\d+)?)\\)?$', 1), '') AS DOUBLE) AS v FROM (SELECT cell, regexp_replace(cell, '[$,%\\s]', '', 'g') AS b FROM {_values(CELLS, 'cell')}))""",
        "honest_rounding": """WITH v AS (SELECT p_partkey AS key, p_retailprice AS value FROM part),
c AS (SELECT key, round(value, 0) AS claim_value, 0 AS digits FROM v UNION ALL SELECT key, round(value, 1) + 0.2, 1 FROM v)
SELECT c.key, round(claim_value, 4) AS claim_value, digits, round(min(value), 4) AS source_value FROM c JOIN v ON v.key = c.key WHERE abs(value - claim_value) <= pow(10.0, -digits) / 2 + 1e-9 GROUP BY c.key, claim_value, digits""",
        "recompute_derived_pairs": """WITH t AS (SELECT o_custkey AS key, max(o_totalprice) AS hi, min(o_totalprice) AS lo FROM orders GROUP BY o_custkey HAVING max(o_totalprice) > min(o_totalprice) AND min(o_totalprice) > 0),
p AS (SELECT key, round((hi / lo - 1) * 100, 1) AS claim_value, unnest([abs(hi / lo - 1) * 100, abs(lo / hi - 1) * 100, hi - lo]) AS implied FROM t)
SELECT key, claim_value, round(arg_min(implied, abs(implied - claim_value)), 3) AS implied, min(abs(implied - claim_value)) <= 0.15 AS ok FROM p GROUP BY key, claim_value""",
        "scenario_direction_check": """SELECT p_partkey, side, round(gap, 4) AS gap_pct, (side = 'downside' AND gap > -2) OR (side = 'upside' AND gap < 2) AS contradiction FROM (
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'upside' ELSE 'downside' END AS side, (p_size * sold / 25 / p_retailprice - 1) * 100 AS gap FROM part JOIN (SELECT l_partkey, avg(l_extendedprice / l_quantity) AS sold FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)""",
        "absence_claims": f"""WITH f AS (SELECT DISTINCT id AS run_id FROM runs WHERE regexp_matches(evidence, 'EXTRACTION FAILURE|KPI value not found|could not find:|unavailable:')), {SQL_SENTENCES}
SELECT DISTINCT turn_id, CAST(pos AS INT) AS pos, md5(sentence) AS digest FROM sentences JOIN f USING (run_id)
WHERE regexp_matches(sentence, '(?i)\\b(?:does not|doesn''t|did not|do not|never) (?:disclose|provide|report|give|publish|break out|quantify)|\\b(?:not disclosed|undisclosed|no (?:such )?(?:guidance|disclosure|figure|metric|number)|is absent|absent from|provides no|offers no|gives no|has no (?:guidance|disclosure))\\b')
AND NOT contains(lower(sentence), 'not retrieved') AND NOT contains(sentence, 'UNKNOWN, NOT ABSENT')""",
        "advice_before_disclaimer": f"""WITH {SQL_SENTENCES},
d AS (SELECT *, min(CASE WHEN regexp_matches(lower(sentence), 'not financial advice|not investment advice|does not constitute investment advice|does not constitute financial advice|for research purposes only|research, not financial|educational purposes') THEN pos END) OVER (PARTITION BY turn_id, text) AS stop FROM sentences)
SELECT DISTINCT turn_id, CAST(pos AS INT) AS pos, sentence FROM d WHERE (stop IS NULL OR pos < stop) AND regexp_matches(lower(sentence), 'investors should|you should|position siz|prudent approach|recommend buying|recommend selling|buy the stock|sell the stock|add to your|trim your')""",
        "claim_trace_cases": "SELECT CAST(turn_id AS BIGINT) AS turn_id, claim, status FROM (VALUES (1, '$4.74 trillion', 'CITED'), (1, '38.61', 'CITED'), (2, '20-50%', 'FLAGGED'), (2, '64%', 'FLAGGED'), (3, '38.6', 'FLAGGED'), (4, '85.5%', 'CITED'), (4, '46.28x', 'FLAGGED'), (4, '$8.12', 'CITED'), (5, '$8.12', 'CITED')) t(turn_id, claim, status)",
        "governor_cases": GOVERNED,
        "period_classes": f"SELECT heading, {sql_period('heading')} AS period FROM {_values(HEADINGS, 'heading')}",
        "evidence_periods": f"WITH {LINES} SELECT {sql_period('label')} AS period, count(*) AS n_lines, count(DISTINCT run_id) AS n_runs FROM lines GROUP BY 1",
        "worded_bands": "SELECT text, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi FROM (VALUES ('low-thirties', 30.0, 33.0), ('mid-to-high twenties', 24.0, 29.0), ('high-single-digit', 7.0, 9.0), ('33% to 34%', 33.0, 34.0), ('33 to 34%', 33.0, 34.0), ('between 33 and 34%', 33.0, 34.0), ('twenties', 20.0, 29.0), ('flat', 0.0, 0.0), ('low single digit', 1.0, 3.0), ('about 12%', 12.0, 12.0), ('none', NULL, NULL)) t(text, lo, hi)",
        "number_spellings": """SELECT * FROM (VALUES ('$9B', '$9B'), ('$9B', '$9 billion'), ('$9B', '9 billion'), ('$9B', '9,000,000,000'), ('4.74 trillion', '4.74 trillion'), ('4.74 trillion', '$4.74T'), ('4.74 trillion', '$4.74 trillion'),
('4.74 trillion', '4,740,000,000,000'), ('52%', '52%'), ('12.5 million', '12.5 million'), ('12.5 million', '$12.5M'), ('12.5 million', '$12.5 million'), ('12.5 million', '12,500,000')) t(raw, spelling)""",
        "corroborate_verbatim": r"""WITH c AS (SELECT DISTINCT run_id, unnest(regexp_extract_all(text, '(\d+(?:\.\d+)?)\s?%', 1)) AS number FROM turns WHERE text IS NOT NULL),
h AS (SELECT DISTINCT run_id, section_id, unnest(regexp_extract_all(text, '(\d+(?:\.\d+)?)\s?%', 1)) AS number FROM sections WHERE text IS NOT NULL)
SELECT run_id, number, count(*) AS n_sections FROM c JOIN h USING (run_id, number) GROUP BY run_id, number""",
    }
