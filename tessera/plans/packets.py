"""Queries over evidence packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import periods as P
from tessera.functions.text import STOP
from tessera.operators import claims as C, nested, packets as K
from tessera.session import table

from .corpus import TREES
from .governance import LINES
from .texts import ONE_TEXT, sql_split


def _packets(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "runs").filter("evidence is not null").select(F.col("id").alias("run_id"), "evidence").distinct()


def ticker_shapes(s: SparkSession, d: str) -> DataFrame:
    t = F.upper(F.trim("ticker"))
    return table(s, d, "runs").select("id", t.alias("ticker")).distinct().groupBy(F.coalesce(F.col("ticker").rlike(K.TICKER), F.lit(False)).alias("valid")).agg(F.count("*").alias("n"))


def document_scales(s: SparkSession, d: str) -> DataFrame:
    return K.document_scale(_packets(s, d), "run_id", "evidence")


def best_facts(s: SparkSession, d: str) -> DataFrame:
    return K.best_facts(C.evidence_lines(table(s, d, "runs")))


def proportional_caps(s: SparkSession, d: str) -> DataFrame:
    lines = C.evidence_lines(table(s, d, "runs")).select("run_id", "ord", "line")
    return K.proportional_cap(lines, "run_id", "line", 200).select("run_id", "ord", "keep")


def figure_excerpts(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "sections").filter("text is not null").groupBy("section_id").agg(F.min("text").alias("text"))
    return K.excerpt(x, "section_id", "text", 600)


def question_tags(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "run_events")
    q = nested.event_tables(e).flat("plan_question", ["id", "question"]).join(e.select("event_id", "run_id").distinct(), "event_id").select("run_id", F.col("id").alias("question"), F.col("question").alias("text"))
    return K.tagged_lines(C.evidence_lines(table(s, d, "runs")), q.dropDuplicates(["run_id", "question"]))


def archetypes(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "sections").filter("text is not null").select("section_id", K.archetype(F.col("text")).alias("archetype")).distinct()
    return x.groupBy("archetype").agg(F.count("*").alias("n"))


def headline_matches(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "sections").filter("risk_title is not null and text is not null").select("section_id", F.round(K.headline_share(F.col("risk_title"), F.col("text")), 4).alias("share")).distinct()
    return x.groupBy((F.col("share") >= 0.5).alias("matches")).agg(F.count("*").alias("n"))


def stale_sections(s: SparkSession, d: str) -> DataFrame:
    """Sections filed more than seven months before the run that read them began."""
    r = table(s, d, "runs").filter("started_at is not null").groupBy(F.col("id").alias("run_id")).agg(F.min("started_at").alias("started_at"))
    x = table(s, d, "sections").filter("filing_date is not null").select("section_id", "run_id", "filing_date").distinct().join(r, "run_id")
    return x.filter(P.month_distance(F.to_date("started_at"), F.col("filing_date")) > 7).select("section_id", "run_id")


def salvaged_records(s: SparkSession, d: str) -> DataFrame:
    """Members saved from judge and review records that break off."""
    t = nested.event_tables(table(s, d, "run_events"))
    return K.salvaged(t.unreadable(("judge", "review")).distinct(), "rec", "json")


def residual_shares(s: SparkSession, d: str) -> DataFrame:
    """What is left of a hundred percent after the share of the largest return flag of a line status."""
    g = table(s, d, "lineitem").groupBy("l_linestatus", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    t = g.groupBy("l_linestatus").agg(F.sum("q").alias("total"), F.max("q").alias("top"))
    return t.select("l_linestatus", F.round(100 - 100 * F.col("top") / F.col("total"), 4).alias("residual_pct"))


def deduped_claims(s: SparkSession, d: str) -> DataFrame:
    c = nested.event_tables(table(s, d, "run_events")).flat("judge_claim", [])
    return K.deduped(c.select("event_id", F.col("parent_pos").alias("pos"), "item"), "event_id", "pos", "item", 0.8)


def like_titles(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "runs").filter("ticker is not null").groupBy(F.col("id").alias("run_id")).agg(F.min(F.upper(F.trim("ticker"))).alias("ticker"))
    x = table(s, d, "sections").filter("risk_title is not null").select("run_id", "risk_title").distinct().join(r, "run_id")
    return K.like_titles(x, "ticker", "risk_title", 0.8)


def claim_periods(s: SparkSession, d: str) -> DataFrame:
    got = K.claim_periods(C.sentences_of(table(s, d, "turns")), ["turn_id", "pos"], "sentence")
    return got.groupBy("period").agg(F.count("*").alias("n"))


def queries() -> dict:
    fs = [ticker_shapes, document_scales, best_facts, proportional_caps, figure_excerpts, question_tags, archetypes, headline_matches, stale_sections, salvaged_records, residual_shares, deduped_claims, like_titles, claim_periods]
    return {f.__name__: f for f in fs}


STOPS = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
WORDS = f"list_filter(list_distinct(regexp_extract_all(lower(risk_title), '([a-z0-9]{{2,}})', 1)), lambda w: NOT list_contains({STOPS}, w))"
HITS = [f"{{'n': len(regexp_extract_all(lower(text), '{p}')), 'kind': '{k}'}}" for k, p in K.ARCHETYPES.items()]


def oracle_sql() -> dict[str, str]:
    top = f"list_max([{', '.join(HITS)}])"
    return {
        "figure_excerpts": f"""WITH {sql_split(ONE_TEXT)}, f AS (SELECT *, regexp_matches(sentence, '(?i)[$]\\s?[0-9]|[0-9]+(?:\\.[0-9]+)?\\s?%|[0-9]+(?:\\.[0-9]+)?x\\b') AS figure FROM sent),
u AS (SELECT *, sum(length(sentence)) OVER (PARTITION BY section_id ORDER BY figure DESC, pos) AS used FROM f) SELECT section_id, CAST(pos AS INT) AS pos, figure FROM u WHERE used <= CASE WHEN figure THEN 900 ELSE 600 END""",
        "headline_matches": f"""WITH {sql_split("SELECT DISTINCT section_id, text FROM sections WHERE text IS NOT NULL AND risk_title IS NOT NULL")}, lead AS (SELECT section_id, array_to_string(s[1:2], ' ') AS lead FROM parts),
w AS (SELECT DISTINCT section_id, {WORDS} AS t, list_filter(list_distinct(regexp_extract_all(lower(lead), '([a-z0-9]{{2,}})', 1)), lambda w: NOT list_contains({STOPS}, w)) AS l FROM (SELECT DISTINCT section_id, risk_title FROM sections WHERE text IS NOT NULL AND risk_title IS NOT NULL) JOIN lead USING (section_id))
SELECT matches, count(*) AS n FROM (SELECT DISTINCT section_id, round(CASE WHEN len(t) > 0 THEN CAST(len(list_intersect(t, l)) AS DOUBLE) / len(t) END, 4) AS share, round(CASE WHEN len(t) > 0 THEN CAST(len(list_intersect(t, l)) AS DOUBLE) / len(t) END, 4) >= 0.5 AS matches FROM w) GROUP BY matches""",
        "question_tags": f"""{TREES}, {LINES},
q AS (SELECT run_id, question, min(text) AS text FROM (SELECT run_id, value ->> '$.id' AS question, value ->> '$.question' AS text FROM items JOIN (SELECT DISTINCT event_id, run_id FROM run_events) USING (event_id) WHERE entity = 'plan_question') GROUP BY run_id, question),
a AS (SELECT DISTINCT run_id, ord, unnest({WORDS.replace('risk_title', 'label')}) AS word FROM lines), b AS (SELECT run_id, question, unnest({WORDS.replace('risk_title', 'text')}) AS word FROM q)
SELECT run_id, CAST(ord AS INT) AS ord, question, count(*) AS shared FROM a JOIN b USING (run_id, word) GROUP BY run_id, ord, question HAVING count(*) >= 2 OR max(length(word)) >= 7""",
        "ticker_shapes": "SELECT coalesce(regexp_full_match(ticker, '[A-Z]{1,5}(\\.[A-Z])?'), false) AS valid, count(*) AS n FROM (SELECT DISTINCT id, upper(trim(ticker)) AS ticker FROM runs) GROUP BY 1",
        "document_scales": r"""WITH p AS (SELECT DISTINCT id AS run_id, evidence FROM runs WHERE evidence IS NOT NULL), s AS (SELECT run_id, evidence, list_distinct(list_filter(list_transform(list_filter(string_split(evidence, chr(10)), lambda x: regexp_matches(x, '^(\[|--)')), lambda x: lower(regexp_extract(x, '(?i)\b(thousand|million|billion)s?\b', 1))), lambda x: x <> '')) AS l FROM p)
SELECT run_id, CASE WHEN len(l) = 1 THEN l[1] END AS scale FROM s""",
        "best_facts": f"WITH {LINES} SELECT run_id, label, CAST(x.o AS INT) AS ord, x.v AS value, copies FROM (SELECT run_id, label, min({{'r': CASE WHEN source_tag IS NULL THEN 1 ELSE 0 END, 'o': ord, 'v': value}}) AS x, count(*) AS copies FROM lines GROUP BY run_id, label)",
        "proportional_caps": f"WITH {LINES}, t AS (SELECT run_id, sum(length(line)) AS total FROM lines GROUP BY run_id) SELECT l.run_id, CAST(ord AS INT) AS ord, CAST(CASE WHEN total <= 200 THEN length(line) ELSE floor(length(line) * 200 / total) END AS INT) AS keep FROM lines l JOIN t ON t.run_id = l.run_id",
        "archetypes": f"SELECT CASE WHEN x.n > 0 THEN x.kind END AS archetype, count(*) AS n FROM (SELECT DISTINCT section_id, {top} AS x FROM sections WHERE text IS NOT NULL) GROUP BY 1",
        "stale_sections": """WITH r AS (SELECT id AS run_id, min(started_at) AS s FROM runs WHERE started_at IS NOT NULL GROUP BY id) SELECT section_id, x.run_id FROM (SELECT DISTINCT section_id, run_id, filing_date FROM sections WHERE filing_date IS NOT NULL) x JOIN r ON r.run_id = x.run_id
WHERE (year(s) - year(filing_date)) * 12 + month(s) - month(filing_date) > 7""",
        "like_titles": f"""WITH r AS (SELECT id AS run_id, min(upper(trim(ticker))) AS ticker FROM runs WHERE ticker IS NOT NULL GROUP BY id), x AS (SELECT DISTINCT ticker, risk_title, {WORDS} AS w FROM sections JOIN r USING (run_id) WHERE risk_title IS NOT NULL)
SELECT a.ticker AS key, a.risk_title AS title, b.risk_title AS other, round(CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / len(a.w), 6) AS share FROM x a JOIN x b ON a.ticker = b.ticker AND (len(a.w) < len(b.w) OR (len(a.w) = len(b.w) AND a.risk_title < b.risk_title))
WHERE len(a.w) > 0 AND CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / len(a.w) >= 0.8""",
        "residual_shares": "WITH g AS (SELECT l_linestatus, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT l_linestatus, round(100 - 100 * max(q) / sum(q), 4) AS residual_pct FROM g GROUP BY 1",
    }
