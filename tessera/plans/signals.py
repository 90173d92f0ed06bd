"""Queries that score, select, sample and report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions.text import split_sentences, words
from tessera.operators import nested, signals as S
from tessera.session import table

from .texts import sql_split

NOW = "2026-11-01"


def _items(s: SparkSession, d: str) -> DataFrame:
    """Sections as items of a feed, with the ticker of their run."""
    t = table(s, d, "runs").filter("ticker is not null").groupBy(F.col("id").alias("run_id")).agg(F.min(F.upper(F.trim("ticker"))).alias("ticker"))
    x = table(s, d, "sections").select("section_id", "run_id", "form", "risk_title", F.col("risk_title").alias("title"), F.col("text").alias("body"), F.col("filing_date").alias("published"))
    # scored before anything is shuffled, so that light rows meet the runs
    light = S.scored(x, F.lit(NOW).cast("date")).select("section_id", "run_id", "form", "risk_title", F.round("score", 4).alias("score"), F.least(F.length("body"), F.lit(600)).alias("chars"))
    return light.join(t, "run_id")


def news_score(s: SparkSession, d: str) -> DataFrame:
    return _items(s, d).select("section_id", "score").distinct()


def news_identity(s: SparkSession, d: str) -> DataFrame:
    """Sections that name the company of their run (as its research message does) or its ticker, and those rejected, by count."""
    c = F.regexp_extract("text", r"lines read for (.+)\.\s*$", 1)
    named = table(s, d, "turns").select("run_id", c.alias("company")).filter("company <> '' and run_id is not null").groupBy("run_id").agg(F.min("company").alias("company"))
    t = table(s, d, "runs").filter("ticker is not null").groupBy(F.col("id").alias("run_id")).agg(F.min(F.upper(F.trim("ticker"))).alias("ticker")).join(named, "run_id")
    x = table(s, d, "sections").select("section_id", "run_id", F.col("risk_title").alias("title"), F.col("text").alias("body"), F.col("filing_date").alias("published"))
    got = S.scored(x.join(t, "run_id"), F.lit(NOW).cast("date"), "company", "ticker")
    return got.select("section_id", (F.col("score") > S.REJECTED / 2).alias("named")).distinct().groupBy("named").agg(F.count("*").alias("n"))


def news_select(s: SparkSession, d: str) -> DataFrame:
    x = _items(s, d).filter("risk_title is not null")
    light = x.select(F.col("ticker").alias("key"), F.col("section_id").alias("id"), "score", F.coalesce(F.upper(F.trim("form")), F.lit("?")).alias("publisher"), "risk_title", "chars")
    one = light.groupBy("key", "risk_title").agg(F.max(F.struct("score", (-F.col("id")).alias("n"), "publisher", "chars")).alias("x"))
    ready = one.select("key", (-F.col("x.n")).alias("id"), "x.score", "x.publisher", words(F.col("risk_title")).alias("words"), F.coalesce("x.chars", F.lit(0)).alias("chars"))
    return S.select(ready, 2, 0.75, 3000, 6)


def guidance_statements(s: SparkSession, d: str) -> DataFrame:
    """Sentences that look forward and state a figure, of 20 to 500 characters, not of the excluded kinds."""
    x = table(s, d, "sections").filter("text is not null").select("section_id", "text").distinct()
    e = x.select("section_id", F.posexplode(split_sentences(F.col("text"))).alias("pos", "sentence"))
    c = F.col("sentence")
    return e.filter(c.rlike(S.FORWARD) & c.rlike(S.FIGURE) & ~c.rlike(S.EXCLUDED) & F.length(c).between(20, 500)).select("section_id", "pos")


def data_gaps(s: SparkSession, d: str) -> DataFrame:
    """Failures noted in the packets, by what and why, with the number of runs."""
    p = table(s, d, "runs").filter("evidence is not null").select("id", "evidence").distinct()
    e = p.select("id", F.explode(F.regexp_extract_all("evidence", F.lit(r"\[([a-z ]+) unavailable: ([^\]]*)\]"), F.lit(0))).alias("note"))
    return e.groupBy(F.regexp_extract("note", r"\[([a-z ]+) unavailable", 1).alias("what"), F.regexp_extract("note", r"unavailable: ([^\]]*)\]", 1).alias("why")).agg(F.count_distinct("id").alias("runs"))


def coverage_counts(s: SparkSession, d: str) -> DataFrame:
    """Questions covered by the research events, of those asked."""
    e = table(s, d, "run_events").filter(F.lower(F.trim("event")) == "research").select("event_id", "run_id", "data").distinct()
    m = F.from_json(F.get_json_object("data", "$.coverage"), "map<string,boolean>")
    x = e.select("run_id", F.explode(m).alias("q", "ok"))
    return x.groupBy("run_id").agg(F.count("*").alias("asked"), F.count_if("ok").alias("covered"))


def coverage_gate(s: SparkSession, d: str) -> DataFrame:
    c = coverage_counts(s, d)
    return c.groupBy(F.when(F.col("covered") < 2, "withheld").when(F.col("covered") == 2, "cap low").otherwise("open").alias("gate")).agg(F.count("*").alias("runs"))


def analyst_actions_window(s: SparkSession, d: str) -> DataFrame:
    """Actions of each user in the 90 days before the last event, and the latest action at any age."""
    e = table(s, d, "events").filter("ts is not null")
    now = e.agg(F.max("ts").alias("now"))  # one row
    x = e.crossJoin(F.broadcast(now)).withColumn("inside", F.col("ts") >= F.col("now") - F.expr("interval 90 days"))
    return x.groupBy("user_id").agg(F.count_if(F.col("inside") & (F.col("value") >= 50)).alias("ups"), F.count_if(F.col("inside") & (F.col("value") < 50)).alias("downs"), F.max(F.struct("ts", "event_id", "event_type"))["event_type"].alias("latest"))


def weighted_rating(s: SparkSession, d: str) -> DataFrame:
    """Mean rating of each event type from counts of ratings one to five."""
    e = table(s, d, "events").withColumn("r", (F.floor(F.least(F.greatest("value", F.lit(0.0)), F.lit(99.9)) / 20) + 1).cast("int"))
    c = e.filter("r is not null").groupBy("event_type", "r").agg(F.count("*").alias("n"))
    return c.groupBy("event_type").agg(F.round(F.sum(F.col("r") * F.col("n")) / F.sum("n"), 4).alias("mean"), F.sum("n").alias("n"))


def quality_suspects(s: SparkSession, d: str) -> DataFrame:
    """Orders whose figures lie outside of plausible bounds."""
    li = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.max("l_discount").alias("disc"))
    o = table(s, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rules = {"no lines": F.col("net").isNull(), "discount": F.col("disc") >= 0.1, "total": F.abs(F.col("o_totalprice") / F.col("net") - 1) > 0.5}
    return S.issues(o, "o_orderkey", rules, {"no lines"}).groupBy(F.array_join("issues", ",").alias("issues"), "verdict").agg(F.count("*").alias("n"))


def readiness_summary(s: SparkSession, d: str) -> DataFrame:
    """How many runs have each issue."""
    r = table(s, d, "runs").distinct()
    rules = {"no evidence": F.col("evidence").isNull(), "not finished": F.col("finished_at").isNull(), "no price": F.coalesce(F.trim("price"), F.lit("")) == "", "flags": F.col("flagged") * 2 > F.col("claims"), "error": F.col("error").isNotNull()}
    return S.issues(r, "id", rules, {"no evidence", "error"}).withColumn("issue", F.explode_outer("issues")).groupBy("issue").agg(F.count_distinct("id").alias("runs"))


def growth_cross_check(s: SparkSession, d: str) -> DataFrame:
    """Growth of quarterly totals computed from two tables, agreed within half a point."""
    o = table(s, d, "orders").groupBy(F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("q")).agg(F.sum("o_totalprice").alias("a"))
    x = table(s, d, "orders").join(table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    li = x.groupBy(F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("q")).agg(F.sum("l_extendedprice").alias("b"))
    from pyspark.sql import Window

    w = Window.orderBy("q")  # one row per quarter
    g = o.join(li, "q", "left").select("q", ((F.col("a") / F.lag("a").over(w) - 1) * 100).alias("ga"), ((F.col("b") / F.lag("b").over(w) - 1) * 100).alias("gb"))
    return g.select("q", F.when(F.col("ga").isNull() | F.col("gb").isNull(), "not compared").when(F.abs(F.col("ga") - F.col("gb")) <= 0.5, "agrees").otherwise("disputed").alias("status"))


def stratified_sample(s: SparkSession, d: str) -> DataFrame:
    return S.stratified(table(s, d, "customer").filter("c_acctbal is not null"), "c_custkey", "c_acctbal", [0.3, 0.4, 0.3], 100, 7)


def grade_compare(s: SparkSession, d: str) -> DataFrame:
    """Grounding of the models against the mean of all."""
    r = table(s, d, "runs").filter("claims > 0 and model is not null").distinct()
    g = r.groupBy("model").agg(F.round(F.sum("cited") * 100.0 / F.sum("claims"), 4).alias("grounding"), F.sum("calls").alias("calls"))
    total = r.agg(F.round(F.sum("cited") * 100.0 / F.sum("claims"), 4).alias("mean"))  # one row
    return g.crossJoin(F.broadcast(total)).select("model", "grounding", "calls", F.round(F.col("grounding") - F.col("mean"), 4).alias("delta"))


def claim_rulings(s: SparkSession, d: str) -> DataFrame:
    """Claims of the judges matched one to one with the reviews of their run."""
    e = table(s, d, "run_events")
    t = nested.event_tables(e)
    run = e.filter("run_id is not null").select("event_id", F.col("run_id").alias("key")).distinct()
    # a place is (event, position): as one number it would overflow or collide
    at = F.struct("event_id", "parent_pos").alias("pos")
    left = t.flat("judge_claim", []).join(run, "event_id").select("key", at, F.col("item").alias("text"))
    right = t.flat("claim_review", ["claim"]).join(run, "event_id").select("key", at, F.col("claim").alias("text"))
    got = S.assign(left, right, 0.3)
    return got.select("key", F.col("pos.event_id").alias("event_id"), F.col("pos.parent_pos").alias("parent_pos"), F.col("match.event_id").alias("review_id"), F.col("match.parent_pos").alias("review_pos"), "score")


def set_operations(s: SparkSession, d: str) -> DataFrame:
    """Tickers of runs and filings: in both, and in one alone."""
    a = table(s, d, "runs").select(F.upper(F.trim("ticker")).alias("t")).filter("t is not null")
    b = table(s, d, "filings").select(F.upper(F.trim("ticker")).alias("t")).filter("t is not null")
    x = a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("runs"))).unionByName(b.subtract(a).withColumn("side", F.lit("filings")))
    return x.select("t", "side")


def queries() -> dict:
    fs = [news_score, news_identity, news_select, guidance_statements, data_gaps, coverage_counts, coverage_gate, analyst_actions_window, weighted_rating, quality_suspects, readiness_summary, growth_cross_check, stratified_sample, grade_compare, claim_rulings, set_operations]
    return {f.__name__: f for f in fs}


_TOK = lambda x: f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'))"
# the weights once more, by weight
WEIGHTS = {1.5: "loan financing guarantee guidance acquisition acquire acquires merger downgrade downgrades lawsuit sues investigation", 0.75: "credit revenue billion", 0.5: "dividend reuters bloomberg",
           1.0: "debt bond outlook forecast raises cuts misses beats deal contract agreement upgrade upgrades probe recall layoffs ceo resigns buyback earnings"}
MAT = "least(4.0, " + " + ".join(f"{w} * (2 * len(list_intersect(a, {t.split()})) + len(list_filter(list_intersect(b, {t.split()}), lambda z: NOT list_contains(a, z))))" for w, t in WEIGHTS.items()) + ")"
ITEMS = "t AS (SELECT id AS run_id, min(upper(trim(ticker))) AS ticker FROM runs WHERE ticker IS NOT NULL GROUP BY id), x AS (SELECT s.*, t.ticker FROM (SELECT DISTINCT section_id, run_id, risk_title, form, filing_date, text FROM sections) s JOIN t ON t.run_id = s.run_id)"
COVER = """c AS (SELECT run_id, unnest(CAST(data -> '$.coverage' AS MAP(VARCHAR, BOOLEAN)).map_values()) AS ok FROM (SELECT DISTINCT event_id, run_id, data FROM run_events WHERE lower(trim(event)) = 'research') WHERE json_valid(data))"""


def oracle_sql() -> dict[str, str]:
    return {
        "guidance_statements": f"""WITH {sql_split("SELECT DISTINCT section_id, text FROM sections WHERE text IS NOT NULL")}
SELECT section_id, CAST(pos AS INT) AS pos FROM sent WHERE length(sentence) BETWEEN 20 AND 500 AND regexp_matches(sentence, '(?i)\\b(expect\\w*|anticipat\\w*|outlook|guidance|forecast\\w*|project(s|ed|ion)\\w*|target\\w*|plans|planned|plan|intend\\w*)\\b')
AND regexp_matches(sentence, '(?i)[$]\\s?[0-9]|[0-9]\\s?%|[0-9]\\s?(billion|million|thousand|percent|basis points|bps)|[0-9]x\\b') AND NOT regexp_matches(sentence, '(?i)forward-looking|safe harbou?r|compensation|lease maturit|deferred revenue|hedg\\w+ instrument|stress test|effective tax rate')""",
        "news_score": f"WITH {ITEMS}, w AS (SELECT section_id, filing_date, {_TOK('risk_title')} AS a, {_TOK('text')} AS b FROM x) SELECT DISTINCT section_id, round({MAT} + coalesce(greatest(0.0, 1.5 * (1 - date_diff('day', filing_date, DATE '{NOW}') / 30)), 0.0), 4) AS score FROM w",
        "news_identity": r"""WITH c AS (SELECT run_id, min(k) AS company FROM (SELECT run_id, regexp_extract(text, 'lines read for (.+)\.\s*$', 1) AS k FROM turns WHERE run_id IS NOT NULL) WHERE k <> '' GROUP BY run_id),
t AS (SELECT id AS run_id, min(upper(trim(ticker))) AS ticker FROM runs WHERE ticker IS NOT NULL GROUP BY id),
x AS (SELECT section_id, lower(ticker) AS tick, list_distinct(regexp_extract_all(lower(coalesce(risk_title, '') || ' ' || coalesce(text, '')), '[a-z0-9]+')) AS w,
      list_filter(list_distinct(regexp_extract_all(lower(company), '[a-z0-9]+')), lambda z: length(z) > 2 AND NOT list_contains(['inc', 'corp', 'corporation', 'company', 'ltd', 'limited', 'plc', 'llc', 'the', 'group', 'holdings'], z)) AS n FROM sections JOIN t USING (run_id) JOIN c USING (run_id))
SELECT named, count(*) AS n FROM (SELECT DISTINCT section_id, len(n) = 0 OR len(list_intersect(n, w)) > 0 OR (list_contains(w, tick) AND length(tick) >= 3) AS named FROM x) GROUP BY named""",
        "data_gaps": r"""WITH e AS (SELECT id, unnest(regexp_extract_all(evidence, '\[[a-z ]+ unavailable: [^\]]*\]')) AS note FROM (SELECT DISTINCT id, evidence FROM runs WHERE evidence IS NOT NULL))
SELECT regexp_extract(note, '\[([a-z ]+) unavailable', 1) AS what, regexp_extract(note, 'unavailable: ([^\]]*)\]', 1) AS why, count(DISTINCT id) AS runs FROM e GROUP BY 1, 2""",
        "coverage_counts": f"WITH {COVER} SELECT run_id, count(*) AS asked, count(*) FILTER (ok) AS covered FROM c GROUP BY run_id",
        "coverage_gate": f"WITH {COVER}, g AS (SELECT run_id, count(*) FILTER (ok) AS covered FROM c GROUP BY run_id) SELECT CASE WHEN covered < 2 THEN 'withheld' WHEN covered = 2 THEN 'cap low' ELSE 'open' END AS gate, count(*) AS runs FROM g GROUP BY 1",
        "analyst_actions_window": """SELECT user_id, count(*) FILTER (ts >= m - INTERVAL 90 DAY AND value >= 50) AS ups, count(*) FILTER (ts >= m - INTERVAL 90 DAY AND value < 50) AS downs, arg_max(event_type, {'a': ts, 'b': event_id}) AS latest
FROM events, (SELECT max(ts) AS m FROM events) WHERE ts IS NOT NULL GROUP BY user_id""",
        "weighted_rating": "WITH c AS (SELECT event_type, CAST(floor(least(greatest(value, 0.0), 99.9) / 20) + 1 AS INT) AS r FROM events WHERE value IS NOT NULL) SELECT event_type, round(avg(r), 4) AS mean, count(*) AS n FROM c GROUP BY event_type",
        "quality_suspects": """WITH l AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS net, max(l_discount) AS disc FROM lineitem GROUP BY 1),
f AS (SELECT net IS NULL AS a, coalesce(disc >= 0.1, false) AS b, coalesce(abs(o_totalprice / net - 1) > 0.5, false) AS c FROM orders LEFT JOIN l ON o_orderkey = l_orderkey)
SELECT concat_ws(',', CASE WHEN a THEN 'no lines' END, CASE WHEN b THEN 'discount' END, CASE WHEN c THEN 'total' END) AS issues, CASE WHEN a THEN 'NOT READY' WHEN b OR c THEN 'PARTIAL' ELSE 'READY' END AS verdict, count(*) AS n FROM f GROUP BY 1, 2""",
        "readiness_summary": """WITH r AS (SELECT DISTINCT * FROM runs), i AS (SELECT id, list_filter([CASE WHEN evidence IS NULL THEN 'no evidence' END, CASE WHEN finished_at IS NULL THEN 'not finished' END, CASE WHEN coalesce(trim(price), '') = '' THEN 'no price' END,
CASE WHEN flagged * 2 > claims THEN 'flags' END, CASE WHEN error IS NOT NULL THEN 'error' END], lambda x: x IS NOT NULL) AS l FROM r)
SELECT issue, count(DISTINCT id) AS runs FROM (SELECT id, unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END) AS issue FROM i) GROUP BY issue""",
        "growth_cross_check": """WITH a AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, sum(o_totalprice) AS a FROM orders GROUP BY 1), b AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, sum(l_extendedprice) AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
g AS (SELECT a.q, (a / lag(a) OVER (ORDER BY a.q) - 1) * 100 AS ga, (b / lag(b) OVER (ORDER BY a.q) - 1) * 100 AS gb FROM a LEFT JOIN b ON a.q = b.q)
SELECT q, CASE WHEN ga IS NULL OR gb IS NULL THEN 'not compared' WHEN abs(ga - gb) <= 0.5 THEN 'agrees' ELSE 'disputed' END AS status FROM g""",
        "grade_compare": "WITH r AS (SELECT DISTINCT * FROM runs WHERE claims > 0 AND model IS NOT NULL), t AS (SELECT round(sum(cited) * 100.0 / sum(claims), 4) AS mean FROM r) SELECT model, round(sum(cited) * 100.0 / sum(claims), 4) AS grounding, CAST(sum(calls) AS BIGINT) AS calls, round(round(sum(cited) * 100.0 / sum(claims), 4) - any_value(mean), 4) AS delta FROM r, t GROUP BY model",
        "set_operations": "WITH a AS (SELECT upper(trim(ticker)) AS t FROM runs WHERE ticker IS NOT NULL), b AS (SELECT upper(trim(ticker)) AS t FROM filings WHERE ticker IS NOT NULL) SELECT t, 'both' AS side FROM (SELECT t FROM a INTERSECT SELECT t FROM b) UNION ALL SELECT t, 'runs' FROM (SELECT t FROM a EXCEPT SELECT t FROM b) UNION ALL SELECT t, 'filings' FROM (SELECT t FROM b EXCEPT SELECT t FROM a)",
    }
