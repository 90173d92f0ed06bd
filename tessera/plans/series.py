"""Queries over dated series and statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.functions import numbers as N
from tessera.operators import series as S
from tessera.session import table


def _daily(s: SparkSession, d: str) -> DataFrame:
    """Daily order totals as one price series per status."""
    return table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("ticker"), F.to_date("o_orderdate").alias("d")).agg(F.round(F.sum("o_totalprice"), 2).alias("close"))


def _quarters(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_mktsegment").alias("segment"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("q")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))


def asof_band(s: SparkSession, d: str) -> DataFrame:
    """Close over the yearly figure in force at each day, and the lower-percentile band of the ratio."""
    daily = _daily(s, d)
    yearly = daily.groupBy("ticker", F.make_date(F.year("d") + 1, F.lit(1), F.lit(1)).alias("d")).agg(F.round(F.sum("close") / 100, 2).alias("eps"))
    ratio = S.asof_backward(daily, yearly, "ticker", "d", "eps").filter("eps > 0").withColumn("ratio", F.round(F.col("close") / F.col("eps"), 6))
    got = S.floor_percentiles(ratio, "ticker", "ratio", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return got.filter("n >= 120")


def move_around_event(s: SparkSession, d: str) -> DataFrame:
    """Close strictly before each filing's day, from the daily series of one status."""
    daily = _daily(s, d).filter("ticker = 'F'").select(F.lit("F").alias("k"), "d", "close")
    days = table(s, d, "filings").select(F.lit("F").alias("k"), F.add_months("filing_date", -336).alias("d")).filter("d is not null").distinct()
    return S.asof_backward(days, daily, "k", "d", "close", strict=True).select("d", "close")


def returns_by_day(s: SparkSession, d: str) -> DataFrame:
    return S.returns(_daily(s, d), "ticker", "d", "close", {"r21": 21, "r63": 63})


def return_ytd(s: SparkSession, d: str) -> DataFrame:
    """Last close of each year against the last close of the year before."""
    y = _daily(s, d).groupBy("ticker", F.year("d").alias("y")).agg(F.max_by("close", "d").alias("last"))
    w = Window.partitionBy("ticker").orderBy("y")
    return y.select("ticker", "y", F.round(F.try_divide(F.col("last"), F.lag("last").over(w)) - 1, 6).alias("ytd"))


def high_252_and_ever(s: SparkSession, d: str) -> DataFrame:
    return S.rolling_high(_daily(s, d), "ticker", "d", "close", 252)


def ttm_sum_four_quarters(s: SparkSession, d: str) -> DataFrame:
    return S.trailing_sum(_quarters(s, d), "segment", "q", "revenue", 4).select("segment", F.round("total", 2).alias("total"))


def yoy_pairing(s: SparkSession, d: str) -> DataFrame:
    return S.year_ago_pairs(_quarters(s, d), "segment", "q", "revenue")


def fy_growth(s: SparkSession, d: str) -> DataFrame:
    y = table(s, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("v"))
    w = Window.orderBy("y")  # one row per year
    return y.select("y", F.round((F.try_divide(F.col("v"), F.lag("v").over(w)) - 1) * 100, 4).alias("growth_pct"))


def margins_best_revenue(s: SparkSession, d: str) -> DataFrame:
    """Margin per status and month from the copy with the largest revenue, the first supplier on ties."""
    li = table(s, d, "lineitem")
    g = li.groupBy("l_returnflag", F.date_format("l_shipdate", "yyyy-MM").alias("period"), "l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("rev"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("net"))
    best = g.groupBy("l_returnflag", "period").agg(F.max(F.struct("rev", (-F.col("l_suppkey")).alias("k"), "net")).alias("x"))
    return best.select("l_returnflag", "period", F.round(F.try_divide(F.col("x.net"), F.col("x.rev")) * 100, 4).alias("margin_pct"))


def segment_sum_check(s: SparkSession, d: str) -> DataFrame:
    """Segment totals of a quarter against the stated total, one percent allowed."""
    q = _quarters(s, d)
    total = table(s, d, "orders").groupBy(F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("q")).agg(F.round(F.sum("o_totalprice"), 2).alias("stated"))
    return q.groupBy("q").agg(F.sum("revenue").alias("sum")).join(total, "q").select("q", F.when(F.abs(F.col("sum") - F.col("stated")) <= F.col("stated") * 0.01, "OK").otherwise("MISMATCH").alias("status"))


def stated_growth_check(s: SparkSession, d: str) -> DataFrame:
    """Growth as stated (rounded to a point) against the growth of the pair, 0.6 points allowed."""
    p = yoy_pairing(s, d).withColumn("implied", (F.col("revenue") / F.col("ago_value") - 1) * 100)
    return p.select("segment", "q", F.round("implied", 3).alias("implied"), (F.abs(F.round("implied", 0) - F.col("implied")) <= 0.6).alias("ok"))


def total_with_formula(s: SparkSession, d: str) -> DataFrame:
    """Total of an order's lines and the formula that lists them; null if any is null."""
    li = table(s, d, "lineitem")
    parts = F.sort_array(F.collect_list(F.struct("l_linenumber", F.format_string("%.2f", "l_extendedprice").alias("t"))))  # an order has a handful of lines
    return li.groupBy("l_orderkey").agg(F.when(F.bool_and(F.col("l_extendedprice").isNotNull()), F.round(F.sum("l_extendedprice"), 2)).alias("total"), F.array_join(F.transform(parts, lambda x: x["t"]), " + ").alias("formula"))


def scenario_grid(s: SparkSession, d: str) -> DataFrame:
    """Low, base and high earnings of each part times five multiples, and the gap to its price."""
    p = table(s, d, "part").select("p_partkey", "p_retailprice", (F.col("p_size") / 2).alias("eps"))
    cell = F.explode(F.array(*[F.struct(F.lit(c).alias("case"), F.lit(f).alias("f"), F.lit(m).alias("multiple")) for c, f in (("low", 0.8), ("base", 1.0), ("high", 1.2)) for m in (10, 15, 20, 25, 30)]))
    g = p.select("p_partkey", "p_retailprice", "eps", cell.alias("c"))
    value = F.col("eps") * F.col("c.f") * F.col("c.multiple")
    return g.select("p_partkey", F.col("c.case").alias("case"), F.col("c.multiple").alias("multiple"), F.round(value, 4).alias("value"), F.round((value / F.col("p_retailprice") - 1) * 100, 4).alias("gap_pct"))


def money_labels(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", N.big_money(F.abs("c_acctbal") * 1_000_003).alias("label"), N.percent_text(F.round(F.col("c_acctbal") / 10_000, 4), signed=True).alias("share"))


def estimate_basis(s: SparkSession, d: str) -> DataFrame:
    """Estimates kept, converted or dropped by whether they lie within a fifth to five times the trailing figure."""
    p = table(s, d, "part").withColumns({"est": F.col("p_retailprice"), "trail": F.col("p_size") * 40.0, "fx": F.lit(0.12)})
    ok = lambda x: (x / F.col("trail") >= 0.2) & (x / F.col("trail") <= 5)
    basis = F.when(ok(F.col("est")), "kept").when(ok(F.col("est") * F.col("fx")), "converted").otherwise("dropped")
    value = F.when(basis == "kept", F.col("est")).when(basis == "converted", F.col("est") * F.col("fx"))
    return p.select("p_partkey", basis.alias("basis"), F.round(value, 4).alias("value"))


def fx_latest_rates(s: SparkSession, d: str) -> DataFrame:
    """The newest rate of each pair and its inverse where only that is quoted."""
    fx = table(s, d, "fx").groupBy("report", "quote").agg(F.max_by("rate", "d").alias("rate"), F.max("d").alias("d"))
    inv = fx.select(F.col("quote").alias("report"), F.col("report").alias("quote"), (1 / F.col("rate")).alias("rate"), "d").join(fx.select("report", "quote"), ["report", "quote"], "left_anti")
    return fx.unionByName(inv).select("report", "quote", F.round("rate", 8).alias("rate"), "d")


def queries() -> dict:
    fs = [asof_band, move_around_event, returns_by_day, return_ytd, high_252_and_ever, ttm_sum_four_quarters, yoy_pairing, fy_growth, margins_best_revenue, segment_sum_check, stated_growth_check, total_with_formula,
          scenario_grid, money_labels, estimate_basis, fx_latest_rates]
    return {f.__name__: f for f in fs}


DAILY = "daily AS (SELECT o_orderstatus AS ticker, CAST(o_orderdate AS DATE) AS d, round(sum(o_totalprice), 2) AS close FROM orders GROUP BY 1, 2)"
QUARTERS = "quarters AS (SELECT c_mktsegment AS segment, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
PAIRS = f"""{QUARTERS}, pairs AS (SELECT segment, q, revenue, min({{'d': abs(date_diff('day', aq + INTERVAL 12 MONTH, q)), 'on': aq, 'v': av}}) AS x FROM (
SELECT a.segment, a.q, a.revenue, b.q AS aq, b.revenue AS av FROM quarters a JOIN quarters b ON a.segment = b.segment AND abs((year(a.q) * 12 + month(a.q) - 12) - (year(b.q) * 12 + month(b.q))) <= 1) GROUP BY segment, q, revenue)"""


def oracle_sql() -> dict[str, str]:
    return {
        "asof_band": f"""WITH {DAILY}, y AS (SELECT ticker, make_date(year(d) + 1, 1, 1) AS d, round(sum(close) / 100, 2) AS eps FROM daily GROUP BY 1, 2),
r AS (SELECT a.ticker, round(close / eps, 6) AS ratio FROM daily a ASOF JOIN y ON a.ticker = y.ticker AND a.d >= y.d WHERE eps > 0),
k AS (SELECT ticker, ratio, count(*) OVER (PARTITION BY ticker) AS n, row_number() OVER (PARTITION BY ticker ORDER BY ratio) - 1 AS i FROM r)
SELECT ticker, max(n) AS n, max(CASE WHEN i = floor(0.25 * (n - 1)) THEN ratio END) AS p25, max(CASE WHEN i = floor(0.5 * (n - 1)) THEN ratio END) AS median, max(CASE WHEN i = floor(0.75 * (n - 1)) THEN ratio END) AS p75 FROM k GROUP BY ticker HAVING max(n) >= 120""",
        "move_around_event": f"WITH {DAILY}, f AS (SELECT DISTINCT CAST(filing_date - INTERVAL 336 MONTH AS DATE) AS d FROM filings WHERE filing_date IS NOT NULL) SELECT f.d, close FROM f ASOF LEFT JOIN (SELECT d, close FROM daily WHERE ticker = 'F') p ON f.d > p.d",
        "returns_by_day": f"WITH {DAILY} SELECT ticker, d, close, round(close / nullif(lag(close, 21) OVER w, 0) - 1, 6) AS r21, round(close / nullif(lag(close, 63) OVER w, 0) - 1, 6) AS r63 FROM daily WINDOW w AS (PARTITION BY ticker ORDER BY d)",
        "return_ytd": f"WITH {DAILY}, y AS (SELECT ticker, CAST(year(d) AS INT) AS y, arg_max(close, d) AS last FROM daily GROUP BY 1, 2) SELECT ticker, y, round(last / nullif(lag(last) OVER (PARTITION BY ticker ORDER BY y), 0) - 1, 6) AS ytd FROM y",
        "high_252_and_ever": f"WITH {DAILY} SELECT ticker, d, close, max(close) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS high_n, max(close) OVER (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING) AS high_ever FROM daily",
        "ttm_sum_four_quarters": f"WITH {QUARTERS}, k AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY q DESC) AS k FROM quarters) SELECT segment, CASE WHEN count(revenue) = 4 THEN round(sum(revenue), 2) END AS total FROM k WHERE k <= 4 GROUP BY segment",
        "yoy_pairing": f"WITH {PAIRS} SELECT segment, q, revenue, x.on AS ago_on, x.v AS ago_value FROM pairs",
        "fy_growth": "WITH y AS (SELECT CAST(year(o_orderdate) AS INT) AS y, sum(o_totalprice) AS v FROM orders GROUP BY 1) SELECT y, round((v / nullif(lag(v) OVER (ORDER BY y), 0) - 1) * 100, 4) AS growth_pct FROM y",
        "margins_best_revenue": """WITH g AS (SELECT l_returnflag, strftime(l_shipdate, '%Y-%m') AS period, l_suppkey, round(sum(l_extendedprice), 2) AS rev, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net FROM lineitem GROUP BY 1, 2, 3),
b AS (SELECT l_returnflag, period, max({'r': rev, 'k': -l_suppkey, 'n': net}) AS x FROM g GROUP BY 1, 2) SELECT l_returnflag, period, round(x.n / nullif(x.r, 0) * 100, 4) AS margin_pct FROM b""",
        "segment_sum_check": f"WITH {QUARTERS}, t AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, round(sum(o_totalprice), 2) AS stated FROM orders GROUP BY 1), s AS (SELECT q, sum(revenue) AS s FROM quarters GROUP BY q) SELECT s.q, CASE WHEN abs(s - stated) <= stated * 0.01 THEN 'OK' ELSE 'MISMATCH' END AS status FROM s JOIN t ON s.q = t.q",
        "stated_growth_check": f"WITH {PAIRS} SELECT segment, q, round((revenue / x.v - 1) * 100, 3) AS implied, abs(round((revenue / x.v - 1) * 100, 0) - (revenue / x.v - 1) * 100) <= 0.6 AS ok FROM pairs",
        "total_with_formula": "SELECT l_orderkey, CASE WHEN bool_and(l_extendedprice IS NOT NULL) THEN round(sum(l_extendedprice), 2) END AS total, string_agg(printf('%.2f', l_extendedprice), ' + ' ORDER BY l_linenumber, printf('%.2f', l_extendedprice)) AS formula FROM lineitem GROUP BY l_orderkey",
        "scenario_grid": """SELECT p_partkey, c AS "case", CAST(m AS INT) AS multiple, round(p_size / 2 * f * m, 4) AS value, round((p_size / 2 * f * m / p_retailprice - 1) * 100, 4) AS gap_pct FROM part, (VALUES ('low', 0.8::DOUBLE), ('base', 1.0), ('high', 1.2)) k(c, f), (VALUES (10), (15), (20), (25), (30)) x(m)""",
        "money_labels": """SELECT c_custkey, CASE WHEN a >= 1e9 THEN '$' || printf('%.2f', a / 1e9) || 'B' WHEN a >= 1e6 THEN '$' || printf('%.2f', a / 1e6) || 'M' ELSE '$' || format('{:,}', CAST(round_even(a, 0) AS BIGINT)) END AS label,
printf('%+.2f', round(c_acctbal / 10000, 4) * 100) || '%' AS share FROM (SELECT c_custkey, c_acctbal, abs(c_acctbal) * 1000003 AS a FROM customer)""",
        "estimate_basis": """SELECT p_partkey, basis, CASE basis WHEN 'kept' THEN round(e, 4) WHEN 'converted' THEN round(e * 0.12::DOUBLE, 4) END AS value FROM (
SELECT p_partkey, p_retailprice AS e, CASE WHEN p_retailprice / (p_size * 40.0::DOUBLE) BETWEEN 0.2 AND 5 THEN 'kept' WHEN p_retailprice * 0.12::DOUBLE / (p_size * 40.0::DOUBLE) BETWEEN 0.2 AND 5 THEN 'converted' ELSE 'dropped' END AS basis FROM part)""",
        "fx_latest_rates": """WITH f AS (SELECT report, quote, arg_max(rate, d) AS rate, max(d) AS d FROM fx GROUP BY 1, 2) SELECT report, quote, round(rate, 8) AS rate, d FROM f
UNION ALL SELECT quote, report, round(1 / rate, 8), d FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.report = f.quote AND g.quote = f.report)""",
    }
