"""Queries that read feeds, records, caches and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.session import table
from tessera.sources import readers as R

FEED = """<rss><channel><item><title>Harbour opens</title><link>https://a.example/x</link><pubDate>Tue, 03 Mar 2026 10:00:00 +0200</pubDate><description><![CDATA[<p>Two <b>berths</b> open.</p>]]></description></item>
<item><title>Rail slows</title><link>https://b.example/y</link><pubDate>Wed, 04 Mar 2026 08:30:00 GMT</pubDate><description>Late trains</description></item><item><title>No date</title><link>https://c.example/z</link><pubDate>soon</pubDate><description/></item></channel></rss>"""


def rss_feed(s: SparkSession, d: str) -> DataFrame:
    got = R.rss_items(s.createDataFrame([(FEED,)], "xml string"), "xml")
    return got.select("pos", "title", "link", F.coalesce("description", F.lit("")).alias("description"), F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"))


def corrupt_records(s: SparkSession, d: str) -> DataFrame:
    """Event payloads read as flat records: how many of each kind can't be read."""
    e = table(s, d, "run_events").filter("data is not null").select("event_id", F.lower(F.trim("event")).alias("event"), "data").distinct()
    r = R.json_records(e.filter("event in ('start', 'route', 'done')"), "data", "round bigint, decision string", "event_id", "event")
    return r.groupBy("event").agg(F.count("*").alias("n"), F.count("corrupt").alias("corrupt"), F.count("decision").alias("decided"))


def fresh_cache(s: SparkSession, d: str) -> DataFrame:
    """Events as cache rows valid for a week before the last of them."""
    e = table(s, d, "events").select("event_id", "ts")
    now = e.agg(F.max("ts").alias("now"))  # one row
    return R.fresh(e.crossJoin(F.broadcast(now)), "ts", 7 * 86400, F.col("now")).select("event_id")


def padded_keys(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("code"))
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("name"))
    return R.dimension_key(c, n, "name", "code", 10).select("c_custkey", "code")


def gathered_sources(s: SparkSession, d: str) -> DataFrame:
    r = R.Registry()
    r.add("regions", lambda x: table(x, d, "region").select(F.col("r_name").alias("line")))
    r.add("broken", lambda x: table(x, d, "no_such_table"))
    return r.gather(s, ["regions", "unknown", "broken"])


def queries() -> dict:
    fs = [rss_feed, corrupt_records, fresh_cache, padded_keys, gathered_sources]
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    return {
        "rss_feed": "SELECT * FROM (VALUES (0, 'Harbour opens', 'https://a.example/x', 'Two berths open.', '2026-03-03 08:00:00'), (1, 'Rail slows', 'https://b.example/y', 'Late trains', '2026-03-04 08:30:00'), (2, 'No date', 'https://c.example/z', '', NULL)) t(pos, title, link, description, published)",
        "corrupt_records": "WITH e AS (SELECT DISTINCT event_id, lower(trim(event)) AS event, data FROM run_events WHERE data IS NOT NULL), k AS (SELECT event, CASE WHEN json_valid(data) AND json_type(CASE WHEN json_valid(data) THEN data END) = 'OBJECT' THEN data END AS j FROM e WHERE event IN ('start', 'route', 'done')) SELECT event, count(*) AS n, count(*) - count(j) AS corrupt, count(j ->> '$.decision') AS decided FROM k GROUP BY event",
        "fresh_cache": "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY",
        "padded_keys": "SELECT c_custkey, lpad(CAST(n_nationkey AS VARCHAR), 10, '0') AS code FROM customer JOIN nation ON c_nationkey = n_nationkey",
        "gathered_sources": "SELECT 'regions' AS source, 0 AS ord, r_name AS line FROM region UNION ALL SELECT 'broken', 1, '[broken unavailable: AnalysisException]' UNION ALL SELECT 'unknown', 2, '[unknown unavailable: KeyError]'",
    }
