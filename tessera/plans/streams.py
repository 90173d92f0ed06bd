"""Queries whose rows come out of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.session import table
from tessera.streaming import log as L


def _stream(s: SparkSession, d: str, name: str) -> DataFrame:
    return L.source(s, f"{d}/{name}.parquet")


def stream_deduplicated(s: SparkSession, d: str) -> DataFrame:
    return L.drain(L.deduplicated(_stream(s, d, "turns"), delay=None))


def stream_hourly(s: SparkSession, d: str) -> DataFrame:
    """The last count of every window, from the update stream."""
    return L.drain_updates(L.hourly(_stream(s, d, "events"), delay=None), ["start", "event_type"], "n")


def stream_run_state(s: SparkSession, d: str) -> DataFrame:
    return L.drain_updates(L.run_state(_stream(s, d, "run_events")), ["run_id"], "events")


def stream_enriched(s: SparkSession, d: str) -> DataFrame:
    got = L.drain(L.enriched(_stream(s, d, "run_events"), table(s, d, "runs")))
    return got.distinct().groupBy("model", F.lower(F.trim("event")).alias("event")).agg(F.count("*").alias("n"))


def queries() -> dict:
    fs = [stream_deduplicated, stream_hourly, stream_run_state, stream_enriched]
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    return {
        "stream_deduplicated": "SELECT DISTINCT run_id, seq, md5(coalesce(text, '')) AS digest FROM turns WHERE run_id IS NOT NULL AND ingested_at IS NOT NULL",
        "stream_hourly": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
        "stream_run_state": """WITH e AS (SELECT DISTINCT event_id, run_id, seq, lower(trim(event)) AS event FROM run_events WHERE run_id IS NOT NULL)
SELECT run_id, count(*) AS events, CAST(max({'s': seq, 'e': event}).s AS INT) AS last_seq, max({'s': seq, 'e': event}).e AS last_event, count(*) FILTER (event IN ('judge', 'review')) AS verdicts FROM e GROUP BY run_id""",
        "stream_enriched": "SELECT m.model, lower(trim(event)) AS event, count(*) AS n FROM (SELECT DISTINCT event_id, run_id, event FROM run_events) e LEFT JOIN (SELECT id, max(model) AS model FROM runs GROUP BY id) m ON m.id = e.run_id GROUP BY 1, 2",
    }
