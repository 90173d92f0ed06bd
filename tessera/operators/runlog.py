"""The run and event log: folds, latest-per-group, key-value and table maintenance, replay, gaps.

Writes are expressed as new table states (union, anti-join), which a caller writes as a whole; nothing is
updated in place. Defined results: null keys never match; repeated rows are kept once where a fold or a merge
is asked for; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Seconds shown before each event of a replay.
DELAYS = {"start": 0.0, "profiler": 1.2, "planner": 1.2, "research": 1.0, "coverage": 0.5, "bull": 1.6, "bear": 1.6, "judge": 1.4, "route": 0.6, "news_verify": 1.0, "review": 1.4, "done": 0.4, "error": 0.0}
DELAY_ELSE = 0.8


def once(df: DataFrame, *keys: str) -> DataFrame:
    """Each key once: of several rows the least by all columns, so the choice doesn't depend on order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def latest_per(df: DataFrame, key: str, by: str) -> DataFrame:
    """The rows with the greatest ``by`` of each ``key``; ties all stay. An aggregate and a join, no window over a hot key."""
    top = df.filter(F.col(by).isNotNull()).groupBy(key).agg(F.max(by).alias("_top"))
    return df.join(top, key).filter(F.col(by) == F.col("_top")).drop("_top")


def summarise(events: DataFrame) -> DataFrame:
    """One row per run: counts by kind, last round, convergence, tokens and price fields of its events."""
    e = once(events.select("event_id", "run_id", "event", "data", "seq"), "event_id")
    kind = F.lower(F.trim("event"))
    number = lambda field: F.get_json_object("data", f"$.{field}").try_cast("bigint")
    return e.filter("run_id is not null").groupBy("run_id").agg(
        F.count("*").alias("events"), F.count_if(kind == "bull").alias("bulls"), F.count_if(kind == "judge").alias("judges"), F.max(F.when(kind == "route", number("round"))).alias("rounds"),
        F.max(F.when(kind == "done", number("usage.input"))).alias("input_tokens"), F.max(F.when(kind == "done", number("usage.output"))).alias("output_tokens"),
        F.max(F.when(kind == "start", F.get_json_object("data", "$.model"))).alias("model"), F.max((kind == "error").cast("int")).alias("failed"),
    )


def upsert(store: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The store with the changes put in: changed keys replaced, new ones added."""
    return store.join(changes.select(key), key, "left_anti").unionByName(changes)


def delete_prefix(store: DataFrame, key: str, prefix: str) -> DataFrame:
    return store.filter(~F.coalesce(F.col(key).startswith(prefix), F.lit(False)))


def import_new(store: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The incoming rows whose keys the store lacks (null keys compare as equal), each once."""
    cond = [incoming[k].eqNullSafe(store[k]) for k in keys]
    return incoming.join(store, cond, "left_anti").distinct()


def replay(events: DataFrame, speed: float = 1.0) -> DataFrame:
    """When each event of a run is shown: cumulative delay divided by speed (0 waits for nothing)."""
    e = once(events.select("event_id", "run_id", "seq", "event"), "event_id").filter("run_id is not null")
    wait = F.coalesce(*[F.when(F.lower(F.trim("event")) == k, F.lit(v)) for k, v in DELAYS.items()], F.lit(DELAY_ELSE))
    w = Window.partitionBy("run_id").orderBy("seq", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    shown = F.sum(wait).over(w) / F.lit(speed) if speed else F.lit(0.0)
    n = F.row_number().over(Window.partitionBy("run_id").orderBy("seq", "event_id"))
    return e.select("run_id", "event_id", F.format_string("%02d-%s", n, F.lower(F.trim("event"))).alias("turn_id"), F.round(shown, 4).alias("show_at"))


def silences(events: DataFrame, key: str, at: str, seconds: float) -> DataFrame:
    """Rows that come after a silence longer than ``seconds`` within their key."""
    w = Window.partitionBy(key).orderBy(at, "event_id")
    t = F.unix_micros(F.col(at).cast("timestamp")) / F.lit(1e6)
    return events.filter(F.col(at).isNotNull()).withColumn("silence_s", F.round(t - F.lag(t).over(w), 3)).filter(F.col("silence_s") > seconds)


def route_decision(tokens: Column, budget: Column, converged: Column, round_: Column, most: Column) -> Column:
    """Budget before convergence before the round limit."""
    return F.when(tokens >= budget, "budget").when(converged, "converged").when(round_ >= most, "max rounds").otherwise("continue")


def sse(event: Column, seq: Column, data: Column) -> Column:
    """The wire block of an event."""
    return F.concat(F.lit("id: "), seq.cast("string"), F.lit("\nevent: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))
