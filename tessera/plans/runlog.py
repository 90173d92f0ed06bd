"""Queries over the run and event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.operators import runlog as R
from tessera.session import table

LIST = ["id", "ticker", "started_at", "status", "model", "rounds", "claims", "cited", "flagged"]


def latest_run_per_ticker(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "runs").filter(F.lower(F.trim("status")) == "done").select("id", F.upper(F.trim("ticker")).alias("ticker"), "started_at").distinct()
    return R.latest_per(r, "ticker", "started_at").select("ticker", "id", "started_at")


def run_summary_fold(s: SparkSession, d: str) -> DataFrame:
    return R.summarise(table(s, d, "run_events"))


def run_turns_join(s: SparkSession, d: str) -> DataFrame:
    """Runs with the number and length of their messages."""
    t = R.once(table(s, d, "turns").select("id", "run_id", "seq", "text"), "id").groupBy("run_id").agg(F.count("*").alias("turns"), F.sum(F.char_length("text")).alias("chars"), F.max("seq").alias("last_seq"))
    return table(s, d, "runs").select(F.col("id").alias("run_id"), "status").distinct().join(t, "run_id")


def run_list_filter_sort(s: SparkSession, d: str) -> DataFrame:
    """The light listing: heavy text columns never leave the scan; newest first."""
    return table(s, d, "runs").select(*LIST).filter(F.upper(F.trim("ticker")).startswith("Z")).distinct().orderBy(F.desc_nulls_last("started_at"), F.desc("id"))


def run_lookup_prefix(s: SparkSession, d: str) -> DataFrame:
    """The first run whose start begins with a month, for each month."""
    r = table(s, d, "runs").filter("started_at is not null").select("id", F.date_format("started_at", "yyyy-MM").alias("month"), "started_at").distinct()
    return r.groupBy("month").agg(F.min(F.struct("started_at", "id"))["id"].alias("first_run"))


def archive_chips(s: SparkSession, d: str) -> DataFrame:
    """Runs per ticker and verdict of the review, with subtotals."""
    r = table(s, d, "runs").select("id", F.upper(F.trim("ticker")).alias("ticker"), F.coalesce("review_status", F.lit("none")).alias("review")).distinct()
    return r.rollup("ticker", "review").agg(F.count("*").alias("runs"), F.count_distinct("id").alias("ids"))


def kv_upsert(s: SparkSession, d: str) -> DataFrame:
    """A store of customer segments; those in debt are put again."""
    key = F.concat(F.lit("c/"), F.col("c_custkey").cast("string")).alias("key")
    rows = table(s, d, "customer").select(key, F.col("c_mktsegment").alias("value"), "c_acctbal")
    c = rows.drop("c_acctbal")
    changes = rows.filter("c_acctbal < 0").select("key", F.upper(F.concat("value", F.lit("*"))).alias("value")).unionByName(s.createDataFrame([("new/1", "ADDED")], "key string, value string"))
    return R.upsert(c, changes, "key")


def prefix_delete(s: SparkSession, d: str) -> DataFrame:
    return R.delete_prefix(table(s, d, "customer").select("c_custkey", "c_name"), "c_name", "Customer#00000001")


def migrate_antijoin(s: SparkSession, d: str) -> DataFrame:
    """Runs that a second store, holding those of one mode, still lacks."""
    r = table(s, d, "runs").select("id", "ticker", "started_at", "mode").distinct()
    store = r.filter("mode = 'web'")
    return R.import_new(store.select("ticker", "started_at", "mode"), r, ["ticker", "started_at", "mode"]).orderBy("started_at", "id")


def import_once(s: SparkSession, d: str) -> DataFrame:
    """Record files named by their source path, imported if no run has that source."""
    r = table(s, d, "runs")
    store = r.filter("source is not null and lower(trim(status)) = 'done'").select("source").distinct()
    return R.import_new(store, r.filter("source is not null").select("source", "id"), ["source"])


def replay_schedule(s: SparkSession, d: str) -> DataFrame:
    return R.replay(table(s, d, "run_events"), 2.0)


def turn_dedupe(s: SparkSession, d: str) -> DataFrame:
    """Messages delivered several times, told by run, seq and text: how many copies, and the first."""
    t = table(s, d, "turns").filter("run_id is not null")
    return t.groupBy("run_id", "seq", F.md5(F.coalesce("text", F.lit(""))).alias("digest")).agg(F.count_distinct("id").alias("copies"), F.min("id").alias("first_id")).filter("copies > 1")


def heartbeat_gaps(s: SparkSession, d: str) -> DataFrame:
    e = R.once(table(s, d, "run_events").select("event_id", "run_id", "at"), "event_id").filter("run_id is not null")
    return R.silences(e, "run_id", "at", 90.0).select("event_id", "run_id", "silence_s")


def event_usage_delta(s: SparkSession, d: str) -> DataFrame:
    """Change of the event value between consecutive events of a user."""
    e = table(s, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("event_id", "user_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("delta"))


def route_decisions(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "runs").distinct()
    tokens = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    got = R.route_decision(tokens, F.lit(150_000), F.coalesce(F.col("converged") == 1, F.lit(False)), F.coalesce("rounds", F.lit(0)), F.coalesce("max_rounds", F.lit(99)))
    return r.select(F.col("id").alias("run_id"), got.alias("decision")).distinct()


def event_wire_blocks(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select("event_id", F.md5(R.sse(F.col("event_type"), F.col("event_id"), F.coalesce("props", F.lit("")))).alias("block"))


def rulings_tally(s: SparkSession, d: str) -> DataFrame:
    """Answers per stronger side of the judges, for each confidence: a pivot."""
    from tessera.operators.nested import event_tables

    q = event_tables(table(s, d, "run_events")).flat("question", ["stronger_side", "confidence"])
    return q.groupBy("confidence").pivot("stronger_side", ["bull", "bear", "neither"]).agg(F.count(F.lit(1))).fillna(0)


def ledger_budget(s: SparkSession, d: str) -> DataFrame:
    """Running token use of each model by start, and whether it is beyond a budget."""
    r = table(s, d, "runs").filter("started_at is not null and input_tokens is not null").select("id", "model", "started_at", "input_tokens").distinct()
    w = Window.partitionBy("model").orderBy("started_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    return r.select("id", "model", F.sum("input_tokens").over(w).alias("used")).withColumn("over", F.col("used") > 2_000_000)


def event_sessions(s: SparkSession, d: str) -> DataFrame:
    """Sessions of users with at most ten minutes between events."""
    e = table(s, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "10 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def store_accumulate_expire(s: SparkSession, d: str) -> DataFrame:
    """A rolling store: later copies win by key, undated and expired rows go."""
    e = table(s, d, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), "ts", "value", "event_id")
    last = e.filter("ts is not null").groupBy("key").agg(F.max(F.struct("ts", "event_id", "value")).alias("x")).select("key", "x.*")
    now = last.agg(F.max("ts").alias("now"))  # one row
    return last.crossJoin(F.broadcast(now)).filter(F.col("ts") >= F.col("now") - F.expr("interval 5 days")).select("key", "ts", "value")


def queries() -> dict:
    fs = [latest_run_per_ticker, run_summary_fold, run_turns_join, run_list_filter_sort, run_lookup_prefix, archive_chips, kv_upsert, prefix_delete, migrate_antijoin, import_once, replay_schedule, turn_dedupe,
          heartbeat_gaps, event_usage_delta, route_decisions, event_wire_blocks, rulings_tally, ledger_budget, event_sessions, store_accumulate_expire]
    return {f.__name__: f for f in fs}


from .corpus import TREES  # noqa: E402

DELAY_SQL = "CASE lower(trim(event)) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.DELAYS.items()) + f" ELSE {R.DELAY_ELSE} END"
COLS = ", ".join(LIST)


def oracle_sql() -> dict[str, str]:
    return {
        "rulings_tally": f"{TREES} SELECT confidence, CAST(count(*) FILTER (side = 'bull') AS BIGINT) AS bull, CAST(count(*) FILTER (side = 'bear') AS BIGINT) AS bear, CAST(count(*) FILTER (side = 'neither') AS BIGINT) AS neither FROM (SELECT DISTINCT item_id, value ->> '$.confidence' AS confidence, value ->> '$.stronger_side' AS side FROM items WHERE entity = 'question') GROUP BY confidence",
        "latest_run_per_ticker": "WITH r AS (SELECT DISTINCT id, upper(trim(ticker)) AS ticker, started_at FROM runs WHERE lower(trim(status)) = 'done') SELECT ticker, id, started_at FROM r WHERE started_at = (SELECT max(started_at) FROM r x WHERE x.ticker = r.ticker)",
        "run_summary_fold": """WITH e AS (SELECT DISTINCT event_id, run_id, lower(trim(event)) AS kind, data FROM run_events),
j AS (SELECT run_id, kind, CASE WHEN json_valid(data) THEN data END AS data FROM e)
SELECT run_id, count(*) AS events, count(*) FILTER (kind = 'bull') AS bulls, count(*) FILTER (kind = 'judge') AS judges, max(TRY_CAST(data ->> '$.round' AS BIGINT)) FILTER (kind = 'route') AS rounds,
max(TRY_CAST(data ->> '$.usage.input' AS BIGINT)) FILTER (kind = 'done') AS input_tokens, max(TRY_CAST(data ->> '$.usage.output' AS BIGINT)) FILTER (kind = 'done') AS output_tokens,
max(data ->> '$.model') FILTER (kind = 'start') AS model, max(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) AS failed FROM j WHERE run_id IS NOT NULL GROUP BY run_id""",
        "run_turns_join": "WITH t AS (SELECT run_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, max(seq) AS last_seq FROM (SELECT DISTINCT id, run_id, seq, text FROM turns) GROUP BY run_id) SELECT r.run_id, status, turns, chars, last_seq FROM (SELECT DISTINCT id AS run_id, status FROM runs) r JOIN t ON t.run_id = r.run_id",
        "run_list_filter_sort": f"SELECT DISTINCT {COLS} FROM runs WHERE starts_with(upper(trim(ticker)), 'Z')",
        "run_lookup_prefix": "SELECT month, arg_min(id, {'a': started_at, 'b': id}) AS first_run FROM (SELECT DISTINCT id, strftime(started_at, '%Y-%m') AS month, started_at FROM runs WHERE started_at IS NOT NULL) GROUP BY month",
        "archive_chips": "SELECT ticker, review, count(*) AS runs, count(DISTINCT id) AS ids FROM (SELECT DISTINCT id, upper(trim(ticker)) AS ticker, coalesce(review_status, 'none') AS review FROM runs) GROUP BY ROLLUP (ticker, review)",
        "kv_upsert": "SELECT 'c/' || c_custkey AS key, CASE WHEN c_acctbal < 0 THEN upper(c_mktsegment || '*') ELSE c_mktsegment END AS value FROM customer UNION ALL SELECT 'new/1', 'ADDED'",
        "prefix_delete": "SELECT c_custkey, c_name FROM customer WHERE NOT starts_with(c_name, 'Customer#00000001')",
        "migrate_antijoin": "WITH r AS (SELECT DISTINCT id, ticker, started_at, mode FROM runs) SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r s WHERE s.mode = 'web' AND s.ticker IS NOT DISTINCT FROM r.ticker AND s.started_at IS NOT DISTINCT FROM r.started_at AND s.mode IS NOT DISTINCT FROM r.mode)",
        "import_once": "SELECT DISTINCT source, id FROM runs WHERE source IS NOT NULL AND source NOT IN (SELECT source FROM runs WHERE source IS NOT NULL AND lower(trim(status)) = 'done')",
        "replay_schedule": f"""WITH e AS (SELECT DISTINCT event_id, run_id, seq, event FROM run_events WHERE run_id IS NOT NULL)
SELECT run_id, event_id, printf('%02d', row_number() OVER w) || '-' || lower(trim(event)) AS turn_id, round(sum(CAST({DELAY_SQL} AS DOUBLE)) OVER (PARTITION BY run_id ORDER BY seq, event_id ROWS UNBOUNDED PRECEDING) / 2.0, 4) AS show_at
FROM e WINDOW w AS (PARTITION BY run_id ORDER BY seq, event_id)""",
        "turn_dedupe": "SELECT run_id, seq, md5(coalesce(text, '')) AS digest, count(DISTINCT id) AS copies, min(id) AS first_id FROM turns WHERE run_id IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT id) > 1",
        "heartbeat_gaps": """SELECT event_id, run_id, silence_s FROM (SELECT event_id, run_id, round((epoch_us(t) - lag(epoch_us(t)) OVER (PARTITION BY run_id ORDER BY t, event_id)) / 1e6, 3) AS silence_s
FROM (SELECT DISTINCT event_id, run_id, "at" AS t FROM run_events WHERE run_id IS NOT NULL AND "at" IS NOT NULL)) WHERE silence_s > 90""",
        "event_usage_delta": "SELECT event_id, user_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS delta FROM events",
        "route_decisions": "SELECT DISTINCT id AS run_id, CASE WHEN coalesce(input_tokens, 0) + coalesce(output_tokens, 0) >= 150000 THEN 'budget' WHEN coalesce(converged = 1, false) THEN 'converged' WHEN coalesce(rounds, 0) >= coalesce(max_rounds, 99) THEN 'max rounds' ELSE 'continue' END AS decision FROM runs",
        "event_wire_blocks": "SELECT event_id, md5('id: ' || event_id || chr(10) || 'event: ' || event_type || chr(10) || 'data: ' || coalesce(props, '') || chr(10) || chr(10)) AS block FROM events",
        "ledger_budget": "SELECT id, model, CAST(sum(input_tokens) OVER w AS BIGINT) AS used, sum(input_tokens) OVER w > 2000000 AS over FROM (SELECT DISTINCT id, model, started_at, input_tokens FROM runs WHERE started_at IS NOT NULL AND input_tokens IS NOT NULL) WINDOW w AS (PARTITION BY model ORDER BY started_at, id ROWS UNBOUNDED PRECEDING)",
        "event_sessions": """WITH a AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL),
b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, g""",
        "store_accumulate_expire": "WITH e AS (SELECT user_id || '/' || event_type AS key, ts, value, event_id FROM events WHERE ts IS NOT NULL), l AS (SELECT key, arg_max(ts, {'a': ts, 'b': event_id}) AS ts, arg_max(value, {'a': ts, 'b': event_id}) AS value FROM e GROUP BY key) SELECT key, ts, value FROM l WHERE ts >= (SELECT max(ts) FROM l) - INTERVAL 5 DAY",
    }
