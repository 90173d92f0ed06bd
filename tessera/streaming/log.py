"""The event log as streams: deduplication, rolling stores, sessions, replay and a fold of run state.

A stream is drained by one available-now run into a folder that all executors share, so a query over it gives
the same rows as the batch form, however the table is laid out in files and batches: nothing drained has a
watermark, so no row is too late, and state keeps each key until the run ends. A service would leave the stream
running and name a delay; late rows within it count, later ones are dropped by Spark's rules. Undated rows take
no part where event time decides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.session import shared_dir, ship


def source(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream, with the schema they have; the table is a folder of files or one file."""
    ship(spark)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 64)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read its output."""
    spark = stream.sparkSession
    at = shared_folder(spark)
    schema = stream.schema
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/out")


def drain_updates(stream: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Run an update-mode stream; of each key the row with the highest version stays."""
    spark = stream.sparkSession
    at = shared_folder(spark)
    schema = stream.schema
    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/batch={n}")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema(schema).parquet(f"{at}/out/*")
    rest = [c for c in schema.names if c not in keys]
    return got.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("x")).select(*keys, *[F.col("x")[c].alias(c) for c in rest])


def deduplicated(turns: DataFrame, delay: str | None = "30 days") -> DataFrame:
    """Messages once: redelivered rows of the same run, seq and text within the delay go, all of them if there is none."""
    t = turns.filter("ingested_at is not null and run_id is not null").withColumn("ingested", F.col("ingested_at").cast("timestamp"))
    t = t.select("run_id", "seq", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "ingested")
    keys = ["run_id", "seq", "digest"]
    once = t.select(*keys).dropDuplicates(keys) if delay is None else t.withWatermark("ingested", delay).dropDuplicatesWithinWatermark(keys)
    return once.select(*keys)


def hourly(events: DataFrame, delay: str | None = "10 minutes") -> DataFrame:
    """Counts of one-hour windows of event time and kind; without a delay no event is too late."""
    e = events.filter("ts is not null").withColumn("t", F.col("ts").cast("timestamp"))
    e = e if delay is None else e.withWatermark("t", delay)
    return e.groupBy(F.window("t", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_state(events: DataFrame) -> DataFrame:
    """State of each run over its events, each taken once: how many, the last by seq, and the verdicts so far; a streaming aggregate."""
    kind = F.lower(F.trim(F.coalesce("event", F.lit(""))))
    e = events.filter("run_id is not null").select("run_id", "event_id", F.coalesce("seq", F.lit(-1)).alias("seq"), kind.alias("event")).dropDuplicates(["event_id"])
    last = F.max(F.struct("seq", "event"))
    state = e.groupBy("run_id").agg(F.count("*").alias("events"), last.alias("last"), F.count_if(F.col("event").isin("judge", "review")).alias("verdicts"))
    return state.select("run_id", "events", F.col("last.seq").alias("last_seq"), F.col("last.event").alias("last_event"), "verdicts")


def enriched(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Events with the model of their run: a stream joined with a table."""
    m = runs.filter("id is not null").groupBy(F.col("id").alias("run_id")).agg(F.max("model").alias("model"))
    return events.select("event_id", "run_id", "event").join(m, "run_id", "left")
