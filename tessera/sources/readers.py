"""Sources of the engine as DataFrames.

Live fetching stays outside: documents come as snapshot files, and a paced reader spaces out reads of a list of
paths the way a polite client spaces requests. Defined results: corrupt records keep their text in
``corrupt``; an unknown dimension key raises; expired cache rows are misses; absent files give no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RSS = "struct<title:string,link:string,pubDate:string,description:string>"


class _Paths(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class PacedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options.get("paths", "").split("\n") if p]
        self.gap = float(options.get("gap", "0.12"))
        self.tasks = max(1, int(options.get("tasks", "1")))

    def partitions(self) -> list[InputPartition]:
        return [_Paths(self.paths[i :: self.tasks]) for i in range(min(self.tasks, len(self.paths)) or 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        last = 0.0
        for p in partition.paths:  # type: ignore[attr-defined]
            wait = last + self.gap * self.tasks - time.monotonic()
            if wait > 0:
                time.sleep(wait)
            last = time.monotonic()
            try:
                with open(p, "rb") as f:
                    yield p, f.read().decode("utf-8", "replace"), None
            except OSError as e:
                yield p, None, f"[document unavailable: {e.strerror}]"


class PacedSource(DataSource):
    """``spark.read.format("paced")``: documents of a list of paths, at most one per ``gap`` seconds in all.

    A path that can't be read gives a marker with its reason instead of an error.
    """

    @classmethod
    def name(cls) -> str:
        return "paced"

    def schema(self) -> str:
        return "path string, content string, reason string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return PacedReader(dict(self.options))


def paced(spark: SparkSession, paths: list[str], gap: float = 0.12, tasks: int = 1) -> DataFrame:
    spark.dataSource.register(PacedSource)
    return spark.read.format("paced").option("paths", "\n".join(paths)).option("gap", gap).option("tasks", tasks).load()


def rss_items(df: DataFrame, xml: str, *keep: str) -> DataFrame:
    """Items of RSS documents: title, link, description as text, and the date in UTC (null if it can't be read)."""
    items = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<item\b.*?</item>"), F.lit(0))
    x = df.select(*keep, F.posexplode(items).alias("pos", "x"))
    part = lambda tag: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("x", rf"(?s)<{tag}>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{tag}>", 1), r"<[^>]*>", " "), r"\s+", " "))
    date = F.regexp_replace(part("pubDate"), r"^\w{3},\s*", "")
    utc = F.coalesce(F.try_to_timestamp(date, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.regexp_replace(date, r"\s*(?:GMT|UTC|Z)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(date, F.lit("d MMM yyyy HH:mm:ss")))
    return x.select(*keep, "pos", part("title").alias("title"), part("link").alias("link"), part("description").alias("description"), utc.alias("published"))


def json_records(df: DataFrame, text: str, schema: str, *keep: str) -> DataFrame:
    """Records of JSON text; text that can't be read stays in ``corrupt`` and its fields are null."""
    full = f"{schema}, corrupt string"
    x = F.from_json(F.col(text), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    return df.select(*keep, x.alias("r")).select(*keep, "r.*")


def fresh(cache: DataFrame, fetched_at: str, ttl_seconds: int, now: Column) -> DataFrame:
    """Cache rows that are still valid; expired and undated ones are misses."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(fetched_at).cast("timestamp"))
    return cache.filter((age <= F.lit(ttl_seconds * 1_000_000)) & (age >= 0))


def dimension_key(df: DataFrame, dim: DataFrame, key: str, value: str, width: int) -> DataFrame:
    """``value`` of each key, padded with zeros; raises if a key is unknown."""
    got = df.join(dim.select(key, value), key, "left")
    return got.withColumn(value, F.when(F.col(value).isNull(), F.raise_error(F.concat(F.lit("unknown key "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.lpad(F.col(value).cast("string"), width, "0")))


class Registry:
    """Named sources; one that fails gives a marker row with its reason, never an error of the whole."""

    def __init__(self) -> None:
        self._sources: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def add(self, name: str, source: Callable[[SparkSession], DataFrame]) -> None:
        self._sources[name] = source

    def names(self) -> list[str]:
        return list(self._sources)

    def gather(self, spark: SparkSession, names: list[str] | None = None) -> DataFrame:
        """``source, ord, line`` of all sources, in the order asked; unknown names come last as markers."""
        known = [n for n in (names or self.names()) if n in self._sources]
        parts = []
        for i, n in enumerate([*known, *[n for n in names or [] if n not in self._sources]]):
            try:
                got = self._sources[n](spark).select(F.lit(n).alias("source"), F.lit(i).alias("ord"), F.col("line").cast("string").alias("line"))
            except Exception as e:  # noqa: BLE001 - a source may fail in any way
                got = spark.createDataFrame([(n, i, f"[{n} unavailable: {type(e).__name__}]")], "source string, ord int, line string")
            parts.append(got)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
