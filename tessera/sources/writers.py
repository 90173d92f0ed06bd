"""Sinks: appends with ids, whole-table replacement, record files.

A table is replaced by writing the new state beside it and swapping folders, so readers see the old or the
new one. Defined results: appending nothing is refused; ids go on from the greatest there is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F


def append_with_ids(store: DataFrame, rows: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows with ids above the store's greatest, in the order of a hash of their content.

    Ids are unique and need no global sort: each partition numbers its own range.
    """
    if not rows.limit(1).count():
        raise ValueError("there is nothing to append")
    top = store.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("bigint").alias("_top"))  # one row
    return rows.crossJoin(F.broadcast(top)).withColumn(id_col, F.col("_top") + F.monotonically_increasing_id() + 1).drop("_top")


def replace_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write ``df`` as the new state of the table at ``path``; the old state goes after the swap."""
    spark = df.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    w = df.write
    (w.partitionBy(partition_by) if partition_by else w).parquet(new)
    hp = spark._jvm.org.apache.hadoop.fs.Path
    fs = hp(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(hp(path))
    if had and not fs.rename(hp(path), hp(old)):
        raise OSError(f"can't move {path}")
    if not fs.rename(hp(new), hp(path)):
        if had:
            fs.rename(hp(old), hp(path))
        raise OSError(f"can't put the new state at {path}")
    if had:
        fs.delete(hp(old), True)


def write_records(df: DataFrame, path: str) -> None:
    """JSON record files, one object per line."""
    df.write.mode("errorifexists").json(path)
