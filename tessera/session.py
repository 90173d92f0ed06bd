"""Session, table access and lineage cutting shared by every operator."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; cluster settings given elsewhere win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for k, v in base.items():
        b = b.config(k, v)
    return b.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that Arrow functions find it wherever they run.

    The archive is handed to Spark, which serves it to executors, those started later included; executors never
    read the driver's folder.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # not when this code itself comes out of such an archive
        files = sorted(root.rglob("*.py"))
        digest = hashlib.md5(b"".join(f.read_bytes() for f in files)).hexdigest()
        archive = Path(tempfile.mkdtemp(prefix="tessera-code-")) / f"tessera-{digest}.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in files:
                z.write(f, Path(root.name) / f.relative_to(root))
        sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a lazy parquet scan (column pruning and filters reach the scan)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, which ``spark.checkpoint.dir`` names.

    Only on one machine (a local master), and only where none is set, a temporary one is made.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named is None and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix=f"tessera-{os.getpid()}-")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder and drop its lineage.

    Files there survive the loss of executors, unlike a local checkpoint.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for broadcast after a check that it has at most ``most`` rows; raises if it has more."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a dimension was expected, but it has more than {most} rows")
    return F.broadcast(df)
