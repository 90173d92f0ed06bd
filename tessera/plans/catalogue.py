"""All queries outside the optional subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpus, figures, governance, packets, runlog, series, signals, sources, streams, texts

MODULES = [governance, packets, runlog, series, texts, figures, signals, sources, streams, corpus]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for m in MODULES for k, q in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.oracle_sql().items()}
