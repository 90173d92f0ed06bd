"""Streams over tables of more files than one batch takes."""

import datetime
import hashlib
import os
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq

from tessera.plans import streams

FILES = 140  # three batches: Spark drops late rows from the third on
LAST = datetime.datetime(2024, 6, 1)


def files(folder, rows):
    """One file a row list, read in this order: a stream takes the oldest files first."""
    folder.mkdir()
    for k, part in enumerate(rows):
        at = folder / f"part-{k:03}.parquet"
        pq.write_table(pa.Table.from_pylist(part), at)
        os.utime(at, (1_700_000_000 + k, 1_700_000_000 + k))


def test_rows_of_later_files_count_however_old(spark, tmp_path):
    events = [[{"ts": LAST - datetime.timedelta(days=40 * k, minutes=m), "event_type": "ab"[m % 2], "value": 1.0 + m} for m in (5, 10, 90)] for k in range(FILES)]
    turns = [[{"run_id": k % 130, "seq": 1, "text": f"t{k % 130}", "ingested_at": LAST - datetime.timedelta(days=40 * k)}] for k in range(FILES)]
    files(tmp_path / "events.parquet", events)
    files(tmp_path / "turns.parquet", turns)

    want = Counter((r["ts"].replace(minute=0), r["event_type"]) for part in events for r in part)
    got = {(r.start, r.event_type): r.n for r in streams.stream_hourly(spark, str(tmp_path)).collect()}
    assert got == want

    once = {(r["run_id"], r["seq"], hashlib.md5(r["text"].encode()).hexdigest()) for part in turns for r in part}
    rows = [tuple(r) for r in streams.stream_deduplicated(spark, str(tmp_path)).collect()]
    assert len(rows) == len(once) and set(rows) == once
