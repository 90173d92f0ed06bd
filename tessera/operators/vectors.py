"""An index for nearest-neighbour search: cells around centroids, every row in its cell, queries looking into several.

The centroids are fitted on a bounded sample (``SAMPLE`` rows of the lowest hash, on the driver); every row is
indexed. A cell may hold any share of the rows, so it is spread over ``SALT`` parts, and within them rows are packed
into blocks of bounded size, which meet the blocks of the queries of their cell. How many cells a query looks into is
calibrated on the sample: the fewest that hold ``TARGET`` of the exact neighbours of some of its rows. Clustered
vectors need few, vectors without any structure more than half. Recall over the whole tables is measured by
``recall``; with as many probes as cells the search is exact.

Defined results: vectors that are null, empty, zero or of another length than the sample's match nothing; a row isn't
its own neighbour; ties are broken by id; an empty table gives no neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

SAMPLE, CELLS, SALT, BLOCK, ROUNDS = 20_000, 64, 8, 2048, 10
TARGET, ASKED, NEAR = 0.96, 256, 10
PACKED = "cell int, part int, ids binary, matrix binary"


def _unit(vecs: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are usable, and those as rows of unit length."""
    ok = np.array([v is not None and len(v) == dim for v in vecs], bool)
    m = np.stack([np.asarray(v, np.float32) for v, k in zip(vecs, ok, strict=True) if k]) if ok.any() else np.zeros((0, dim), np.float32)
    norm = np.sqrt((m.astype(np.float64) ** 2).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    ok[np.flatnonzero(ok)[~good]] = False
    return ok, (m[good] / norm[good, None]).astype(np.float32)


def fit(rows: DataFrame, id_col: str, vec_col: str, cells: int = CELLS, sample: int = SAMPLE) -> tuple[np.ndarray, int]:
    """Centroids (unit rows) of a bounded sample, by spherical k-means from a seeded start, and the calibrated probes."""
    some = rows.filter(F.col(id_col).isNotNull() & (F.size(vec_col) > 0)).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    got = some.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    if not len(got):
        return np.zeros((0, 0), np.float32), 0
    dim = int(got.vec.map(len).mode().iloc[0])
    _, m = _unit(got.vec, dim)
    rng = np.random.default_rng(7)
    c = m[np.sort(rng.choice(len(m), min(cells, len(m)), replace=False))].copy()
    for _ in range(ROUNDS):
        near = (m @ c.T).argmax(1)
        for k in range(len(c)):
            s = m[near == k].sum(0)
            norm = np.linalg.norm(s)
            c[k] = s / norm if norm > 0 else c[k]
    return c, _probes(m, c)


def _probes(m: np.ndarray, c: np.ndarray) -> int:
    """The fewest cells that hold ``TARGET`` of the ``NEAR`` nearest neighbours of ``ASKED`` rows of the sample."""
    n = min(NEAR, len(m) - 1)
    if n < 1:
        return len(c)
    asked = np.arange(0, len(m), max(1, len(m) // ASKED))
    score = m[asked] @ m.T
    score[np.arange(len(asked)), asked] = -np.inf
    best = np.argpartition(-score, n - 1, axis=1)[:, :n]
    place = np.argsort(np.argsort(-(m[asked] @ c.T), axis=1, kind="stable"), axis=1)  # rank of each cell for each asked row
    rank = np.take_along_axis(place, (m @ c.T).argmax(1)[best], 1)
    held = np.cumsum(np.bincount(rank.ravel(), minlength=len(c))) / rank.size
    return int(np.argmax(held >= TARGET)) + 1


def _placed(df: DataFrame, id_col: str, vec_col: str, centroids: np.ndarray, probes: int, spread: bool) -> DataFrame:
    """Blocks of unit vectors by (cell, part): rows in one part of their nearest cell, queries in all parts of several."""
    dim = centroids.shape[1]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok, m = _unit(b.vec, dim)
            ids = b.id.to_numpy()[ok]
            top = np.argsort(-(m @ centroids.T), axis=1, kind="stable")[:, :probes]
            each = np.repeat(np.arange(len(ids)), top.shape[1])
            yield pd.DataFrame({"id": ids[each], "cell": top.ravel().astype("int32"), "vec": [m[i].tobytes() for i in each]})

    known = df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"))
    at = known.mapInPandas(place, "id bigint, cell int, vec binary")
    part = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))) if spread else F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")
    rows = at.withColumn("part", part).repartition("cell", "part").sortWithinPartitions("cell", "part", "id")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[int, int] | None = None
        ids: list[int] = []
        vecs: list[bytes] = []

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"cell": [held[0]], "part": [held[1]], "ids": [np.array(ids, np.int64).tobytes()], "matrix": [b"".join(vecs)]})
            ids.clear(), vecs.clear()
            return out

        for b in batches:
            for i, c, v, p in zip(b.id, b.cell, b.vec, b.part, strict=True):
                if ids and ((c, p) != held or len(ids) >= BLOCK):
                    yield flush()
                held = (c, p)
                ids.append(i)
                vecs.append(v)
        if ids:
            yield flush()

    return rows.mapInPandas(pack, PACKED)


def search(queries: DataFrame, rows: DataFrame, id_col: str, vec_col: str, k: int, index: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """The ``k`` rows nearest to each query by cosine among the cells it looks into: ``query_id, row_id, score, rank``."""
    c, probes = fit(rows, id_col, vec_col) if index is None else index
    spark = rows.sparkSession
    if not len(c):
        return spark.createDataFrame([], "query_id bigint, row_id bigint, score double, rank int")
    dim = c.shape[1]
    b = _placed(rows, id_col, vec_col, c, 1, False)
    q = _placed(queries, id_col, vec_col, c, probes, True).select("cell", "part", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for r in f.itertuples(index=False):
                qi, bi = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
                score = np.frombuffer(r.q_matrix, np.float32).reshape(-1, dim).astype(np.float64) @ np.frombuffer(r.matrix, np.float32).reshape(-1, dim).astype(np.float64).T
                score = np.round(score, 6)
                score[qi[:, None] == bi[None, :]] = -np.inf
                n = min(k, len(bi))
                floor = np.partition(score, len(bi) - n, axis=1)[:, len(bi) - n]  # ties at the k-th place all travel on
                i, j = np.nonzero((score >= floor[:, None]) & np.isfinite(score))
                yield pd.DataFrame({"query_id": qi[i], "row_id": bi[j], "score": score[i, j]})

    got = b.join(q, ["cell", "part"]).select("ids", "matrix", "q_ids", "q_matrix").mapInPandas(best, "query_id bigint, row_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    return got.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: ``queries``, and the share of the exact neighbours that were found."""
    hit = exact.select("query_id", "row_id").join(found.select("query_id", "row_id", F.lit(1).alias("hit")), ["query_id", "row_id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
