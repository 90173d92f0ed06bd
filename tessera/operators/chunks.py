"""Sentence windows of sections, their neighbours, overlaps, and vector retrieval over them.

Searches are exact: queries and rows are packed into blocks of bounded size, each pair of blocks is one matrix
product, and only the best of each block travel on. Defined results: sections without sentences have no
windows; vectors that are null, empty, zero or of another length match nothing; ties are broken by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.text import split_sentences

CORE, STRIDE, CONTEXT = 3, 2, 1
BLOCK, SALT = 2048, 16
# Phrases of boilerplate chunks.
BOILERPLATE = ["forward-looking", "safe harbor", "incorporated by reference", "table of contents", "basis of presentation", "recently adopted accounting", "for information only", "subject to change without notice", "all rights reserved"]


def windows(sections: DataFrame) -> DataFrame:
    """``section_id, k, window_start, core_start, core_end, window_end, text``: cores of three sentences, stride two, a sentence of context on either side.

    A last core of one sentence is dropped unless it is the only one.
    """
    s = sections.filter("text is not null").select("section_id", split_sentences(F.col("text")).alias("s")).filter(F.size("s") > 0).groupBy("section_id").agg(F.min("s").alias("s"))
    n = F.size("s")
    at = F.explode(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)), F.lit(STRIDE))).alias("core_start")
    w = s.select("section_id", "s", n.alias("n"), at)
    core_end = F.least(F.col("core_start") + CORE, F.col("n"))
    lo, hi = F.greatest(F.col("core_start") - CONTEXT, F.lit(0)), F.least(core_end + CONTEXT, F.col("n"))
    return w.select("section_id", (F.col("core_start") / STRIDE).cast("int").alias("k"), lo.alias("window_start"), "core_start", core_end.alias("core_end"), hi.alias("window_end"), F.array_join(F.slice("s", lo + 1, hi - lo), " ").alias("text"))


def is_boilerplate(text: Column) -> Column:
    """A phrase of the list, or fewer than two sentences of prose once digits are gone."""
    low = F.lower(text)
    phrase = F.exists(F.array(*[F.lit(p) for p in BOILERPLATE]), lambda p: low.contains(p))
    prose = F.filter(split_sentences(F.regexp_replace(text, r"\d", "")), lambda x: F.size(F.split(x, r"\s+")) >= 5)
    return phrase | (F.size(prose) < 2)


def predecessors(chunks: DataFrame) -> DataFrame:
    """Each window with the text before it in its section, by an equi-join on the place."""
    before = chunks.select("section_id", (F.col("k") + 1).alias("k"), F.col("text").alias("context"))
    return chunks.join(before, ["section_id", "k"], "left")


def overlapping(chunks: DataFrame) -> DataFrame:
    """Pairs of windows of a section that share sentences: ``section_id, k, other``.

    Windows start two sentences apart and are five long at most, so only the next two can overlap.
    """
    a = chunks.select("section_id", "k", "window_end", F.explode(F.array(F.col("k") + 1, F.col("k") + 2)).alias("other"))
    b = chunks.select("section_id", F.col("k").alias("other"), "window_start")
    return a.join(b, ["section_id", "other"]).filter(F.col("window_start") < F.col("window_end")).select("section_id", "k", "other")


def _blocks(df: DataFrame, id_col: str, vec_col: str, label: str | None, size: int) -> DataFrame:
    """Blocks of at most ``size`` unit vectors: ids, labels and the matrix as bytes, one row each."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        labels: list = []
        vecs: list = []

        def flush() -> pd.DataFrame:
            m = np.stack(vecs).astype(np.float32)
            out = pd.DataFrame({"ids": [np.array(ids, np.int64).tobytes()], "labels": [np.array(labels, np.int64).tobytes()], "dim": [m.shape[1]], "matrix": [m.tobytes()]})
            ids.clear(), labels.clear(), vecs.clear()
            return out

        for b in batches:
            for i, v, g in zip(b["id"], b["vec"], b["label"], strict=True):
                if not len(v):
                    continue
                x = np.asarray(v, np.float64)
                norm = np.sqrt((x * x).sum())
                if not np.isfinite(norm) or norm == 0:
                    continue
                if vecs and (len(vecs[0]) != len(x) or len(vecs) >= size):
                    yield flush()
                ids.append(i)
                labels.append(-1 if g is None or pd.isna(g) else int(g))
                vecs.append(x / norm)
        if vecs:
            yield flush()

    known = df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
    cols = known.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), (F.col(label) if label else F.lit(None)).cast("bigint").alias("label"))
    return cols.mapInPandas(pack, "ids binary, labels binary, dim int, matrix binary")


def nearest(queries: DataFrame, rows: DataFrame, id_col: str, vec_col: str, k: int, floor: float = -1.0, fence: str | None = None, boost: float = 0.0) -> DataFrame:
    """The ``k`` rows nearest to each query by cosine: ``query_id, row_id, score, rank``; a row isn't its own neighbour.

    With ``fence`` only rows of the query's label count; with ``boost`` such rows get it added before ranking.
    """
    q = _blocks(queries, id_col, vec_col, fence or ("label" if boost else None), BLOCK).select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "labels", "dim", "matrix")])
    b = _blocks(rows, id_col, vec_col, fence or ("label" if boost else None), BLOCK)
    # every block of rows meets every block of queries of its dimension: (n/BLOCK) * (q/BLOCK) matrix products, spread by the
    # block's hash. Exact, so quadratic; ``vectors.search`` is the way for large tables.
    b = b.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALT)).cast("int"))
    q = q.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    pairs = b.join(q, (F.col("dim") == F.col("q_dim")) & (b["salt"] == q["salt"])).select("ids", "labels", "dim", "matrix", "q_ids", "q_labels", "q_matrix")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for r in f.itertuples(index=False):
                qi, bi = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
                score = np.frombuffer(r.q_matrix, np.float32).reshape(-1, r.dim).astype(np.float64) @ np.frombuffer(r.matrix, np.float32).reshape(-1, r.dim).astype(np.float64).T
                same = np.frombuffer(r.q_labels, np.int64)[:, None] == np.frombuffer(r.labels, np.int64)[None, :]
                ok = (score >= floor) & (qi[:, None] != bi[None, :])
                if fence:
                    ok &= same
                key = np.round(score + boost * same, 6)
                key[~ok] = -np.inf
                n = min(k, len(bi))
                least = np.partition(key, len(bi) - n, axis=1)[:, len(bi) - n]  # ties at the k-th place all travel on
                i, j = np.nonzero((key >= least[:, None]) & np.isfinite(key))
                yield pd.DataFrame({"query_id": qi[i], "row_id": bi[j], "score": key[i, j]})

    got = pairs.mapInPandas(best, "query_id bigint, row_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    return got.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def greedy(candidates: DataFrame, k: int, same: float) -> DataFrame:
    """Walk each query's ranked candidates and keep ``k`` whose words overlap none kept before by more than ``same``.

    ``candidates`` has ``query_id, row_id, score, words``; a query's candidates are its top rows, a bounded list.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[int, float, set]] = []
        for r in pdf.sort_values(["score", "row_id"], ascending=[False, True]).itertuples(index=False):
            words = set(r.words) if r.words is not None else set()
            if any(words and x and len(words & x) > same * min(len(words), len(x)) for _, _, x in kept):
                continue
            kept.append((r.row_id, r.score, words))
            if len(kept) == k:
                break
        return pd.DataFrame({"query_id": [pdf.query_id.iloc[0]] * len(kept), "row_id": [x[0] for x in kept], "score": [x[1] for x in kept], "pick": range(1, len(kept) + 1)})

    return candidates.groupBy("query_id").applyInPandas(pick, "query_id bigint, row_id bigint, score double, pick int")
