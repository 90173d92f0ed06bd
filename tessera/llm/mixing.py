"""Records of several sources mixed to target weights.

A text that stands in several sources can serve any of them, so documents are aggregated by membership
pattern (the set of sources that hold the text), and a min-cost flow routes the patterns' tokens to the
sources' quotas: the r-th use of a text costs r-1, so repetition is used where it must be and capped by each
source. The largest total whose quotas are all met is found on the same graph, whose size depends on the
sources alone. Documents are then chosen in a seeded order, by running token counts within hash buckets.

Defined results: documents without a target source, without tokens, or null take no part; sources are compared
ignoring case and outer space; exact copies count as one text; repeated rows count once; a target whose source
is empty makes the reachable total 0, and the result is then empty.
"""

from __future__ import annotations

from collections import defaultdict
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.session import bounded, cut

from .conversations import squeeze
from .tokens import VOCABULARY, with_tokens

MAX_PATTERNS, BUCKET_ITEMS = 20_000, 200_000


class Flow:
    """Min-cost flow by successive shortest paths; integer capacities and costs."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []
        self.out: dict[str, list[int]] = defaultdict(list)
        self.names: dict[str, int] = {}
        self.head: list[str] = []

    def edge(self, u: str, v: str, cap: int, cost: int = 0) -> int:
        for a, b, c, w in ((u, v, cap, cost), (v, u, 0, -cost)):
            self.out[a].append(len(self.to))
            self.to.append(self.names.setdefault(b, len(self.names)))
            if len(self.head) < len(self.names):
                self.head.append(b)
            self.names.setdefault(a, len(self.names))
            if len(self.head) < len(self.names):
                self.head.append(a)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, s: str, t: str) -> int:
        """Send as much as possible at the least cost; the amount sent."""
        sent = 0
        while True:
            dist, via, queue, queued = {s: 0}, {}, [s], {s}
            for u in queue:  # label correcting, as edges back have negative costs
                queued.discard(u)
                for e in self.out[u]:
                    if self.cap[e] > 0:
                        v = self.head[self.to[e]]
                        if v not in dist or dist[u] + self.cost[e] < dist[v]:
                            dist[v], via[v] = dist[u] + self.cost[e], (u, e)
                            if v not in queued:
                                queue.append(v)
                                queued.add(v)
            if t not in dist:
                return sent
            path, v = [], t
            while v != s:
                u, e = via[v]
                path.append(e)
                v = u
            push = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= push
                self.cap[e ^ 1] += push
            sent += push


def route(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[Fraction, int]]) -> tuple[dict[tuple[tuple[str, ...], int, str], int], int]:
    """Tokens of (pattern, use, source), and the total: the largest whose quotas are met, at the least repetition."""

    def attempt(total: int) -> tuple[dict, bool]:
        g, kept, want = Flow(), {}, 0
        for s, (share, _) in targets.items():
            quota = int(share * total)
            want += quota
            g.edge(f"s:{s}", "T", quota)
        for p, tokens in patterns.items():
            for r in range(1, max((targets[s][1] for s in p if s in targets), default=0) + 1):
                g.edge("S", f"p:{p}:{r}", tokens, r - 1)
                for s in p:
                    if s in targets and r <= targets[s][1]:
                        kept[p, r, s] = g.edge(f"p:{p}:{r}", f"s:{s}", tokens)
        done = g.run("S", "T") >= want
        return {k: g.cap[e ^ 1] for k, e in kept.items() if g.cap[e ^ 1]}, done

    lo, hi = 0, sum(t * max((targets[s][1] for s in p if s in targets), default=0) for p, t in patterns.items())
    while hi - lo > max(1, lo // 100_000):
        mid = (lo + hi + 1) // 2
        if attempt(mid)[1]:
            lo = mid
        else:
            hi = mid - 1
    flow = attempt(lo)[0]
    return flow, lo if flow else 0


def texts(documents: DataFrame, sources: DataFrame, vocabulary: str) -> DataFrame:
    """One row per distinct text: ``digest, tokens, members`` (source and least doc_id), ``pattern``."""
    rows = documents.select("doc_id", "text", squeeze(F.col("source")).alias("source"), F.sha2("text", 256).alias("digest")).join(sources.select("source"), "source", "left_semi")
    sized = with_tokens(rows, vocabulary, "source string, digest string").filter("tokens > 0")
    each = sized.groupBy("digest", "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    # a text has at most as many members as there are target sources
    return each.groupBy("digest").agg(F.max("tokens").alias("tokens"), F.sort_array(F.collect_list(F.struct("source", "doc_id"))).alias("members")).withColumn("pattern", F.array_join("members.source", "\n"))


def mix(documents: DataFrame, mix_targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = 0) -> DataFrame:
    """The chosen documents: ``doc_id, source, repeats, tokens``."""
    spark: SparkSession = documents.sparkSession
    goal = mix_targets.groupBy(squeeze(F.col("source")).alias("source")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("reps")).filter("share > 0 and reps > 0")
    goal = bounded(goal, MAX_PATTERNS)
    targets = {r["source"]: (Fraction(repr(float(r["share"]))), int(r["reps"])) for r in goal.collect()}
    all_texts = cut(texts(documents, goal, vocabulary))  # small rows, fixed before they are ranked
    sums = all_texts.groupBy("pattern").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    flow, _ = route({tuple(r["pattern"].split("\n")): r["tokens"] for r in sums}, targets)
    spans, at = [], defaultdict(int)
    for (p, use, s), tokens in sorted(flow.items()):
        spans.append(("\n".join(p), use, s, at[p, use], at[p, use] + tokens))
        at[p, use] += tokens
    plan = spark.createDataFrame(spans, "pattern string, use int, source string, lo bigint, hi bigint")
    buckets = max(1, -(-sum(r["n"] for r in sums) // BUCKET_ITEMS))
    order = F.xxhash64("digest", F.lit(seed))
    b = all_texts.withColumns({"order": order, "bucket": F.pmod(order, F.lit(buckets))})
    per = b.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("n"))
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("n")).drop("n")
    within = b.withColumn("run", F.sum("tokens").over(Window.partitionBy("pattern", "bucket").orderBy("order", "digest").rowsBetween(Window.unboundedPreceding, 0)))
    placed = within.join(before, ["pattern", "bucket"]).withColumn("middle", F.col("before") + F.col("run") - F.col("tokens") / 2)
    # the plan has a row for each pattern, use and source: its size is checked
    chosen = placed.join(bounded(plan, MAX_PATTERNS * 64), "pattern").filter("middle >= lo and middle < hi")
    doc = F.element_at(F.filter("members", lambda m: m["source"] == F.col("source")), 1)["doc_id"]
    return chosen.select(doc.alias("doc_id"), "source", "tokens").groupBy("doc_id", "source", "tokens").agg(F.count("*").alias("repeats")).select("doc_id", "source", "repeats", "tokens")


def shares(mixed: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """The shares reached: ``source, target_share, max_repeats, docs, tokens, share, most_repeats``."""
    got = mixed.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    total = got.agg(F.sum("tokens").alias("total"))  # one row
    goal = mix_targets.select(squeeze(F.col("source")).alias("source"), "target_share", "max_repeats")
    out = goal.join(got, "source", "left").fillna(0, ["docs", "tokens", "most_repeats"]).crossJoin(F.broadcast(total))
    return out.select("source", "target_share", "max_repeats", "docs", "tokens", F.coalesce(F.round(F.col("tokens") / F.col("total"), 6), F.lit(0.0)).alias("share"), "most_repeats")
