"""Fixed-capacity containers filled with items of varying length.

Sizes lie between 1 and the capacity, so their histogram is bounded whatever the number of items, and the plan
is made on it: from the largest size down, the gap left by an item is filled exactly by one, two or three
sizes whose sums are indexed (bit sets of single and pair sums, availability counts), in bulk; where no exact
complement is left, the best-fitting size goes in and the rest of the gap is tried again. All triples are looked
at; a plan that gives up on them sooner is kept where it needs fewer containers. A plan row is a
pattern of sizes and how many containers follow it. Items get a rank within their size by a two-level count
and meet their place in the plan by a join on the size; only items above the capacity are split.

Defined results: null and empty texts take no place; repeated documents are placed once; an empty table gives
no containers; every container holds at most the capacity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.session import bounded, cut

from .tokens import VOCABULARY, with_tokens

#: Items that one rank bucket of a size holds about; rows a plan may have. A pattern has at most 64 distinct sizes
#: (their sum is bounded by the capacity) and each pattern uses up a size, so plans stay far below.
BUCKET_ITEMS, MAX_PLAN = 200_000, 2_000_000
#: Largest first sizes of a triple that the second plan looks at.
NEAR = 64


def capacity(size_limits: DataFrame) -> int:
    row = size_limits.filter((F.lower(F.trim("item_kind")) == "container") & (F.lower(F.trim("unit")) == "tokens")).agg(F.min("max_size").alias("c")).first()
    if row is None or row["c"] is None or row["c"] < 1:
        raise ValueError("size_limits names no capacity of containers in tokens")
    return int(row["c"])


def plan(counts: dict[int, int], cap: int) -> list[tuple[list[int], int]]:
    """(sizes, number of containers) of every pattern; all items are used, none is split.

    Taking every exact triple may use up small sizes that later containers need, so a second plan, which turns to
    best fit after ``NEAR`` first sizes of a triple, is made too, and the one of fewer containers is taken.
    """
    return min((_plan(counts, cap, cap), _plan(counts, cap, NEAR)), key=lambda rows: sum(times for _, times in rows))


def _plan(counts: dict[int, int], cap: int, firsts: int) -> list[tuple[list[int], int]]:
    left = [0] * (cap + 1)
    for s, n in counts.items():
        if not 0 < s <= cap:
            raise ValueError(f"a size of {s} in a capacity of {cap}")
        left[s] = n
    singles = sum(1 << s for s in range(1, cap + 1) if left[s])
    mirrored = sum(1 << (cap - s) for s in range(1, cap + 1) if left[s])
    out: list[tuple[list[int], int]] = []

    def free(s: int, used: list[int]) -> bool:
        return left[s] > used.count(s)

    def complements(gap: int) -> int:
        """Bit i: the size gap-i is left."""
        return mirrored >> (cap - gap)

    def exact(gap: int, used: list[int]) -> list[int] | None:
        """One, two or three sizes that fill the gap under the availability counts."""
        if gap <= cap and free(gap, used):
            return [gap]
        low = singles & ((1 << gap) - 1)
        pairs = low & complements(gap)
        while pairs:  # the larger of two sizes, from the largest
            a = pairs.bit_length() - 1
            if a * 2 < gap:
                break
            if free(a, used) and free(gap - a, [*used, a]):
                return [a, gap - a]
            pairs ^= 1 << a
        rest, tries = low, 0
        while rest and tries < firsts:  # the largest of three sizes, down to a third of the gap
            a = rest.bit_length() - 1
            rest ^= 1 << a
            tries += 1
            if a * 3 < gap:
                break
            g = gap - a
            two = singles & complements(g) & ((1 << min(g, a + 1)) - 1)
            if not two or not free(a, used):
                continue
            while two:
                b = two.bit_length() - 1
                if b * 2 < g:
                    break
                if free(b, [*used, a]) and free(g - b, [*used, a, b]):
                    return [a, b, g - b]
                two ^= 1 << b
        return None

    while singles:
        s = singles.bit_length() - 1
        pattern, gap = [s], cap - s
        while gap:
            got = exact(gap, pattern)
            if got:
                pattern += got
                break
            fits = singles & ((1 << (gap + 1)) - 1)
            best = 0
            while fits:
                a = fits.bit_length() - 1
                if free(a, pattern):
                    best = a
                    break
                fits ^= 1 << a
            if not best:
                break
            pattern.append(best)
            gap -= best
        times = min(left[x] // pattern.count(x) for x in set(pattern))
        for x in set(pattern):
            left[x] -= times * pattern.count(x)
            if not left[x]:
                singles &= ~(1 << x)
                mirrored &= ~(1 << (cap - x))
        out.append((pattern, times))
    return out


def items(documents: DataFrame, cap: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, piece, start_token, size`` of every item; documents above the capacity in pieces of it."""
    sized = with_tokens(documents, vocabulary).filter("tokens > 0").dropDuplicates(["doc_id"])
    piece = F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / cap).cast("int"))).alias("piece")
    return sized.select("doc_id", "tokens", piece).select("doc_id", "piece", (F.col("piece") * cap).alias("start_token"), F.least(F.lit(cap), F.col("tokens") - F.col("piece") * cap).alias("size"))


def pack(documents: DataFrame, size_limits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``container, place, doc_id, piece, start_token, size`` of every item."""
    spark: SparkSession = documents.sparkSession
    cap = capacity(size_limits)
    rows = cut(items(documents, cap, vocabulary))  # fixed before ranks are given, so lost tasks can't change them
    counts = {r["size"]: r["n"] for r in rows.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most `cap` rows
    slots, base = [], 0
    taken = dict.fromkeys(counts, 0)
    for pattern, times in plan(counts, cap):
        place = 1
        for s in sorted(set(pattern), reverse=True):  # one row for all items of a size in a pattern
            many = pattern.count(s)
            slots.append((s, taken[s], taken[s] + times * many, base, place, many))
            taken[s] += times * many
            place += many
        base += times
    if len(slots) > MAX_PLAN:
        raise ValueError("the plan is larger than a plan may be")
    places = spark.createDataFrame(slots, "size int, lo bigint, hi bigint, base bigint, first int, many int")
    ranked = rank(rows, sum(counts.values()))
    joined = ranked.join(bounded(places, MAX_PLAN), (ranked["size"] == places["size"]) & (ranked["rank"] >= places["lo"]) & (ranked["rank"] < places["hi"]))
    nth = F.col("rank") - F.col("lo")
    return joined.select((F.col("base") + F.floor(nth / F.col("many"))).alias("container"), (F.col("first") + nth % F.col("many")).cast("int").alias("place"), "doc_id", "piece", "start_token", ranked["size"])


def rank(rows: DataFrame, total: int) -> DataFrame:
    """``rank`` (from 0) of each item within its size: counted within hash buckets, offset by the buckets before."""
    buckets = max(1, -(-total // BUCKET_ITEMS))
    b = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    per = b.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("bucket")) - F.col("n")).drop("n")
    within = b.withColumn("k", F.row_number().over(Window.partitionBy("size", "bucket").orderBy("doc_id", "piece")) - 1)
    return within.join(before, ["size", "bucket"]).withColumn("rank", F.col("before") + F.col("k")).drop("bucket", "before", "k")


def report(packed: DataFrame, cap: int) -> DataFrame:
    """``capacity, containers, least_possible, tokens, fill``."""
    per = packed.groupBy("container").agg(F.sum("size").alias("used"))
    return per.agg(F.lit(cap).alias("capacity"), F.count("*").alias("containers"), F.ceil(F.sum("used") / cap).alias("least_possible"), F.sum("used").alias("tokens"), F.round(F.sum("used") / (F.count("*") * cap), 6).alias("fill"))
