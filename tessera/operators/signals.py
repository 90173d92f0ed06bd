"""Scores, selections and rule reports over items: materiality, greedy selection, assignment, samples, gaps, rules.

Defined results: null texts and titles score nothing; undated items get no recency; ties are broken by id;
groups given to a greedy walk hold light columns only; empty tables give empty results.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.session import cut

#: Rows that one bucket of a sample's ranking holds about.
BUCKET_ROWS = 200_000

# Terms of material news and their weights, words of company names that identify nothing, terms of finance.
MATERIAL = {
    "loan": 1.5, "financing": 1.5, "debt": 1.0, "bond": 1.0, "credit": 0.75, "guarantee": 1.5,
    "guidance": 1.5, "outlook": 1.0, "forecast": 1.0, "raises": 1.0, "cuts": 1.0, "misses": 1.0, "beats": 1.0,
    "acquisition": 1.5, "acquire": 1.5, "acquires": 1.5, "merger": 1.5, "deal": 1.0, "contract": 1.0, "agreement": 1.0,
    "downgrade": 1.5, "downgrades": 1.5, "upgrade": 1.0, "upgrades": 1.0, "lawsuit": 1.5, "sues": 1.5,
    "investigation": 1.5, "probe": 1.0, "recall": 1.0, "layoffs": 1.0, "ceo": 1.0, "resigns": 1.0,
    "buyback": 1.0, "dividend": 0.5, "earnings": 1.0, "revenue": 0.75, "billion": 0.75, "reuters": 0.5, "bloomberg": 0.5,
}
CAP = 4.0
WINDOW_DAYS = 30
REJECTED = -1e6
FORWARD = r"(?i)\b(expect\w*|anticipat\w*|outlook|guidance|forecast\w*|project(?:s|ed|ion)\w*|target\w*|plan(?:s|ned)?|intend\w*)\b"
FIGURE = r"(?i)\$\s?\d|\d+(?:\.\d+)?\s?%|\d+(?:\.\d+)?\s?(?:billion|million|thousand|percent|basis points|bps)|\d+(?:\.\d+)?x\b"
EXCLUDED = r"(?i)forward-looking|safe harbou?r|compensation|lease maturit|deferred revenue|hedg\w+ instrument|stress test|effective tax rate"


def tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]+)"), F.lit(1)))


def weight_of(term: Column) -> Column:
    """The weight of a term of material news, 0 for any other word."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MATERIAL.items() for x in kv]), term), F.lit(0.0))


def materiality(title: Column, body: Column) -> Column:
    """Sum of the weights of the terms among two arrays of tokens, twice for those of the title, at most ``CAP``.

    The arrays are filtered to the terms first, so a text's tokens are made and looked at once.
    """
    terms = F.array(*[F.lit(t) for t in MATERIAL])
    add = lambda got, x: got + weight_of(x)
    own = F.array_intersect(title, terms)
    rest = F.array_except(F.array_intersect(body, terms), own)
    return F.least(F.aggregate(own, F.lit(0.0), add) * 2 + F.aggregate(rest, F.lit(0.0), add), F.lit(CAP))


def recency(published: Column, now: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), 1.5 * (1 - F.datediff(now, published) / WINDOW_DAYS)), F.lit(0.0))


def scored(items: DataFrame, now: Column, company: str | None = None, ticker: str | None = None) -> DataFrame:
    """``items`` (with ``title, body, published``) with ``score``: materiality and recency, and identity where it is named.

    Items that name neither the company nor its ticker (of three letters or more) are rejected. The tokens are made in a
    step of their own, so a text is tokenized once.
    """
    t = items.withColumns({"_t": tokens(F.col("title")), "_b": tokens(F.col("body"))})
    score = materiality(F.col("_t"), F.col("_b")) + recency(F.col("published"), now)
    if company and ticker:
        named = F.filter(tokens(F.col(company)), lambda x: (F.length(x) > 2) & ~x.isin(*LEGAL))
        all_ = F.array_union("_t", "_b")
        hits, in_title = F.size(F.array_intersect(named, all_)), F.size(F.array_intersect(named, F.col("_t")))
        own = F.array_contains(all_, F.lower(F.col(ticker)))
        known = (F.size(named) == 0) | (hits > 0) | (own & (F.length(ticker) >= 3))
        score = F.when(known, score + hits * 3 + in_title * 2 + F.when(own, 1.5).otherwise(0.0)).otherwise(REJECTED)
    return t.withColumn("score", score).drop("_t", "_b")


# Legal forms in company names.
LEGAL = ["inc", "corp", "corporation", "company", "ltd", "limited", "plc", "llc", "the", "group", "holdings"]


def is_blocked(publisher: Column, link: Column, blocked: list[str]) -> Column:
    """Whether a publisher is on a list, by its name without spaces or by its domain, ignoring case."""
    label = F.regexp_replace(F.lower(F.coalesce(publisher, F.lit(""))), r"\s+", "")
    host = F.lower(F.regexp_extract(F.coalesce(link, F.lit("")), r"^[a-zA-Z]+://([^/?#]+)", 1))
    return F.exists(F.array(*[F.lit(x) for x in blocked]), lambda x: label.contains(x) | host.contains(x))


def select(items: DataFrame, per_publisher: int, same: float, budget: int, limit: int) -> DataFrame:
    """A greedy walk of each key's items by score: few of a publisher, none too like one taken, stop at the budget.

    ``items`` has ``key, id, score, publisher, words, chars``: light columns, exact repeats already gone.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, seen, used = [], {}, 0
        for r in pdf.sort_values(["score", "id"], ascending=[False, True]).itertuples(index=False):
            if r.score < 0 or seen.get(r.publisher, 0) >= per_publisher:
                continue
            w = set(r.words)
            if any(w and x and len(w & x) >= same * min(len(w), len(x)) for _, x in taken):
                continue
            if used + r.chars > budget or len(taken) == limit:
                break
            taken.append((r.id, w))
            seen[r.publisher] = seen.get(r.publisher, 0) + 1
            used += r.chars
        return pd.DataFrame({"key": [pdf.key.iloc[0]] * len(taken), "id": [i for i, _ in taken], "place": range(1, len(taken) + 1)})

    kind = dict(items.dtypes)
    return items.groupBy("key").applyInPandas(walk, f"key {kind['key']}, id {kind['id']}, place int")


def assign(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Left texts matched one to one with right texts of their key, best Jaccard first; the unmatched get null.

    Both have ``key, pos, text``. Candidates meet on (key, word), so only texts with a word in common are compared and
    no list of a key's texts is made; then, in rounds, every pair that is the best of both its texts is taken, which
    gives the greedy result. A round ends when no pair is left; each takes at least the best pair of every key.
    """
    toks = lambda df, n: df.select("key", F.col("pos").alias(n), F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")).alias(f"w_{n}")).distinct()
    a, b = toks(left, "l"), toks(right, "r")
    met = a.select("key", "l", F.size("w_l").alias("nl"), F.explode("w_l").alias("word")).join(b.select("key", "r", F.size("w_r").alias("nr"), F.explode("w_r").alias("word")), ["key", "word"])
    both = met.filter("word <> ''").groupBy("key", "l", "r", "nl", "nr").agg(F.count("*").alias("n"))
    score = F.col("n") / (F.col("nl") + F.col("nr") - F.col("n"))
    pairs = cut(both.select("key", "l", "r", score.alias("score")).filter(F.col("score") >= least))
    taken = None
    while not pairs.isEmpty():
        ranked = pairs.withColumn("o", F.struct((-F.col("score")).alias("s"), "l", "r"))
        best_l = ranked.groupBy("key", "l").agg(F.min("o").alias("bl"))
        best_r = ranked.groupBy("key", "r").agg(F.min("o").alias("br"))
        got = cut(ranked.join(best_l, ["key", "l"]).join(best_r, ["key", "r"]).filter("o = bl and o = br").select("key", "l", "r", "score"))
        taken = got if taken is None else taken.unionByName(got)
        pairs = cut(pairs.join(got.select("key", "l"), ["key", "l"], "left_anti").join(got.select("key", "r"), ["key", "r"], "left_anti"))
    some = left.select("key", "pos").distinct()
    if taken is None:
        return some.select("key", "pos", F.lit(None).cast(dict(right.dtypes)["pos"]).alias("match"), F.lit(None).cast("double").alias("score"))
    return some.join(taken.withColumnRenamed("l", "pos"), ["key", "pos"], "left").select("key", "pos", F.col("r").alias("match"), F.round("score", 4).alias("score"))


def stratified(df: DataFrame, key: str, size: str, shares: list[float], n: int, seed: int) -> DataFrame:
    """``n`` rows drawn from tiers of falling size (equal counts) by shares, in the order of a seeded hash.

    Tier bounds are approximate quantiles, so no global sort is needed. A tier holds a share of all rows, so it is
    spread over buckets by the high bits of the hash: bucket counts tell which buckets the quota reaches, and only
    those are ranked. The hash order is the order of (bucket, hash), so the result is that of one ranking.
    """
    k = len(shares)
    cuts = df.agg(F.percentile_approx(size, [1 - (i + 1) / k for i in range(k - 1)], 100_000).alias("c"), F.count("*").alias("all"))  # one row
    tier = F.lit(0)
    t = df.crossJoin(F.broadcast(cuts))
    for i in range(k - 1):
        tier = tier + (F.col(size) <= F.col("c")[i]).cast("int")
    # about BUCKET_ROWS rows a bucket, in the order of the hash (made unsigned)
    buckets = F.greatest(F.ceil(F.col("all") / BUCKET_ROWS), F.lit(1)).cast("double")
    h = t.withColumns({"tier": tier, "h": F.xxhash64(key, F.lit(seed))})
    h = h.withColumn("bucket", F.least(F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * buckets), buckets - 1).cast("bigint")).select(key, "tier", "h", "bucket")
    quota = F.coalesce(*[F.when(F.col("tier") == i, F.lit(round(n * s))) for i, s in enumerate(shares)])
    per = h.groupBy("tier", "bucket").agg(F.count("*").alias("m"))
    before = per.withColumn("before", F.sum("m").over(Window.partitionBy("tier").orderBy("bucket")) - F.col("m")).filter(F.col("before") < quota).select("tier", "bucket", "before")
    w = Window.partitionBy("tier", "bucket").orderBy("h", key)
    within = h.join(before, ["tier", "bucket"]).withColumn("k", F.row_number().over(w))
    return within.withColumn("k", (F.col("k") + F.col("before")).cast("int")).filter(F.col("k") <= quota).select(key, "tier", "k")


def issues(df: DataFrame, key: str, rules: dict[str, Column], blocking: set[str]) -> DataFrame:
    """Rule report: the names of the rules that hold, and the verdict they give."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))
    v = F.when(F.arrays_overlap("issues", F.array(*[F.lit(b) for b in sorted(blocking)])), "NOT READY").when(F.size("issues") > 0, "PARTIAL").otherwise("READY")
    return df.select(key, found.alias("issues")).withColumn("verdict", v)
