"""Work on evidence packets: scales, duplicates, caps, excerpts, tags, salvage.

Defined results: null texts and labels match nothing; a packet that states several scales has none; caps of 0
leave nothing; repeated rows count once; empty tables give empty results.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.text import split_sentences, words

TICKER = r"^[A-Z]{1,5}(\.[A-Z])?$"
SCALE = r"(?i)\b(thousand|million|billion)s?\b"
FIGURE = r"(?i)\$\s?\d|\d+(?:\.\d+)?\s?%|\d+(?:\.\d+)?x\b"
# Words that tell what a business does.
ARCHETYPES = {
    "semis_hardware": r"semiconductors?|\bchips?\b|wafers?|foundr(?:y|ies)|integrated circuits?|microcontrollers?|\banalog\b|processors?|memory products|networking silicon",
    "software": r"\bsoftware\b|\bsaas\b|subscription software|cloud platform|licen[cs]es? (?:revenue|fees)|enterprise applications?",
    "consumer_retail_restaurant": r"restaurants?|retail stores?|\bstores\b|merchandise|apparel|grocer(?:y|ies)|e-?commerce retail|franchis",
    "bank": r"\bbank(?:ing)?\b|deposits|\bloans\b|net interest income|lending",
    "insurer": r"\binsurance\b|premiums|underwriting|policyholders?|reinsurance",
    "reit": r"real estate investment trust|\breit\b|rental income|tenants|leases? (?:of|to) (?:office|industrial|retail) (?:space|properties)",
    "energy_commodity": r"\boil\b|natural gas|crude|refin(?:ing|ery)|petroleum|\blng\b|upstream|mining|\bcopper\b|\bcoal\b",
    "pharma_biotech": r"pharmaceuticals?|\bdrugs?\b|therapeutics?|biologics?|clinical (?:trials?|stage)|vaccines?",
    "industrial": r"aerospace|defen[cs]e systems|machinery|industrial equipment|engines|construction equipment|manufactur(?:es|ing) (?:of )?(?:equipment|components)",
    "utility": r"\butilit(?:y|ies)\b|electricity generation|regulated (?:electric|gas)|transmission and distribution",
    "consumer_electronics": r"smartphones?|personal computers?|\blaptops?\b|tablets?|wearables?|headphones|televisions?|consumer electronics|game consoles?|smart home",
    "internet_media": r"advertising|search engine|social (?:network|media)|streaming|digital content|online marketplace|\bpublishing\b",
    "payments_fintech": r"payment (?:network|processing|services)|card (?:network|issuing)|merchant acquiring|\bfintech\b|interchange",
    "telecom": r"wireless|broadband|telecommunications|spectrum|cable television|fiber network",
}


def document_scale(packets: DataFrame, key: str, text: str) -> DataFrame:
    """The one scale a packet's headings state; null if there are several or none."""
    heads = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^(\[|--)"))
    found = F.array_distinct(F.filter(F.transform(heads, lambda x: F.lower(F.regexp_extract(x, SCALE, 1))), lambda x: x != ""))
    return packets.select(key, F.when(F.size(found) == 1, found[0]).alias("scale"))


def best_facts(lines: DataFrame) -> DataFrame:
    """One line for each label of a run: with a source before without, then the first."""
    rank = F.struct(F.when(F.col("source_tag").isNotNull(), 0).otherwise(1).alias("r"), "ord", "value")
    return lines.groupBy("run_id", "label").agg(F.min(rank).alias("x"), F.count("*").alias("copies")).select("run_id", "label", F.col("x.ord").alias("ord"), F.col("x.value").alias("value"), "copies")


def proportional_cap(lines: DataFrame, key: str, text: str, cap: int) -> DataFrame:
    """How much of each line stays if those of a key share ``cap`` characters in proportion to their length."""
    total = lines.groupBy(key).agg(F.sum(F.length(text)).alias("_total"))
    n = F.length(text)
    keep = F.when(F.col("_total") <= cap, n).otherwise(F.floor(n * F.lit(cap) / F.col("_total"))).cast("int")
    return lines.join(total, key).withColumn("keep", keep).drop("_total")


def excerpt(texts: DataFrame, key: str, text: str, budget: int) -> DataFrame:
    """Sentences of each text within a budget: those with figures up to one and a half times of it, then prose, in order."""
    s = texts.select(key, F.posexplode(split_sentences(F.col(text))).alias("pos", "sentence")).withColumn("figure", F.col("sentence").rlike(FIGURE))
    w = Window.partitionBy(key).orderBy(F.desc("figure"), "pos").rowsBetween(Window.unboundedPreceding, 0)
    run = s.withColumn("used", F.sum(F.length("sentence")).over(w))
    return run.filter(F.col("used") <= F.when(F.col("figure"), F.lit(budget * 3 // 2)).otherwise(F.lit(budget))).select(key, "pos", "figure")


def tagged_lines(lines: DataFrame, questions: DataFrame) -> DataFrame:
    """Lines that share words with a question of their run: ``run_id, ord, question, shared`` (two words, or one long one).

    The sides meet on (run, word), so only pairs with something in common are looked at.
    """
    a = lines.select("run_id", "ord", F.explode(words(F.col("label"))).alias("word"))
    b = questions.select("run_id", "question", F.explode(words(F.col("text"))).alias("word"))
    met = a.join(b, ["run_id", "word"]).groupBy("run_id", "ord", "question").agg(F.count("*").alias("shared"), F.max(F.length("word")).alias("longest"))
    return met.filter((F.col("shared") >= 2) | (F.col("longest") >= 7)).drop("longest")


def archetype(text: Column) -> Column:
    """The kind of business most of the vocabulary speaks of, the last by name on ties; null without a hit."""
    low = F.lower(text)
    hits = F.array(*[F.struct(F.regexp_count(low, F.lit(p)).alias("n"), F.lit(k).alias("kind")) for k, p in ARCHETYPES.items()])
    best = F.array_max(hits)
    return F.when(best["n"] > 0, best["kind"])


def headline_share(title: Column, text: Column) -> Column:
    """Share of a title's words that the first two sentences have."""
    lead = F.array_join(F.slice(split_sentences(text), 1, 2), " ")
    t = words(title)
    return F.when(F.size(t) > 0, F.size(F.array_intersect(t, words(lead))) / F.size(t))


def salvage(text: str) -> dict | None:
    """The members of a JSON object that stand whole before it breaks off."""
    body = re.sub(r"^\s*```\w*\s*", "", text)
    if not body.startswith("{"):
        return None
    dec, at, out = json.JSONDecoder(), 1, {}
    while True:
        m = re.compile(r"\s*,?\s*").match(body, at)
        try:
            k, at = dec.raw_decode(body, m.end())
            c = re.compile(r"\s*:\s*").match(body, at)
            if not isinstance(k, str) or not c:
                break
            v, at = dec.raw_decode(body, c.end())
        except ValueError:
            break
        if not re.compile(r"\s*[,}]").match(body, at):
            break  # a number may go on
        out[k] = v
    return out or None


def salvaged(records: DataFrame, key: str, text: str) -> DataFrame:
    """``key, fields``: names of the members saved from records that break off."""
    kind = dict(records.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(k, salvage(t)) for k, t in zip(b["k"], b["t"], strict=True) if t]
            yield pd.DataFrame([(k, ",".join(sorted(x))) for k, x in got if x], columns=["k", "fields"])

    return records.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, fields string").withColumnRenamed("k", key)


def deduped(claims: DataFrame, key: str, pos: str, text: str, same: float) -> DataFrame:
    """Claims of each key in order, without those like one kept before (Jaccard of words at least ``same``).

    A fold over the few claims of one key, inside the JVM.
    """
    one = claims.filter(F.col(text).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(F.struct(F.col(pos).alias("pos"), F.col(text).alias("text"), words(F.col(text)).alias("w")))).alias("_all"))
    none = F.slice("_all", 1, 0)

    def like(x: Column, y: Column) -> Column:
        union = F.size(F.array_union(x["w"], y["w"]))
        return (F.lower(F.trim(x["text"])) == F.lower(F.trim(y["text"]))) | (F.size(F.array_intersect(x["w"], y["w"])) >= F.lit(same) * union) & (union > 0)

    kept = F.aggregate("_all", none, lambda acc, x: F.when(F.exists(acc, lambda y: like(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    return one.select(key, F.explode(kept).alias("_kept")).select(key, F.col("_kept.pos").alias(pos), F.col("_kept.text").alias(text))


def like_titles(titles: DataFrame, key: str, title: str, same: float) -> DataFrame:
    """Pairs of distinct titles of a key whose words overlap (in the smaller set) by at least ``same``, once each.

    The smaller set must have one of its rarest words in common with the larger, so only those words of it are
    joined: candidates are exact without looking at all pairs.
    """
    one = titles.filter(F.col(title).isNotNull()).select(F.col(key).alias("key"), F.col(title).alias("title")).distinct().withColumn("w", words(F.col("title"))).filter(F.size("w") > 0)
    each = one.select("key", "title", F.explode("w").alias("word"))
    freq = each.groupBy("key", "word").agg(F.count("*").alias("n"))
    ranked = each.join(freq, ["key", "word"]).groupBy("key", "title").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("r"))
    need = F.size("r") - F.ceil(F.lit(same) * F.size("r")) + 1
    rare = ranked.select("key", "title", F.size("r").alias("size"), F.explode(F.slice("r", F.lit(1), need.cast("int"))).alias("word"))
    other = each.join(ranked.select("key", "title", F.size("r").alias("osize")), ["key", "title"]).select("key", "word", F.col("title").alias("other"), "osize")
    cand = rare.join(other, ["key", "word"]).filter((F.col("title") != F.col("other")) & ((F.col("size") < F.col("osize")) | ((F.col("size") == F.col("osize")) & (F.col("title") < F.col("other"))))).select("key", "title", "other").distinct()
    full = cand.join(one.select("key", "title", F.col("w").alias("a")), ["key", "title"]).join(one.select("key", F.col("title").alias("other"), F.col("w").alias("b")), ["key", "other"])
    share = F.size(F.array_intersect("a", "b")) / F.least(F.size("a"), F.size("b"))
    return full.withColumn("share", F.round(share, 6)).filter(share >= same).select("key", "title", "other", "share")


MARKERS = re.compile(r"(?i)\b(?P<ttm>ttm|trailing|last twelve months)\b|\b(?P<forward>forward|next (?:year|quarter)|guidance|outlook)\b|\b(?P<quarter>quarter|three months|q[1-4])\b|\b(?P<annual>annual|fiscal year|full[ -]year|fy ?\d{2,4}|a year ago|over the year)\b")


def nearest_marker(sentence: str, begin: int, end: int) -> str | None:
    """The period marker that goes with a figure: one that overlaps it, one joined to it right after, else the nearest before, else after."""
    found = [(m.start(), m.end(), m.lastgroup) for m in MARKERS.finditer(sentence)]
    for a, b, name in found:
        if a < end and begin < b:
            return name
    for a, _, name in found:
        if 0 <= a - end <= 40 and re.match(r"\s+(?:on|of|for|at|in|over)\b", sentence[end:a]):
            return name
    before = [(begin - b, name) for _, b, name in found if b <= begin]
    after = [(a - end, name) for a, _, name in found if a >= end]
    return min(before)[1] if before else min(after)[1] if after else None


def claim_periods(sentences: DataFrame, keys: list[str], sentence: str) -> DataFrame:
    """``claim, period`` of every figure of the sentences, by the nearest marker."""
    figure = re.compile(r"[$€£]?\d[\d,]*(?:\.\d+)?\s?(?:%|x\b|(?:trillion|billion|million)\b)?")
    kinds = dict(sentences.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                text = row[-1] or ""
                out += [(*row[:-1], m[0].strip(), nearest_marker(text, m.start(), m.end())) for m in figure.finditer(text)]
            yield pd.DataFrame(out, columns=[*keys, "claim", "period"])

    return sentences.select(*keys, sentence).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", claim string, period string")
