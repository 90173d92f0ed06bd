"""Numeric claims of texts traced to evidence lines: anchors, tracing, labels, sources, rounding, recomputation.

Evidence and claims are typed rows; every step is a join or an aggregation on the run and the canonical form
of a number, so nothing is re-parsed between steps. Claims of a run meet only the evidence of that run.

Defined results: null texts have no claims and null packets no lines; a claim without a canonical form is
untraced; repeated rows count once; empty tables give empty results.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import numbers as N, periods as P
from tessera.functions.text import headed_blocks

# Sections written by a model, line marks of failures, label words of percentages, phrases of advice, of
# disclaimers and of claimed absences, and marks of a failed extraction.
MODEL_SECTIONS = ["PROFILE", "KEY QUESTIONS", "WHAT WOULD MISLEAD", "COVERAGE GAPS", "DATA GAPS", "EVIDENCE QUALITY"]
FAILURES = r"(?i)could not find:|KPI value not found|^-?\s*COVERAGE GAP|\(limitation:"
PERCENT_WORDS = ["%", "percent", "margin", "rate", "ratio", "yield", "growth"]
ADVICE = ["investors should", "you should", "position siz", "prudent approach", "recommend buying", "recommend selling", "buy the stock", "sell the stock", "add to your", "trim your"]
DISCLAIMERS = ["not financial advice", "not investment advice", "does not constitute investment advice", "does not constitute financial advice", "for research purposes only", "research, not financial", "educational purposes"]
WITHHOLD = ["disclose", "provide", "report", "give", "publish", "break out", "quantify"]
ABSENT = ["not disclosed", "undisclosed", "no guidance", "no disclosure", "no figure", "no metric", "no number", "no such guidance", "no such disclosure", "no such figure", "no such metric", "no such number",
          "is absent", "absent from", "provides no", "offers no", "gives no", "has no guidance", "has no disclosure"]
FAILED = ["EXTRACTION FAILURE", "KPI value not found", "could not find:"]
SPLIT = r"(?<=[.!?])\s+(?=[A-Z0-9$(])"
ABSENCE = rf"(?i)\b(?:does not|doesn't|did not|do not|never) (?:{'|'.join(WITHHOLD)})|\b(?:{'|'.join(ABSENT)})\b"
PERCENT_LABEL = rf"(?i)^\s*-\s+(?!\[Q\d)[^:\"“]*(?:{'|'.join(PERCENT_WORDS)})[^:\"“]*:"
STATED_UNIT = r"(?i)\(?(?:units?:\s*|in\s+)(thousand|million|billion)s\b"


def evidence_lines(runs: DataFrame) -> DataFrame:
    """``run_id, ord, section, block, label, value, source_tag, line`` of every data line of the packets.

    Section and block headings are carried within the packet by a fold over its parts; repeated rows go after the
    lines are taken out, so no packet is shuffled as a whole.
    """
    parts = runs.filter(F.col("evidence").isNotNull()).select(F.col("id").alias("run_id"), F.explode(headed_blocks(F.col("evidence"))).alias("p"))
    rows = parts.select("run_id", "p.at", "p.section", "p.block", F.posexplode(F.split("p.body", "\n")).alias("pos", "line")).filter(F.col("line").startswith("- "))
    shape = r"^- ([^:]*): (.*?)(?:\s+\[source: ([^\]]*)\])?$"
    part = lambda i: F.regexp_extract("line", shape, i)
    return rows.select("run_id", (F.col("at") + F.col("pos") + 1).alias("ord"), "section", "block", part(1).alias("label"), part(2).alias("value"), F.nullif(part(3), F.lit("")).alias("source_tag"), "line").distinct()


def tracing_lines(lines: DataFrame) -> DataFrame:
    """The lines a claim may be traced to: no model-written sections, no notes of failure."""
    return lines.filter(~F.coalesce(F.upper("section").isin(MODEL_SECTIONS), F.lit(False)) & ~F.col("line").rlike(FAILURES))


def anchors(lines: DataFrame) -> DataFrame:
    """``run_id, ord, canon``: every number of the lines in canonical form, and in the forms a claim may give it.

    The percent form where the label or the word after the number says so, the scaled one where the line states its unit
    and the number has separators.
    """
    each = lines.select("run_id", "ord", F.col("line").rlike(PERCENT_LABEL).alias("share"), F.lower(F.regexp_extract("line", STATED_UNIT, 1)).alias("unit"), F.explode(N.figures(F.col("line"))).alias("raw"))
    raw, canon = F.col("raw"), F.col("canon")
    one = each.withColumn("canon", N.canonical(raw)).filter(canon.isNotNull())
    unscaled = ~raw.rlike(rf"(?i)\d\s?{N.SCALE}$")
    percent = F.when(~canon.endswith("%") & (raw.rlike("(?i)percent$") | (F.col("share") & unscaled & ~canon.contains("["))), F.concat(canon, F.lit("%")))
    grouped = raw.rlike(r"^\$?\s?\d{1,3}(?:,\d{3})+(?:\.\d+)?$") & (F.col("unit") != "")
    scaled = F.when(grouped, N.canonical(F.concat_ws(" ", raw, "unit")))
    return one.select("run_id", "ord", F.explode(F.array_compact(F.array(canon, percent, scaled))).alias("canon")).distinct()


def text_claims(turns: DataFrame) -> DataFrame:
    """``run_id, turn_id, pos, claim`` of the numeric claims of messages, each once ignoring case, at its first place.

    A text is scanned once; mentions become claims row by row, and repeated rows go then, so no text is shuffled.
    """
    said = turns.filter(F.col("text").isNotNull()).select("run_id", F.col("id").alias("turn_id"), F.posexplode(N.mentions(F.col("text"))).alias("pos", "mention"))
    got = said.select("run_id", "turn_id", "pos", F.explode(F.array_compact(F.array(N.as_claim(F.col("mention"))))).alias("claim"))
    first = got.groupBy("run_id", "turn_id", F.lower("claim").alias("low")).agg(F.min(F.struct("pos", "claim")).alias("x"))
    return first.select("run_id", "turn_id", "x.pos", "x.claim")


def trace(claims: DataFrame, marks: DataFrame) -> DataFrame:
    """``status`` CITED or FLAGGED of each claim: every canonical form it has is an anchor of its run."""
    need = claims.select("run_id", "turn_id", "claim", F.explode(N.claim_forms(F.col("claim"))).alias("canon"))
    known = marks.select("run_id", "canon", F.lit(1).alias("hit")).distinct()
    met = need.join(known, ["run_id", "canon"], "left")
    return met.groupBy("run_id", "turn_id", "claim").agg(F.when(F.min(F.coalesce("hit", F.lit(0))) == 1, "CITED").otherwise("FLAGGED").alias("status"))


def grounding(traced: DataFrame, *by: str) -> DataFrame:
    """Share of claims cited, in percent; 100 where there are none."""
    n, c = F.count("*"), F.count_if(F.col("status") == "CITED")
    return traced.groupBy(*by).agg(n.alias("claims"), c.alias("cited"), F.round(F.when(n == 0, 100.0).otherwise(c * 100.0 / n), 2).alias("grounding_pct"))


def figure_sources(claims: DataFrame, lines: DataFrame) -> DataFrame:
    """The best line of each claim that holds all its forms: sourced lines, then others, then news, then the first."""
    news = F.coalesce(F.upper("section").startswith("NEWS"), F.lit(False))
    ranked = lines.select("run_id", "ord", "line", F.when(news, 2).when(F.col("source_tag").isNotNull(), 0).otherwise(1).alias("rank"))
    need = claims.select("run_id", "claim", N.claim_forms(F.col("claim")).alias("forms")).distinct()
    met = need.select("run_id", "claim", F.size("forms").alias("n"), F.explode("forms").alias("canon")).join(anchors(lines), ["run_id", "canon"])
    whole = met.groupBy("run_id", "claim", "ord", "n").agg(F.count_distinct("canon").alias("k")).filter("k = n")
    best = whole.join(ranked, ["run_id", "ord"]).groupBy("run_id", "claim").agg(F.min(F.struct("rank", "ord", "line")).alias("best"))
    return best.select("run_id", "claim", F.col("best.ord").alias("ord"), F.col("best.rank").alias("rank"), F.col("best.line").alias("line"))


def mislabeled(claims: DataFrame, lines: DataFrame, *keys: str) -> DataFrame:
    """Claims whose period conflicts with that of every evidence label of the same number.

    ``claims`` has ``run_id, claim, context`` and perhaps further keys. Labels without a period never conflict.
    """
    by = ["run_id", *keys, "claim", "context"]
    marks = lines.select("run_id", "label", F.explode(N.figures(F.col("value"))).alias("raw")).select("run_id", N.canonical(F.col("raw")).alias("canon"), P.period_class(F.col("label"), changes=False).alias("label_period"))
    need = claims.select(*by, N.canonical(F.col("claim")).alias("canon"), P.period_class(F.col("context"), changes=False).alias("claim_period")).filter(~F.col("claim_period").isin("unstated", "period ended")).distinct()
    met = need.join(marks, ["run_id", "canon"]).withColumn("clash", P.conflict(F.col("claim_period"), F.col("label_period")))
    return met.groupBy(*by, "claim_period").agg(F.min(F.col("clash").cast("int")).alias("all_clash"), F.count("*").alias("labels")).filter("all_clash = 1").drop("all_clash")


def rounded_sources(claims: DataFrame, values: DataFrame) -> DataFrame:
    """Claims (``key, claim_value, digits``) that are an honest rounding of a value (``key, value``) of their key."""
    return claims.join(values, "key").filter(F.abs(F.col("value") - F.col("claim_value")) <= F.pow(F.lit(10.0), -F.col("digits")) / 2 + 1e-9).groupBy("key", "claim_value", "digits").agg(F.min("value").alias("source_value"))


def recompute(claims: DataFrame, values: DataFrame) -> DataFrame:
    """Derived figures recomputed from the ordered pairs of their own anchors.

    ``claims`` has ``key, claim_value, is_percent, digits``, ``values`` ``key, value``: the few anchors a claim
    names, so pairs are those of one claim, not of a group of rows. The best candidate and whether it is within
    tolerance come out.
    """
    pairs = values.alias("a").join(values.alias("b"), "key").select("key", F.col("a.value").alias("a"), F.col("b.value").alias("b")).filter("a <> b and b <> 0")
    got = claims.join(pairs, "key")
    ratio = F.col("a") / F.col("b")
    forms = F.when(F.col("is_percent"), F.array(F.abs(ratio - 1) * 100, F.abs(F.col("a") - F.col("b")))).otherwise(F.array(F.abs(ratio), F.abs(F.col("a") - F.col("b")), F.col("a") * F.col("b")))
    tried = got.select("key", "claim_value", "is_percent", "digits", F.explode(forms).alias("implied")).withColumn("err", F.abs(F.col("implied") - F.col("claim_value")))
    half = F.pow(F.lit(10.0), -F.col("digits")) / 2
    tolerance = F.when(F.col("is_percent"), F.greatest(F.lit(0.15), half)).otherwise(F.greatest(F.abs(F.col("claim_value")) * 0.005, half, F.lit(0.01)))
    best = tried.groupBy("key", "claim_value", "is_percent", "digits").agg(F.min(F.struct("err", "implied")).alias("best"))
    return best.select("key", "claim_value", F.col("best.implied").alias("implied"), (F.col("best.err") <= tolerance).alias("ok"))


def sentences_of(turns: DataFrame) -> DataFrame:
    """``turn_id, pos, sentence`` of the texts; repeated rows go after the split, so no text is shuffled."""
    said = turns.filter(F.col("text").isNotNull()).select(F.col("id").alias("turn_id"), F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    return said.distinct()


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SPLIT), lambda x: F.trim(x)), lambda x: x != "")


def has_any(text: Column, phrases: list[str]) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: low.contains(p))


def screened(text: Column) -> Column:
    """array<string> of the sentences before the first that disclaims; a fold over the sentences of one text."""
    all_ = sentences(text)
    first = F.array_position(F.transform(all_, lambda x: has_any(x, DISCLAIMERS)), F.lit(True))
    return F.when(first == 0, all_).otherwise(F.slice(all_, F.lit(1), F.greatest(first.cast("int") - 1, F.lit(0))))


def advice(turns: DataFrame) -> DataFrame:
    """``turn_id, pos, sentence``: sentences of advice before the disclaimer of their text."""
    said = turns.filter(F.col("text").isNotNull()).select(F.col("id").alias("turn_id"), F.posexplode(screened(F.col("text"))).alias("pos", "sentence"))
    return said.filter(has_any(F.col("sentence"), ADVICE)).distinct()


def failing_runs(runs: DataFrame, marks: list[str] = FAILED) -> DataFrame:
    """``run_id`` of the runs whose packet records that something was not found or not read."""
    return runs.filter(F.col("evidence").rlike("|".join(marks))).select(F.col("id").alias("run_id")).distinct()


def is_absence(sentence: Column) -> Column:
    return sentence.rlike(ABSENCE) & ~F.lower(sentence).contains("not retrieved") & ~sentence.contains("UNKNOWN, NOT ABSENT")


def absences(turns: DataFrame, runs: DataFrame, marks: list[str] = FAILED) -> DataFrame:
    """``turn_id, pos, sentence``: claims that something is not disclosed, in runs whose packet records a failure."""
    said = turns.filter("text is not null").join(failing_runs(runs, marks), "run_id", "left_semi")
    return sentences_of(said).filter(is_absence(F.col("sentence")))


def stamped(traced: DataFrame, turns: DataFrame) -> DataFrame:
    """Each text with its flagged claims tagged, longest claim first, never inside a number or a tag: ``turn_id, text, tags``.

    The claims of one text are its own few; a text is rewritten in one pass of an Arrow function.
    """
    flagged = traced.filter("status = 'FLAGGED'").groupBy("turn_id").agg(F.sort_array(F.collect_set("claim")).alias("bad"))

    @F.pandas_udf("string")
    def tag(text: pd.Series, bad: pd.Series) -> pd.Series:
        def one(t, claims):  # noqa: ANN001, ANN202
            if t is None or claims is None or not len(claims):
                return t
            rx = re.compile(r"(?<![\d.\-–])(?:" + "|".join(re.escape(c) for c in sorted(claims, key=len, reverse=True)) + r")(?![A-Za-z0-9_%])")
            return "".join(p if p.startswith("[") else rx.sub(lambda m: m[0] + " [UNGROUNDED]", p) for p in re.split(r"(\[[^\]]*\])", t))

        return pd.Series([one(t, b) for t, b in zip(text, bad, strict=True)])

    said = turns.filter(F.col("text").isNotNull()).groupBy(F.col("id").alias("turn_id")).agg(F.max("text").alias("text"))
    return said.join(flagged, "turn_id").select("turn_id", tag("text", "bad").alias("text"), F.size("bad").alias("tags"))
