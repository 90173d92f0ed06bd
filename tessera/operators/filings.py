"""Filing histories: columnar indexes to rows, roles and filer types, newest filings, sections and exhibits.

Defined results: null forms have no role; arrays of unequal length give nulls at their end; filings without a
date are never the newest; repeated rows count once; empty histories give empty results.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

ANNUAL, INTERIM, CURRENT = ("10-K", "20-F", "40-F"), ("10-Q",), ("8-K", "6-K")
# Patterns of exhibit names, from the likeliest results release down.
EXHIBITS = [r"(?i)ex.?99.?1", r"(?i)press|release|earnings", r"(?i)ex.?99", r"(?i)exhibit"]
MONTHLY = r"(?i)monthly revenue|revenue report|revenues? for (january|february|march|april|may|june|july|august|september|october|november|december)"
QUARTER = r"(?i)\b(first|second|third|fourth) quarter\b|\b[1-4]q\d\d\b|\bq[1-4]\b|three months ended"
RESULTS = r"(?i)\b(revenues?|net income|net sales|net profit|earnings|eps|gross margin)\b"
INDEX = "struct<form:array<string>,accessionNumber:array<string>,filingDate:array<string>,primaryDocument:array<string>,items:array<string>>"


def index_rows(df: DataFrame, json: str, *keep: str) -> DataFrame:
    """Rows of a columnar filing index: parallel arrays zipped and exploded with their place (newest first)."""
    x = F.from_json(json, INDEX)
    zipped = F.arrays_zip(x["form"].alias("form"), x["accessionNumber"].alias("accession"), x["filingDate"].alias("filing_date"), x["primaryDocument"].alias("primary_doc"), x["items"].alias("items"))
    return df.select(*keep, F.posexplode(zipped).alias("pos", "z")).select(*keep, "pos", "z.form", "z.accession", F.col("z.filing_date").try_cast("date").alias("filing_date"), "z.primary_doc", "z.items")


def merge_older(recent: DataFrame, older: DataFrame) -> DataFrame:
    """Recent and older pages as one history; a filing on both counts once (the recent copy)."""
    both = recent.withColumn("_page", F.lit(0)).unionByName(older.withColumn("_page", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("accession", "_page")]
    return both.groupBy("accession").agg(F.min(F.struct("_page", *rest)).alias("x")).select("accession", *[F.col("x")[c].alias(c) for c in rest])


def base_form(form: Column) -> Column:
    """The form without its amendment mark, in capitals."""
    return F.upper(F.trim(F.substring_index(F.regexp_replace(form, r"(?U)\s+", " "), "/", 1)))


def role(form: Column) -> Column:
    b = base_form(form)
    return F.when(b.isin(*ANNUAL), "annual").when(b.isin(*INTERIM), "interim").when(b.isin(*CURRENT), "current")


def filer_types(filings: DataFrame) -> DataFrame:
    """US, foreign or Canadian by the newest annual form; ``none`` without periodic reports."""
    b = base_form(F.col("form"))
    f = filings.filter(F.col("ticker").isNotNull()).select("ticker", "filing_date", "accession", b.alias("b")).distinct()
    newest = f.groupBy("ticker").agg(F.max(F.when(F.col("b").isin(*ANNUAL) & F.col("filing_date").isNotNull(), F.struct("filing_date", "accession", "b")))["b"].alias("b"), F.max(F.col("b").isin("10-K", "10-Q", "20-F", "40-F", "6-K").cast("int")).alias("periodic"))
    kind = F.when(F.col("b") == "10-K", "us").when(F.col("b") == "20-F", "foreign").when(F.col("b") == "40-F", "canadian").when(F.col("periodic") == 1, "unclear").otherwise("none")
    return newest.select("ticker", kind.alias("filer_type"))


def newest(filings: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` filings of each ticker and form. A rank filter, so each task keeps only its own top rows."""
    f = filings.filter("ticker is not null and filing_date is not null").select("ticker", base_form(F.col("form")).alias("form"), "filing_date", "accession").distinct()
    w = Window.partitionBy("ticker", "form").orderBy(F.desc("filing_date"), F.desc("accession"))
    return f.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n)


def report_kind(text: Column) -> Column:
    """What a current report is: monthly figures before a quarter's results before any other."""
    return F.when(text.rlike(MONTHLY), "monthly").when(text.rlike(QUARTER) & (F.regexp_count(text, F.lit(RESULTS)) >= 2), "quarterly").when(text.rlike(RESULTS), "interim").otherwise("other")


def exhibit_rank(name: Column) -> Column:
    return F.coalesce(*[F.when(name.rlike(p), F.lit(i)) for i, p in enumerate(EXHIBITS)], F.lit(len(EXHIBITS)))


def longest_section(text: Column, start: str, end: str) -> Column:
    """The longest span between a start heading and the next end heading, so a table of contents never wins."""
    spans = F.regexp_extract_all(text, F.lit(rf"(?is)(?:{start})(.*?)(?=(?:{start})|(?:{end})|\z)"), F.lit(1))
    return F.aggregate(spans, F.lit(""), lambda best, x: F.when(F.length(F.trim(x)) > F.length(best), F.trim(x)).otherwise(best))


# The narrative sections of each annual and interim form, by the heading that begins a line, and the least
# characters a section has (shorter ones are lines of the table of contents). A section ends at the next item's heading.
SECTIONS = {
    "10-K": [("Item 1", r"item\s+1(?![0-9a-c])\b", 500), ("Item 1A", r"item\s+1a\b", 500), ("Item 7", r"item\s+7\b", 500)],
    "10-Q": [("Item 2 (10-Q MD&A)", r"item\s+2\.?\s*[:\-]?\s*management", 500), ("Item 1A (10-Q update)", r"item\s+1a\b", 300)],
    "20-F": [("Item 4 (Information on the Company)", r"item\s+4\b(?!\s*a)", 500), ("Item 5 (Operating and Financial Review)", r"item\s+5\b", 500)],
}
ITEM = re.compile(r"(?im)^[ \t ]*item\s+\d{1,2}\s?[a-c]?\b")
HEADING = 20
CAPTION_WORDS = (6, 60)


def sections_of(form: str, text: str) -> list[tuple[str, str | None]]:
    """(section, text) of a filing's text, the longest span from a heading to the next item; None where none is long enough."""
    ends = [m.start() for m in ITEM.finditer(text)]
    out: list[tuple[str, str | None]] = []
    for name, start, least in SECTIONS.get(form, []):
        best = ""
        for m in re.finditer(rf"(?im)^[ \t ]*{start}", text):
            i = bisect_right(ends, m.start() + HEADING)
            span = text[m.start() : ends[i] if i < len(ends) else len(text)].strip()
            best = span if len(span) > len(best) else best
        out.append((name, best if len(best) >= least else None))
    return out


def form_sections(pages: DataFrame, key: str, form: str, text: str) -> DataFrame:
    """``key, section, text, reason``: the narrative sections of each filing by its form; a reason where one wasn't located.

    Null texts and forms without narrative sections give no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(k, name, body, None if body else f"not located in this {f}") for k, f, t in zip(b["k"], b["f"], b["t"], strict=True) if t for name, body in sections_of(f, t)]
            yield pd.DataFrame(got, columns=["k", "section", "text", "reason"])

    some = pages.select(F.col(key).alias("k"), base_form(F.col(form)).alias("f"), F.col(text).alias("t"))
    return some.mapInPandas(run, f"k {dict(pages.dtypes)[key]}, section string, text string, reason string").withColumnRenamed("k", key)


class _Emphasis(HTMLParser):
    """Collects the texts of emphasised runs of a page, in order."""

    TAGS = ("b", "strong", "i", "em")
    STYLED = ("span", "p", "div")
    VOID = ("br", "hr", "img", "meta", "input", "link")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str] | None]] = []
        self.runs: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.VOID:
            return
        style = (dict(attrs).get("style") or "").replace(" ", "").lower()
        bold = tag in self.TAGS or (tag in self.STYLED and ("font-weight:700" in style or "font-weight:bold" in style))
        self.open.append((tag, [] if bold else None))

    def handle_data(self, data: str) -> None:
        for _, held in self.open:
            if held is not None:
                held.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag not in [t for t, _ in self.open]:
            return
        while self.open:
            name, held = self.open.pop()
            if held is not None:
                self.runs.append(re.sub(r"\s+", " ", " ".join(held).replace("\xa0", " ")).strip())
            if name == tag:
                break


def captions_of(page: str, section: str) -> list[str]:
    """The emphasised sentences of a page that stand in a section's text, in order, each once."""
    e = _Emphasis()
    e.feed(page)
    e.close()
    held = re.sub(r"\s+", " ", section.replace("\xa0", " "))
    lo, hi = CAPTION_WORDS
    return list(dict.fromkeys(x for x in e.runs if lo <= len(x.split()) <= hi and x.endswith((".", "?")) and x in held))


def risk_captions(pages: DataFrame, key: str, page: str, section: str) -> DataFrame:
    """``key, pos, caption``: the titles of risks, which only the markup of the page tells apart from their text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(k, i, c) for k, p, s in zip(b["k"], b["p"], b["s"], strict=True) if p and s for i, c in enumerate(captions_of(p, s), 1)]
            yield pd.DataFrame(got, columns=["k", "pos", "caption"])

    some = pages.select(F.col(key).alias("k"), F.col(page).alias("p"), F.col(section).alias("s"))
    return some.mapInPandas(run, f"k {dict(pages.dtypes)[key]}, pos int, caption string").withColumnRenamed("k", key)


def without_header(text: Column) -> Column:
    """The text of an exhibit without the line of its document header (``EX-99.1 2 name.htm``)."""
    return F.regexp_replace(text, r"(?i)^\s*ex-?\d+(\.\d+)?\s+\d+\s+\S+\.html?\s*", "")


def overview(text: Column, limit: int) -> Column:
    """The opening paragraphs of a section within ``limit`` characters, without headings; one that is too long ends at a sentence."""
    paras = F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(F.trim(p), r"(?i)^(?:item\s+1\.?\s*)?(?:business\.?\s*)?(?:overview|general|introduction)?\.?\s*", "")))
    body = F.filter(paras, lambda p: F.size(F.split(p, r"\s+")) > 8)
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("full"), F.lit("").alias("text"))

    def step(got: Column, p: Column) -> Column:
        full = got["full"] | ((got["n"] > 0) & (got["n"] + F.length(p) > limit))
        return F.when(full, F.struct(got["n"].alias("n"), F.lit(True).alias("full"), got["text"].alias("text"))).otherwise(
            F.struct((got["n"] + F.length(p)).alias("n"), F.lit(False).alias("full"), F.concat_ws("\n\n", F.nullif(got["text"], F.lit("")), p).alias("text"))
        )

    joined = F.aggregate(body, start, step, lambda got: got["text"])
    head = F.substring(joined, 1, limit)
    whole = F.regexp_extract(head, r"(?s)^(.*[.!?])(?:\s|$)", 1)
    return F.when(F.length(joined) <= limit, joined).when(whole != "", whole).otherwise(head)
