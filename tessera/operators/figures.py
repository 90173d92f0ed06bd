"""Statement figures: HTML tables to typed records, units and periods of rows, label matching, derived lines.

``parse_tables`` reads layout as a grid of columns: a value belongs to the headings whose columns it overlaps,
stacked headings join from top to bottom, a row of one text over the whole width is a group, and a table
without headings right after one that has them takes them over. It runs as an Arrow function on whole pages;
what follows are expressions and joins.

Defined results: null and broken HTML gives no records; cells that are no figures are left out; a row without
figures is a group; repeated pages are parsed each; empty tables give empty results.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tessera.functions.text import jaccard, words

FIGURE = re.compile(r"\(?[-+]?[$€£]?\s?\(?\d[\d,]*(?:\.\d+)?\)?\s?%?x?\Z")
BLOCKS = {"p", "div", "br", "li", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "ul", "ol"}
SKIPPED = {"script", "style", "nav", "footer", "header", "aside", "form", "noscript", "head", "svg"}
PERIOD = re.compile(r"(?i)\b(?:months?|weeks?|quarter|year|ended|ttm|ytd|q[1-4]|fy ?\d{2,4}|(?:19|20)\d\d|january|february|march|april|may|june|july|august|september|october|november|december|growth|change|%)\b|%")
UNITS = re.compile(r"(?i)\bin (thousands|millions|billions)\b")
CURRENCY = re.compile(r"(?i)\b(USD|EUR|GBP|JPY|TWD|INR|CHF|KRW|US dollars?|euros?)\b")


class _Grid(HTMLParser):
    """Tables as rows of (first column, last column + 1, text), and the text before each."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[tuple[str, list[list[tuple[int, int, str]]]]] = []
        self.before: list[str] = []
        self.depth = 0
        self.rows: list[list[tuple[int, int, str]]] = []
        self.row: list[tuple[int, int, str]] | None = None
        self.cell: list[str] | None = None
        self.span, self.col, self.skip = 1, 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SKIPPED:
            self.skip += 1
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.rows = []
        elif tag == "tr" and self.depth == 1:
            self.row, self.col = [], 0
        elif tag in ("td", "th") and self.row is not None and self.depth == 1:
            raw = dict(attrs).get("colspan") or "1"
            self.span = min(1000, int(raw)) if raw.strip().isdigit() and int(raw) else 1
            self.cell = []
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED and self.skip:
            self.skip -= 1
        if tag in ("td", "th") and self.cell is not None and self.row is not None:
            text = " ".join("".join(self.cell).split())
            if text:
                self.row.append((self.col, self.col + self.span, text))
            self.col += self.span
            self.cell = None
        elif tag == "tr" and self.row is not None and self.depth == 1:
            if self.row:
                self.rows.append(self.row)
            self.row = None
        elif tag == "table" and self.depth:
            self.depth -= 1
            if self.depth == 0:
                lead = [x for x in (" ".join(b.split()) for b in self.before[-6:]) if x]
                self.tables.append((lead[-1] if lead else "", self.rows))
                self.before = []

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.cell is not None:
            self.cell.append(data)
        elif self.depth == 0 and data.strip():
            self.before.append(data)


def _merge_signs(row: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """A currency sign, bracket or percent sign in a cell of its own joins the figure beside it."""
    out: list[tuple[int, int, str]] = []
    lead: tuple[int, int, str] | None = None
    for a, b, t in row:
        if t in ("$", "€", "£", "(", "$("):
            lead = (a, b, t)
        elif t in ("%", ")", ")%", "x") and out and out[-1][2][-1:].isdigit():
            out[-1] = (out[-1][0], b, out[-1][2] + t)
        else:
            out.append((lead[0], b, lead[2] + t) if lead and FIGURE.match(lead[2].strip("(") + t) else (a, b, t))
            lead = None
    return out


def parse_tables(page: str | None) -> list[dict]:
    """The records of a page: ``tbl, row, caption, units, currency, grp, label, cells`` with (heading, value) cells."""
    if not page:
        return []
    g = _Grid()
    try:
        g.feed(page)
        g.close()
    except Exception:  # noqa: BLE001 - a page that can't be read has no tables
        return []
    out: list[dict] = []
    last: dict[tuple[int, int], str] = {}
    for tbl, (lead, raw) in enumerate(g.tables):
        rows = [_merge_signs(r) for r in raw]
        width = max((b for r in rows for _, b, _ in r), default=0)
        heads: dict[tuple[int, int], str] = {}
        grp, own, caption = None, False, lead
        text = lead
        body = False
        for n, r in enumerate(rows):
            figures = [c for c in r if FIGURE.match(c[2]) and not re.fullmatch(r"(?:19|20)\d\d", c[2])]
            if not figures:
                over = [c for c in r if c[0] > 0 or (c[1] - c[0] < width and len(r) > 1)]
                if over and all(PERIOD.search(c[2]) or re.fullmatch(r"(?:19|20)\d\d", c[2]) for c in over):
                    if body or not own:
                        heads, own, body = {}, True, False
                    stacked = set()
                    for a, b, t in over:
                        under = [k for k in heads if k[0] < b and a < k[1]]
                        narrow = [k for k in under if k[0] <= a and b <= k[1]]
                        heads[a, b] = " ".join([*(heads[k] for k in narrow[:1]), t]).strip() if narrow else t
                        stacked.update(k for k in narrow[:1] if k != (a, b))
                    for k in stacked:  # what was taken into the headings below serves no more itself
                        del heads[k]
                    text += " " + " ".join(c[2] for c in r)
                elif len(r) == 1:
                    if UNITS.search(r[0][2]) or r[0][2].startswith("("):
                        text += " " + r[0][2]
                    else:
                        grp = r[0][2].rstrip(":")
                else:
                    text += " " + " ".join(c[2] for c in r)
                continue
            body = True
            label = next((t for a, _, t in r if a == 0 and not FIGURE.match(t)), "")
            used = heads if own else last
            cells = []
            for a, b, t in figures:
                cover = [(min(b, k[1]) - max(a, k[0]), -(k[1] - k[0]), k) for k in used if k[0] < b and a < k[1]]
                cells.append((used[max(cover)[2]] if cover else "", t))
            u, c = UNITS.search(text), CURRENCY.search(text)
            out.append({"tbl": tbl, "row": n, "caption": caption, "units": u[1].lower() if u else None, "currency": c[1].upper() if c else None, "grp": grp, "label": re.sub(r"\s*\(\d+\)$", "", label), "cells": cells})
            if label.lower().startswith("total"):
                grp = None
        if own:
            last = heads
    return out


RECORD = "tbl int, row int, caption string, units string, currency string, grp string, label string, heading string, value string"


def table_records(pages: DataFrame, key: str, page: str) -> DataFrame:
    """One row per figure of every table of the pages, in long form."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, r["tbl"], r["row"], r["caption"], r["units"], r["currency"], r["grp"], r["label"], h, v) for k, p in zip(b["k"], b["p"], strict=True) for r in parse_tables(p) for h, v in r["cells"]]
            yield pd.DataFrame(rows, columns=["k", "tbl", "row", "caption", "units", "currency", "grp", "label", "heading", "value"])

    kind = dict(pages.dtypes)[key]
    return pages.select(F.col(key).alias("k"), F.col(page).alias("p")).mapInPandas(run, f"k {kind}, {RECORD}").withColumnRenamed("k", key)


def html_text(page: str | None, tables: bool = True) -> str:
    """Text of a page, a line per block; scripts, navigation and (on wish) tables are left out."""
    if not page:
        return ""
    out: list[str] = []
    skip: list[str] = []

    class Reader(HTMLParser):
        def handle_starttag(self, tag: str, attrs: list) -> None:
            if tag in SKIPPED or (tag == "table" and not tables):
                skip.append(tag)
            elif tag in BLOCKS:
                out.append("\n")
            elif tag in ("td", "th"):
                out.append(" ")

        def handle_endtag(self, tag: str) -> None:
            if skip and tag == skip[-1]:
                skip.pop()
            elif tag in BLOCKS:
                out.append("\n")

        def handle_data(self, data: str) -> None:
            if not skip:
                out.append(re.sub(r"\s+", " ", data))

    r = Reader(convert_charrefs=True)
    r.feed(_html.unescape(page) if "&lt;" in page and "<" not in page else page)
    r.close()
    lines = [re.sub(r" {2,}", " ", x).strip() for x in "".join(out).split("\n")]
    return "\n".join(x for x in lines if x and not re.fullmatch(r"(?:page )?\d{1,4}(?: of \d+)?", x, re.I))


@F.pandas_udf(T.StringType())
def html_to_text(page: pd.Series) -> pd.Series:
    return pd.Series([html_text(p) if p is not None else None for p in page])


def row_units(label: Column, group: Column, value: Column, units: Column) -> Column:
    """per share before percent before a scale in the label before counts before the table's units."""
    both = F.concat_ws(" ", label, group)
    return (
        F.when(both.rlike(r"(?i)per share|per diluted share|\beps\b"), "per share")
        .when(value.rlike("%") | label.rlike(r"(?i)%|percent|\bmargin\b|\brate\b"), "percent")
        .when(label.rlike(r"(?i)in (thousands|millions|billions)"), F.lower(F.regexp_extract(label, r"(?i)in (thousands|millions|billions)", 1)))
        .when(label.rlike(r"(?i)\b(number of|count|employees|stores|restaurants|units|subscribers)\b"), "count")
        .otherwise(units)
    )


# Row labels that tell kinds of statements.
KIND_WORDS = {"income": r"(?i)revenue|net sales|gross profit|operating income|net income", "cash": r"(?i)operating activities|investing activities|financing activities|capital expenditures?", "balance": r"(?i)total assets|total liabilities|total equity|total current"}


def table_kinds(records: DataFrame, key: str) -> DataFrame:
    """Kinds of each table: those of which at least two rows speak."""
    hits = [F.count_distinct(F.when(F.col("label").rlike(p), F.col("row"))).alias(k) for k, p in KIND_WORDS.items()]
    g = records.groupBy(key, "tbl").agg(*hits)
    return g.select(key, "tbl", F.array_compact(F.array(*[F.when(F.col(k) >= 2, F.lit(k)) for k in KIND_WORDS])).alias("kinds"))


def best_label(wanted: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """The row label most like each wanted name, at least ``least``: ``name, label, score``.

    Names meet labels by shared words (an equi-join), so only pairs with something in common are scored.
    """
    w = wanted.select("name").distinct().withColumn("wa", words(F.col("name")))
    r = rows.select("label").distinct().withColumn("wb", words(F.col("label")))
    rare = r.select("label", F.explode("wb").alias("word"))
    pairs = w.select("name", "wa", F.explode("wa").alias("word")).join(rare, "word").select("name", "label").distinct().join(w, "name").join(r, "label")
    score = F.when(F.lower(F.trim("name")) == F.lower(F.trim("label")), 1.0).when(F.lower("label").contains(F.lower("name")) | F.lower("name").contains(F.lower("label")), 0.9).otherwise(jaccard(F.col("wa"), F.col("wb")))
    top = pairs.withColumn("score", F.round(score, 6)).filter(F.col("score") >= least)
    return top.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), "label")).alias("x")).select("name", F.col("x.label").alias("label"), (-F.col("x.s")).alias("score"))


def carry_headings(lines: DataFrame, key: str, at: str, is_heading: Column, heading: Column, most: int) -> DataFrame:
    """Each line with the nearest heading above, which serves at most ``most`` lines."""
    w = Window.partitionBy(key).orderBy(at)
    g = lines.withColumns({"_h": F.last(F.when(is_heading, heading), ignorenulls=True).over(w), "_g": F.sum(is_heading.cast("int")).over(w), "_is": is_heading})
    n = F.sum((~F.col("_is")).cast("int")).over(Window.partitionBy(key, "_g").orderBy(at))
    return g.withColumn("heading", F.when(n <= most, F.col("_h"))).filter(~F.col("_is")).drop("_h", "_g", "_is")
