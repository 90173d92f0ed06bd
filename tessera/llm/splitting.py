"""Oversized items cut at natural boundaries, consecutive pieces overlapping.

A recursive hierarchy of separators (section, paragraph, line, sentence, word, character) breaks a text into
parts under the budget (limit less overlap); parts are then packed greedily up to it, and each piece but the
first is led by the last characters of its predecessor. Limits are in characters or UTF-8 bytes. A cut by
characters spares combining marks where it can. Sentences are those of ``sentences``, so an abbreviation ends none
and Thai is cut at its spaces.

Defined results: null and empty texts give no pieces; a text within its limit is one piece; an item without a
limit (no row of its form and no ``*`` row) is one piece; repeated rows are split once; the pieces' own parts
(``start_pos`` to ``end_pos``) put together are the text, exactly.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.session import bounded

from .sentences import sentence_ends

MAX_LIMITS = 10_000

SENTENCE = "sentence"
AFTER = re.compile(r"\s*")
#: Boundaries from strong to weak; each pattern ends where a cut may be made.
LEVELS = [
    re.compile(r"\n[ \t\r\xa0]*\n[ \t\r\xa0]*\n\s*|\n(?=#{1,6} )"),
    re.compile(r"\n[ \t\r\xa0]*\n\s*"),
    re.compile(r"\n"),
    SENTENCE,
    re.compile(r"\s+"),
]


def form_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^(?U)\s+|(?U)\s+$", ""))


def with_limits(sections: DataFrame, size_limits: DataFrame) -> DataFrame:
    """Sections with ``unit, max_size, overlap`` of their form, else of ``*``."""
    kind = size_limits.filter(F.lower(F.trim("item_kind")) == "section")
    named = kind.groupBy(form_key(F.coalesce("form", F.lit("*"))).alias("fk")).agg(F.min(F.struct("max_size", "overlap", "unit")).alias("lim"))  # of several, the smallest
    star = bounded(named.filter("fk = '*'").select(F.col("lim").alias("star")), 1)
    keyed = sections.withColumn("fk", form_key(F.col("form"))).join(bounded(named.filter("fk <> '*'"), MAX_LIMITS), "fk", "left").join(star, how="left")
    lim = F.coalesce("lim", "star")
    return keyed.select(*sections.columns, F.lower(F.trim(lim["unit"])).alias("unit"), lim["max_size"].alias("max_size"), lim["overlap"].alias("overlap"))


def size(text: Column, unit: Column) -> Column:
    return F.when(unit == "bytes", F.octet_length(text)).otherwise(F.char_length(text))


def split_text(text: str, max_size: int, overlap: int, in_bytes: bool) -> Iterator[tuple[int, int, int]]:
    """(begin, start, end) of each piece: its text is ``text[begin:end]``, its own part ``text[start:end]``."""
    if in_bytes:
        places = [0]
        for ch in text:
            o = ord(ch)
            places.append(places[-1] + (1 if o < 0x80 else 2 if o < 0x800 else 3 if o < 0x10000 else 4))
        at = places.__getitem__
    else:
        at = lambda i: i
    n = len(text)
    if at(n) <= max_size:
        if n:
            yield 0, 0, n
        return
    widest = 4 if in_bytes else 1
    overlap = max(0, min(overlap, max_size - widest))
    budget = max_size - overlap

    ends: list[int] = []

    def cuts(lo: int, hi: int, level: int) -> Iterator[int]:
        if LEVELS[level] != SENTENCE:
            for m in LEVELS[level].finditer(text, lo, hi):
                yield m.end()
            return
        if not ends:  # of the whole text, once
            ends.extend(AFTER.match(text, e).end() for e in sentence_ends(text))
            ends.append(n)
        yield from ends[bisect_right(ends, lo) : bisect_left(ends, hi)]

    def parts(lo: int, hi: int, level: int) -> Iterator[tuple[int, int]]:
        # recursion is as deep as there are levels, whatever the text
        if at(hi) - at(lo) <= budget:
            yield lo, hi
        elif level == len(LEVELS):
            while lo < hi:
                end = lo + 1
                if in_bytes:
                    while end < hi and at(end + 1) - at(lo) <= budget:
                        end += 1
                else:
                    end = min(hi, lo + max(1, budget))
                back = end
                while back < hi and back > lo + 1 and unicodedata.category(text[back]) in ("Mn", "Mc", "Me"):
                    back -= 1
                end = back if back > lo + 1 else end
                yield lo, end
                lo = end
        else:
            start = lo
            for at_ in cuts(lo, hi, level):
                if start < at_ < hi:
                    yield from parts(start, at_, level + 1)
                    start = at_
            if start < hi:
                yield from parts(start, hi, level + 1)

    start = end = 0
    begin = 0

    def lead(pos: int) -> int:
        b = pos
        while b > 0 and at(pos) - at(b - 1) <= overlap:
            b -= 1
        return b

    for lo, hi in parts(0, n, 0):
        if end > start and at(hi) - at(begin) > max_size:
            yield begin, start, end
            begin, start = lead(end), end
        end = hi
        assert lo >= start
    yield begin, start, end


def _spans(text: str, unit: str | None, most: float | None, overlap: float | None) -> Iterator[tuple[int, int, int]]:
    """``split_text`` under the limit of a row, which may have none."""
    most = len(text) * 4 if most is None or pd.isna(most) else int(most)
    return split_text(text, most, 0 if overlap is None or pd.isna(overlap) else int(overlap), unit == "bytes")


def oversized(sections: DataFrame, size_limits: DataFrame) -> DataFrame:
    """The sections larger than their limit, each once: those that are split, and those of one piece that is too large."""
    lim = with_limits(sections.select("section_id", "form", "text"), size_limits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = [sum(1 for _ in _spans(*row)) for row in zip(b.text, b.unit, b.max_size, b.overlap, strict=True)]
            yield pd.DataFrame({"section_id": b.section_id, "n_pieces": n, "too_large": b.too_large})

    large = size(F.col("text"), F.col("unit")) > F.col("max_size")
    rows = lim.filter(F.col("text") != "").withColumn("too_large", F.coalesce(large, F.lit(False)))
    split = rows.mapInPandas(run, "section_id bigint, n_pieces int, too_large boolean")
    return split.filter("n_pieces > 1 or too_large").select("section_id").distinct()


def pieces(sections: DataFrame, size_limits: DataFrame) -> DataFrame:
    """``section_id, piece_no, begin_pos, start_pos, end_pos, text``; positions are offsets in characters."""
    lim = with_limits(sections.select("section_id", "form", "text"), size_limits)
    once = lim.filter(F.col("text") != "").groupBy("section_id").agg(F.max(F.struct("text", "unit", "max_size", "overlap")).alias("x")).select("section_id", "x.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for sid, text, unit, most, overlap in zip(b.section_id, b.text, b.unit, b.max_size, b.overlap, strict=True):
                got = _spans(text, unit, most, overlap)
                out += [(sid, k, begin, start, end, text[begin:end]) for k, (begin, start, end) in enumerate(got, 1)]
            yield pd.DataFrame(out, columns=["section_id", "piece_no", "begin_pos", "start_pos", "end_pos", "text"])

    return once.mapInPandas(run, "section_id bigint, piece_no int, begin_pos int, start_pos int, end_pos int, text string")
