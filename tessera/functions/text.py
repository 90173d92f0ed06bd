"""Text expressions: words, overlaps, sentence windows, trimming. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that carry no topic.
STOP = ["the", "a", "an", "of", "and", "in", "to", "for", "on", "at", "by", "with", "as", "is", "was", "were", "are", "it", "its", "that", "this", "or", "from", "be"]
SPLIT = r"(?<=[.!?])\s+(?=[\"“(A-Z0-9])"


def words(text: Column) -> Column:
    """Distinct lower-case words of two characters or more, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]{2,})"), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(x) for x in STOP]))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap_coefficient(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def split_sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SPLIT), lambda x: F.trim(x)), lambda x: x != "")


def label_similarity(a: Column, b: Column) -> Column:
    """1 for equal labels, 0.9 if one contains the other, else the Jaccard ratio of their words."""
    la, lb = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.when(la == lb, 1.0).when(la.contains(lb) | lb.contains(la), 0.9).otherwise(jaccard(words(a), words(b)))


def trim_to_sentence(text: Column, limit: int, least: int) -> Column:
    """``text`` within ``limit`` characters: up to its last full sentence if that is ``least`` long, else its last word."""
    head = F.substring(text, 1, limit)
    full = F.regexp_extract(head, r"(?s)^(.*[.!?])(?:\s|$)", 1)
    word = F.concat(F.rtrim(F.regexp_extract(head, r"(?s)^(.*)\s", 1)), F.lit(" …"))
    return F.when(F.length(text) <= limit, text).when(F.length(full) >= least, full).otherwise(word)


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.try_divide(dot, norm(a) * norm(b))


def url_key(url: Column) -> Column:
    """Host and path of a link, lower case, without ``www.`` and a slash at the end."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]+)", 1)), r"^www\.", "")
    return F.concat(host, F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)), r"/+$", ""))


LINES = "array<struct<at:int,section:string,block:string,heading:string,body:string>>"


def headed_blocks(text: Column) -> Column:
    """Parts of a packet, each with the headings it stands under: ``at, section, block, heading, body``.

    A heading is a line that begins with ``[`` (a section) or ``--`` (a block); a part begins at each, ``at`` is the
    number of lines before it, and ``heading`` its own first line. One fold over the parts of a text, no shuffle.
    """
    parts = F.split(text, r"\n(?=[ \t]*(?:\[|--))")
    none = F.lit(None).cast("string")
    start = F.struct(F.lit(0).alias("at"), none.alias("section"), F.array().cast(LINES).alias("out"))

    def step(got: Column, part: Column) -> Column:
        head = F.nullif(F.regexp_extract(part, r"^[ \t]*((?:\[|--)[^\n]*)", 1), F.lit(""))
        own = head.startswith("[")
        section = F.when(own, F.regexp_extract(head, r"^\[([^\]|]*?)\s*(?:\|[^\]]*)?\]", 1)).otherwise(got["section"])
        block = F.when(head.startswith("--"), F.regexp_extract(head, r"^--\s*(.*?)\s*(?:--)?$", 1)).otherwise(F.lit(""))
        item = F.struct(got["at"].alias("at"), section.alias("section"), block.alias("block"), head.alias("heading"), part.alias("body"))
        return F.struct((got["at"] + F.regexp_count(part, F.lit("\n")) + 1).alias("at"), section.alias("section"), F.array_append(got["out"], item).alias("out"))

    return F.aggregate(parts, start, step, lambda got: got["out"])
