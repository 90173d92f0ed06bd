"""Numbers as written: claims found in text, canonical forms, formats, worded bands. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Scale words and letters, nouns that make a number a claim, names of valuation metrics, what may stand
# between such a name and its figure, and what a multiple may be "times" of.
SCALE_WORDS = ["trillion", "billion", "million", "thousand"]
SCALE_LETTERS = ["T", "B", "M", "K"]
FACTORS = {"trillion": 1e12, "t": 1e12, "billion": 1e9, "b": 1e9, "million": 1e6, "m": 1e6, "thousand": 1e3, "k": 1e3}
NOUNS = ["revenue", "earnings", "eps", "margin", "margins", "growth", "upside", "downside", "shares", "units", "customers"]
METRICS = ["P/E", "PE", "PE ratio", "EV/EBITDA", "EV/EBIT", "EV/Sales", "EV/Revenue", "P/S", "P/B", "P/FCF", "PEG", "PEG ratio", "price-to-earnings", "price-to-book", "price-to-sales", "price-to-free cash flow", "multiple", "ratio"]
LINKS = ["of", "at", "is", "was", "near", "around", "stands at", "=", ":"]
HEDGES = ["about", "roughly", "approximately"]
TIMES_OF = ["earnings", "sales", "revenue", "book value", "book", "EBITDA", "EBIT", "free cash flow", "cash flow", "EPS"]
TIMES_KINDS = ["its", "the", "trailing", "forward", "next-year", "next year", "next year's", "this-year", "this year", "this year's", "twelve-month", "twelve month", "TTM", "GAAP", "non-GAAP", "adjusted"]


def one_of(words: list[str]) -> str:
    """Pattern of any of some words, the longest first; a space or hyphen in a word stands for either."""
    return "(?:" + "|".join(w.replace(" ", "[ -]").replace("-to-", "[ -]to[ -]") for w in sorted(words, key=len, reverse=True)) + ")"


NUM = r"\d[\d,]*(?:\.\d+)?"
SCALE = f"(?:{'|'.join(SCALE_WORDS)}|[{''.join(SCALE_LETTERS)}])"
END = r"(?![A-Za-z0-9_])"
#: A metric's name and what leads from it to a figure.
LEAD = rf"{one_of(METRICS)}(?:\s*\([^)]{{0,40}}\))?\s*(?:{one_of(LINKS)})?\s*(?:{one_of(HEDGES)}\s+|~)?"
#: What may follow a number and belong to it, a unit or what rules a bare figure out.
TAILS = [
    r"\s*(?:-|–|\bto\b)\s*\d+(?:\.\d+)?\s*%",  # the other end of a percent range
    r"\s*%",
    rf"\s?x{END}",
    rf"\s+times\s+(?:{one_of(TIMES_KINDS)}\s+)*{one_of(TIMES_OF)}{END}",
    rf"(?:\s+{one_of(SCALE_WORDS)})?\s+{one_of(NOUNS)}{END}",
    rf"\s*{one_of(SCALE_WORDS)}{END}",
    rf"\s?[{''.join(SCALE_LETTERS)}]{END}",
    rf"\s?(?:times|percent|bn){END}",
    r"\.|\w+",
]
#: A number with the metric or currency sign before it and the unit after it. Never inside a word, a date or a label such as 10-K.
#: The look-ahead names what a mention can begin with, so that other characters cost nothing.
MENTION = rf"(?i)(?=[0-9$€£¥,/:\-UEPMR])(?:(?<![A-Za-z0-9]){LEAD})?(?<![A-Za-z0-9.])(?<!\d[-/])(?:(?:US)?[$€£¥,/:\-]\s?)?{NUM}(?:{'|'.join(TAILS)})?"
PLACES = 6


def mentions(text: Column) -> Column:
    """array<string> of the numbers of a text with what stands around them: the one scan of a text."""
    return F.regexp_extract_all(text, F.lit(MENTION), F.lit(0))


def _body(mention: Column) -> Column:
    body = F.regexp_replace(mention, rf"(?i)^{LEAD}", "")
    return F.struct((F.length(body) < F.length(mention)).alias("led"), body.alias("body"))


def _parts(mention: Column) -> Column:
    """struct of a mention without its lead: whether a metric leads it, its sign, digits, tail, and the money it states."""
    body = mention["body"]
    sign, digits = F.regexp_extract(body, r"^\D*", 0), F.regexp_extract(body, rf"({NUM})", 1)
    money = F.regexp_extract(body, rf"(?i)(?:US)?\$\s?{NUM}(?:\s*{one_of(SCALE_WORDS)}{END}|\s?[{''.join(SCALE_LETTERS)}]{END})?", 0)
    tail = F.regexp_extract(body, rf"^\D*{NUM}(.*)$", 1)
    return F.struct(mention["led"].alias("led"), sign.alias("sign"), digits.alias("digits"), tail.alias("tail"), money.alias("money"))


def _claim(p: Column) -> Column:
    """The claim that the parts of a mention make, or null: money, percent, multiple, counted noun, figure of a metric, bare decimal."""
    digits, tail = p["digits"], p["tail"]
    spaced = lambda x: F.regexp_replace(x, r"\s+", " ")
    label = digits.rlike(r"^(?:19|20)\d\d$") & ~tail.rlike(rf"(?i)^\s+{one_of(SCALE_WORDS)}")  # a year before a noun
    small = digits.rlike(r"^\d{1,3}(?:\.\d+)?$")
    bare = digits.rlike(r"^\d{1,4}\.\d{1,4}$") & ~p["sign"].rlike(r"[$€£¥,/:\-]") & (tail == "")
    return (
        F.when(p["money"] != "", spaced(p["money"]))
        .when(tail.rlike(r"(?i)%$|^\s?x$"), spaced(F.concat(digits, tail)))
        .when(tail.rlike(r"(?i)^\s+times\s") & small, digits)
        .when(tail.rlike(rf"(?i)\s{one_of(NOUNS)}$"), F.when(~label, spaced(F.concat(digits, tail))))
        .when((p["led"] & small & ~tail.rlike(r"^\.\d")) | bare, digits)
    )


def as_claim(mention: Column) -> Column:
    """The claim of one mention; its parts are worked out once, by a transform over an array of one."""
    return F.transform(F.transform(F.transform(F.array(mention), _body), _parts), _claim)[0]


def once_each(found: Column) -> Column:
    """The strings of an array, each once ignoring case, the first as it is written."""
    return F.aggregate(found, F.array().cast("array<string>"), lambda got, x: F.when(F.exists(got, lambda y: F.lower(y) == F.lower(x)), got).otherwise(F.array_append(got, x)))


def claims(text: Column) -> Column:
    """array<string> of the numeric claims of a text, in order, each once ignoring case."""
    return once_each(F.array_compact(F.transform(mentions(text), as_claim)))


#: Any number of an evidence line with the unit next to it.
FIGURE = rf"(?i)\$?\s?{NUM}\s*(?:%|x{END}|{one_of(SCALE_WORDS)}|[{''.join(SCALE_LETTERS)}]{END}|percent(?!age))?"


def figures(line: Column) -> Column:
    """array<string> of every number of an evidence line, with its unit."""
    return F.transform(F.regexp_extract_all(line, F.lit(FIGURE), F.lit(0)), lambda x: F.trim(x))


def scale_of(text: Column) -> Column:
    """The factor of a scale word or letter after a number."""
    unit = F.lower(F.regexp_extract(text, rf"(?i)\d\s?({SCALE}){END}", 1))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in FACTORS.items() for x in (k, v)]), unit), F.lit(1.0))


def plain(value: Column) -> Column:
    """A decimal as text without the zeros at its end."""
    return F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def canonical(raw: Column) -> Column:
    """Canonical form of one claim: no sign, comma, currency or ``x``; ``%`` stays; scales are multiplied out.

    A bare value between 0 and 1 is marked, as it may be a fraction or a percentage. Null if there is no number.
    """
    digits = F.regexp_replace(F.regexp_extract(raw, rf"({NUM})", 1), ",", "")
    value = digits.try_cast(f"decimal(20,{PLACES})") * scale_of(raw).cast("decimal(13,0)")
    unit = raw.rlike(rf"(?i)\d\s?(?:x|{SCALE}){END}")

    def form(p: Column) -> Column:
        text = plain(p["value"])
        return F.when(p["percent"], F.concat(text, F.lit("%"))).when((p["value"] > 0) & (p["value"] < 1) & ~p["unit"], F.concat(text, F.lit(" [ambiguous fraction-or-percent]"))).otherwise(text)

    parts = F.struct(value.alias("value"), raw.rlike(r"%\s*$").alias("percent"), unit.alias("unit"))
    return F.transform(F.array(parts), form)[0]


RANGE = rf"^\s*[+-]?[\d.,]+\s*%?\s*(?:-|–|to)\s*[\d.,]+\s*%\s*$"


def is_range(raw: Column) -> Column:
    return raw.rlike(RANGE)


def range_ends(raw: Column) -> Column:
    """array<string> with the canonical forms of both ends of a percent range."""
    ends = F.regexp_extract_all(raw, F.lit(rf"({NUM})"), F.lit(1))
    return F.transform(ends, lambda x: F.concat(plain(F.regexp_replace(x, ",", "").try_cast(f"decimal(20,{PLACES})")), F.lit("%")))


def claim_forms(raw: Column) -> Column:
    """array<string> of what must be anchored for a claim: both ends of a range, else its canonical form."""
    return F.when(is_range(raw), range_ends(raw)).otherwise(F.array(canonical(raw)))


def accounting(cell: Column) -> Column:
    """Value of a table cell: ``(2,057)`` is negative; dashes and words are null."""
    body = F.regexp_replace(cell, r"[$,%\s]", "")
    value = F.regexp_extract(body, r"^\(?-?(\d+(?:\.\d+)?)\)?$", 1).try_cast("double")
    return F.when(body.rlike(r"^\(.*\)$|^-"), -value).otherwise(value)


def figure_cell(cell: Column) -> Column:
    return F.coalesce(cell.rlike(r"^[\s$(]*-?[\d,]+(?:\.\d+)?[\s)%x]*$"), F.lit(False))


def big_money(value: Column) -> Column:
    """``$4.20T``, ``$312.05B``, ``$7.00M``, else thousands separated."""
    a = F.abs(value)
    f = lambda d, u: F.concat(F.lit("$"), F.format_string("%.2f", value / d), F.lit(u))
    return F.when(a >= 1e12, f(1e12, "T")).when(a >= 1e9, f(1e9, "B")).when(a >= 1e6, f(1e6, "M")).otherwise(F.concat(F.lit("$"), F.format_number(value, 0)))


def percent_text(ratio: Column, signed: bool = False) -> Column:
    return F.concat(F.format_string("%+.2f" if signed else "%.2f", ratio * 100), F.lit("%"))


def variants(raw: Column) -> Column:
    """Spellings under which the amount of a claim may stand: short, worded and written out."""
    digits = F.regexp_replace(F.regexp_extract(raw, rf"({NUM})", 1), ",", "")
    unit = F.lower(F.regexp_extract(raw, rf"(?i)\d\s?({SCALE})\b", 1))
    short = F.when(unit.isin("trillion", "t"), "T").when(unit.isin("billion", "b"), "B").when(unit.isin("million", "m"), "M").when(unit.isin("thousand", "k"), "K")
    word = F.when(unit.isin("trillion", "t"), "trillion").when(unit.isin("billion", "b"), "billion").when(unit.isin("million", "m"), "million").when(unit.isin("thousand", "k"), "thousand")
    full = F.format_number(digits.try_cast("double") * scale_of(raw), 0)
    return F.array_distinct(F.array_compact(F.array(F.trim(raw), F.concat(F.lit("$"), digits, short), F.concat(F.lit("$"), digits, F.lit(" "), word), F.concat(digits, F.lit(" "), word), F.when(unit != "", full))))


# Worded bands of percentages, and what the thirds of ten are.
DECADES = {"single digit": (1, 9), "teens": (10, 19), "twenties": (20, 29), "thirties": (30, 39), "forties": (40, 49), "fifties": (50, 59), "sixties": (60, 69), "seventies": (70, 79), "eighties": (80, 89), "nineties": (90, 99)}
THIRDS = {"low": (0, 3), "mid": (4, 6), "high": (7, 9)}


def worded_band(text: Column) -> Column:
    """struct<lo,hi> of a percentage band: ``low-thirties``, ``mid-to-high twenties``, bare ``twenties``, ``33 to 34%``, ``flat``.

    A range of numbers before a single percentage, before ``flat``, before words.
    """
    low = F.regexp_replace(F.lower(text), "-", " ")
    pair = lambda lo, hi: F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    ranged = r"(\d+(?:\.\d+)?)\s?%?\s*(?:to|and| |–)\s*(\d+(?:\.\d+)?)\s?%"
    one = F.regexp_extract(low, r"(\d+(?:\.\d+)?)\s?%", 1)
    words = rf"(?:\b({'|'.join(THIRDS)})(?: to ({'|'.join(THIRDS)}))? )?({'|'.join(DECADES)})"
    first, second, decade = (F.regexp_extract(low, words, i) for i in (1, 2, 3))
    pick = lambda key, table, i: F.coalesce(*[F.when(key == k, F.lit(v[i])) for k, v in table.items()])
    least, most = pick(decade, DECADES, 0), pick(decade, DECADES, 1)
    base = F.when(least == 1, 0).otherwise(least)
    lo = F.when(first == "", least).otherwise(F.greatest(least, base + pick(first, THIRDS, 0)))
    hi = F.when(first == "", most).otherwise(F.least(most, base + pick(F.when(second == "", first).otherwise(second), THIRDS, 1)))
    return (
        F.when(low.rlike(ranged), pair(F.regexp_extract(low, ranged, 1), F.regexp_extract(low, ranged, 2)))
        .when(one != "", pair(one, one))
        .when(low.rlike(r"\bflat\b"), pair(F.lit(0), F.lit(0)))
        .when(decade != "", pair(lo, hi))
    )
