"""Period classes of headings, labels and clauses, and which of them conflict."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MONTHS = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
# Classes that can't describe the same figure.
CONFLICTS = [
    ("quarter", "ttm"), ("quarter", "annual"), ("quarter", "forward"), ("ttm", "annual"), ("ttm", "forward"), ("YTD (H1)", "quarter"), ("YTD (H1)", "ttm"), ("YTD (H1)", "annual"), ("YTD (H1)", "YTD (9M)"),
    ("YTD (9M)", "quarter"), ("YTD (9M)", "ttm"), ("YTD (9M)", "annual"),
]
# What marks a class, as one pattern each, checked in this order.
MARKS = [
    ("change", r"(?i)\b(growth|change|yoy|y/y)\b|%\s*chg|\bO/\(U\)"),
    ("ttm", r"(?i)\b(ttm|trailing|last twelve months|ltm)\b"),
    ("forward", r"(?i)\b(forward|next (?:year|quarter)|ntm|guidance|outlook)\b"),
    ("YTD (9M)", r"(?i)\b(nine months|39 weeks|ytd \(9m\)|9m)\b"),
    ("YTD (H1)", r"(?i)\b(six months|26 weeks|first half|ytd \(h1\)|h1)\b"),
    ("quarter", r"(?i)\b(quarter|three months|13 weeks|q[1-4]|[1-4]q)(?![a-z])"),
    ("annual", r"(?i)\b(annual|year ended|twelve months|52 weeks|53 weeks|fiscal year|full[ -]year|fy\s?\d{2,4}|fy)\b"),
]


def period_class(text: Column, changes: bool = True) -> Column:
    """quarter, YTD (H1), YTD (9M), annual, ttm, forward, change, ``period ended`` for a bare date, else unstated.

    Without ``changes`` words of growth don't count: a growth rate belongs to the period it is stated for.
    """
    out = F.when(text.isNull(), F.lit("unstated"))
    for name, mark in MARKS if changes else MARKS[1:]:
        out = out.when(text.rlike(mark), name)
    return out.when(text.rlike(rf"(?i)\b{MONTHS}\b\.?\s+\d{{1,2}},?\s+\d{{4}}|\b\d{{4}}-\d\d-\d\d\b"), "period ended").otherwise("unstated")


def conflict(a: Column, b: Column) -> Column:
    """Whether two classes can't both hold; unstated ones never conflict."""
    either = [((a == x) & (b == y)) | ((a == y) & (b == x)) for x, y in CONFLICTS]
    out = either[0]
    for e in either[1:]:
        out = out | e
    return F.coalesce(out, F.lit(False))


def ended(text: Column) -> Column:
    """The date a heading names, in any of three shapes."""
    mdy = F.regexp_replace(F.regexp_extract(text, rf"(?i)\b({MONTHS}\.?\s+\d{{1,2}},?\s+\d{{4}})\b", 1), r"[.,]", "")
    iso = F.regexp_extract(text, r"\b(\d{4}-\d\d-\d\d)\b", 1)
    dmy = F.regexp_extract(text, rf"(?i)\b(\d{{1,2}}\s+{MONTHS}\s+\d{{4}})\b", 1)
    m3 = lambda x: F.regexp_replace(x, r"(?i)\b([A-Za-z]{3})[A-Za-z]*\b", "$1")
    return F.coalesce(F.expr("null").cast("date"), F.try_to_date(m3(mdy), "MMM d yyyy"), F.try_to_date(iso, "yyyy-MM-dd"), F.try_to_date(m3(dmy), "d MMM yyyy"))


def entity(text: Column) -> Column:
    """What is left of a heading without its period words."""
    out = F.regexp_replace(text, rf"(?i)\b(?:for the|three|six|nine|twelve|months?|weeks?|quarters?|years?|ended|ending|fiscal|ttm|ytd|first half|13|26|39|52|53|q[1-4]|fy\s?\d*)\b|\b{MONTHS}\b\.?|\b\d{{1,2}},|\b(?:19|20)\d\d\b|\(\s*\)", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def month_distance(a: Column, b: Column) -> Column:
    """Whole months between two dates by year and month alone; days don't count."""
    return (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)


def basis(text: Column) -> Column:
    return F.when(text.rlike(r"(?i)non-gaap|adjusted|excluding|constant[ -]currency"), "adjusted").when(text.rlike(r"(?i)\bgaap\b|as reported|reported"), "reported").otherwise("unstated")
