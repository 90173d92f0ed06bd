"""Quantities recorded in different units, brought to one unit for each kind of quantity.

Conversions are edges of a graph with affine functions ``y = a*x + b`` over exact fractions. Shortest
compositions from every unit to the wanted unit of its quantity are worked out once on the driver (the graph
is a fixed registry plus one edge for each currency pair), every edge is checked against the compositions of
its two ends (cycle consistency), and amounts then meet their conversion by an equi-join on the unit as
written. The amounts themselves never leave the executors.

Defined results: null, blank or not-available values, ranges, multiples, dates and lines with several amounts
yield no amount, because what stands around the number is no unit, and an amount beyond BIGINT yields none;
``rejected`` lists them with the reason, so nothing goes unseen. Repeated rows yield each amount once; an empty
table yields an empty table.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.functions.text import headed_blocks

#: Currency pairs that may be read to the driver; beyond it the rates aren't a dimension and the call fails.
MAX_PAIRS = 10_000
#: Relative disagreement that exchange rates around a cycle may have (market rates never close exactly).
FX_TOLERANCE = Fraction(2, 100)
#: Kinds of quantity, and spellings of units with their scales, that are a dimension; beyond it the call fails.
MAX_QUANTITIES, MAX_SPELLINGS = 1_000, 100_000

# Spellings of scales, currencies and units, and exact definitions of units.
SCALES = {
    "": 1, "hundred": 100, "k": 10**3, "thousand": 10**3, "thousands": 10**3, "tsd.": 10**3, "lakh": 10**5, "lakhs": 10**5,
    "m": 10**6, "mn": 10**6, "mm": 10**6, "mio": 10**6, "mio.": 10**6, "million": 10**6, "millions": 10**6,
    "crore": 10**7, "crores": 10**7, "cr": 10**7, "b": 10**9, "bn": 10**9, "mrd": 10**9, "mrd.": 10**9, "billion": 10**9, "billions": 10**9,
    "t": 10**12, "tn": 10**12, "trn": 10**12, "trillion": 10**12, "trillions": 10**12, "万": 10**4, "億": 10**8, "亿": 10**8, "兆": 10**12,
}
WORD_SCALES = ("hundred", "thousand", "million", "billion", "trillion")
CURRENCY_BEFORE = {
    "$": "usd", "us$": "usd", "usd": "usd", "us $": "usd", "nt$": "twd", "twd": "twd", "€": "eur", "eur": "eur", "£": "gbp", "gbp": "gbp",
    "¥": "jpy", "jp¥": "jpy", "jpy": "jpy", "₹": "inr", "rs": "inr", "rs.": "inr", "inr": "inr", "chf": "chf", "fr.": "chf", "₩": "krw", "krw": "krw",
    "gbx": "pence",
}
CURRENCY_AFTER = {
    "usd": "usd", "us dollars": "usd", "us dollar": "usd", "dollars": "usd", "dollar": "usd", "$": "usd", "twd": "twd", "eur": "eur", "euro": "eur", "euros": "eur", "€": "eur",
    "gbp": "gbp", "jpy": "jpy", "yen": "jpy", "円": "jpy", "inr": "inr", "rupees": "inr", "chf": "chf", "krw": "krw", "won": "krw",
    "p": "pence", "pence": "pence", "gbx": "pence", "us cents": "us cent", "us cent": "us cent", "cents": "us cent", "¢": "us cent",
}
UNITS = {
    "basis point": ("share of a whole", ("bps", "bp", "basis points", "basis point")),
    "percent": ("share of a whole", ("%", "percent", "per cent", "pct", "pct.")),
    "per mille": ("share of a whole", ("‰", "per mille", "permille")),
    "fraction": ("share of a whole", ("of revenue", "of sales", "of total", "of the whole")),
    "square metre": ("floor area", ("m²", "m2", "sqm", "sq m", "sq. m", "square metres", "square metre", "square meters", "square meter")),
    "square foot": ("floor area", ("sq ft", "sq. ft.", "sqft", "ft²", "ft2", "square feet", "square foot")),
    "acre": ("floor area", ("acres", "acre", "ac")),
    "hectare": ("floor area", ("ha", "hectares", "hectare")),
    "square kilometre": ("floor area", ("km²", "km2", "square kilometres", "square kilometers")),
    "kilogram": ("mass", ("kg", "kilograms", "kilogram", "kilos")),
    "gram": ("mass", ("g", "grams", "gram")),
    "tonne": ("mass", ("tonnes", "tonne", "metric tons", "metric ton")),
    "kilotonne": ("mass", ("kt", "kilotonnes")),
    "megatonne": ("mass", ("mt", "megatonnes")),
    "pound": ("mass", ("lb", "lbs", "lb.", "pounds", "pound")),
    "short ton": ("mass", ("short tons", "short ton")),
    "litre": ("volume", ("litres", "litre", "liters", "liter", "l")),
    "hectolitre": ("volume", ("hl", "hectolitres", "hectoliters")),
    "cubic metre": ("volume", ("m³", "m3", "cubic metres", "cubic meters", "cubic metre")),
    "us gallon": ("volume", ("us gallons", "us gallon", "gallons", "gallon", "gal")),
    "barrel": ("volume", ("bbl", "barrels", "barrel")),
    "thousand barrel": ("volume", ("kbbl", "mbbl")),
    "million barrel": ("volume", ("mmbbl",)),
    "kilowatt hour": ("energy", ("kwh", "kilowatt hours", "kilowatt hour")),
    "megawatt hour": ("energy", ("mwh",)),
    "gigawatt hour": ("energy", ("gwh",)),
    "terawatt hour": ("energy", ("twh",)),
    "megajoule": ("energy", ("mj",)),
    "gigajoule": ("energy", ("gj",)),
    "terajoule": ("energy", ("tj",)),
    "petajoule": ("energy", ("pj",)),
    "hour": ("time span", ("hours", "hour", "h", "hrs", "hr")),
    "minute": ("time span", ("minutes", "minute", "min")),
    "day": ("time span", ("days", "day", "d")),
    "week": ("time span", ("weeks", "week", "wk", "wks")),
    "person": ("headcount", ("persons", "person", "people", "employees", "staff", "heads", "fte", "ftes")),
}
EDGES = [
    ("percent", "basis point", "100"), ("per mille", "percent", "1/10"), ("fraction", "percent", "100"),
    ("square foot", "square metre", "0.09290304"), ("acre", "square foot", "43560"), ("hectare", "square metre", "10000"), ("square kilometre", "hectare", "100"),
    ("gram", "kilogram", "1/1000"), ("tonne", "kilogram", "1000"), ("kilotonne", "tonne", "1000"), ("megatonne", "tonne", "1000000"),
    ("pound", "kilogram", "0.45359237"), ("short ton", "pound", "2000"),
    ("hectolitre", "litre", "100"), ("cubic metre", "litre", "1000"), ("us gallon", "litre", "3.785411784"), ("barrel", "us gallon", "42"),
    ("thousand barrel", "barrel", "1000"), ("million barrel", "thousand barrel", "1000"),
    ("megawatt hour", "kilowatt hour", "1000"), ("gigawatt hour", "megawatt hour", "1000"), ("terawatt hour", "gigawatt hour", "1000"),
    ("kilowatt hour", "megajoule", "36/10"), ("gigajoule", "megajoule", "1000"), ("terajoule", "gigajoule", "1000"), ("petajoule", "terajoule", "1000"),
    ("hour", "minute", "60"), ("day", "hour", "24"), ("week", "day", "7"),
    ("usd", "us cent", "100"), ("gbp", "pence", "100"),
]
STAFF_LABEL = r"(?i)\b(headcount|staff|employees|workforce)\b"
RANK_DIGITS = 38


@dataclass(frozen=True)
class Affine:
    """y = a*x + b, exactly."""

    a: Fraction
    b: Fraction = Fraction(0)

    def then(self, g: Affine) -> Affine:
        return Affine(g.a * self.a, g.a * self.b + g.b)

    def inverse(self) -> Affine:
        return Affine(1 / self.a, -self.b / self.a)


class UnitGraph:
    """Units as nodes, affine conversions as edges in both directions."""

    def __init__(self) -> None:
        self.edges: dict[str, dict[str, tuple[Affine, Fraction]]] = {}

    def add(self, src: str, dst: str, f: Affine, tolerance: Fraction = Fraction(0)) -> None:
        if f.a == 0:
            raise ValueError(f"{src} -> {dst}: a conversion can't be constant")
        self.edges.setdefault(src, {})[dst] = (f, tolerance)
        self.edges.setdefault(dst, {}).setdefault(src, (f.inverse(), tolerance))

    def to(self, target: str) -> dict[str, Affine]:
        """The shortest composition from every unit that reaches ``target``; raises if a cycle disagrees."""
        best, queue = {target: Affine(Fraction(1))}, deque([target])
        while queue:
            v = queue.popleft()
            for u in sorted(self.edges.get(v, {})):
                if u not in best:
                    best[u] = self.edges[u][v][0].then(best[v])
                    queue.append(u)
        for u in best:
            for v, (f, tolerance) in self.edges.get(u, {}).items():
                via = f.then(best[v])
                if abs(via.a - best[u].a) > tolerance * abs(best[u].a) or abs(via.b - best[u].b) > tolerance * max(1, abs(best[u].b)):
                    raise ValueError(f"conversions disagree around a cycle through {u} -> {v}")
        return best


def build_graph(rates: list[tuple[str, str, float]]) -> UnitGraph:
    g = UnitGraph()
    for src, dst, factor in EDGES:
        g.add(src, dst, Affine(Fraction(factor)))
    for unit in UNITS:
        g.edges.setdefault(unit, {})
    for report, quote, rate in rates:
        g.add(report.strip().lower(), quote.strip().lower(), Affine(Fraction(repr(float(rate)))), FX_TOLERANCE)
    return g


def newest_rates(fx: DataFrame) -> list[tuple[str, str, float]]:
    """The newest rate of each pair; a dimension, so its size is checked before it is read."""
    newest = fx.filter(F.col("rate") > 0).groupBy(F.upper(F.trim("report")).alias("r"), F.upper(F.trim("quote")).alias("q")).agg(F.max(F.struct("d", "rate"))["rate"].alias("rate"))
    rows = newest.orderBy("r", "q").limit(MAX_PAIRS + 1).collect()
    if len(rows) > MAX_PAIRS:
        raise ValueError(f"more than {MAX_PAIRS} currency pairs")
    return [(x["r"], x["q"], x["rate"]) for x in rows]


def conversions(fx: DataFrame, common_units: DataFrame) -> DataFrame:
    """``key`` (unit as written), ``quantity``, and whole numbers with amount = (value * num + off) / den."""
    spark: SparkSession = fx.sparkSession
    g = build_graph(newest_rates(fx))
    names = {a: u for u, (_, aliases) in UNITS.items() for a in (u, *aliases)}
    rows: dict[str, tuple[str, str, str, str, str]] = {}

    def put(key: str, quantity: str, f: Affine, scale: int) -> None:
        f = Affine(f.a * scale, f.b)
        den = f.a.denominator * f.b.denominator // _gcd(f.a.denominator, f.b.denominator)
        num, off = int(f.a * den), int(f.b * den)
        if max(len(str(abs(x))) for x in (num, off, den)) <= RANK_DIGITS:
            rows.setdefault(key, (key, quantity, str(num), str(off), str(den)))

    wanted = common_units.filter("quantity is not null and common_unit is not null").select("quantity", "common_unit").limit(MAX_QUANTITIES + 1).collect()
    if len(wanted) > MAX_QUANTITIES:
        raise ValueError(f"more than {MAX_QUANTITIES} kinds of quantity")
    for quantity, unit in sorted((r["quantity"], r["common_unit"]) for r in wanted):
        target = unit.strip().lower()
        ways = g.to(names.get(target, target))
        if quantity.strip().lower() == "money":
            for scale, n in SCALES.items():
                for before, cur in CURRENCY_BEFORE.items():
                    if cur in ways:
                        put(f"{before}|{scale}", quantity, ways[cur], n)
                for after, cur in CURRENCY_AFTER.items():
                    if cur in ways:
                        put("|" + f"{scale} {after}".strip(), quantity, ways[cur], n)
                        put(f"|{scale}{after}", quantity, ways[cur], n)
        else:
            for name, (q, aliases) in UNITS.items():
                if q == quantity.strip().lower() and name in ways:
                    for alias in (name, *aliases):
                        put(f"|{alias}", quantity, ways[name], 1)
                        for scale in WORD_SCALES:
                            put(f"|{scale} {alias}", quantity, ways[name], SCALES[scale])
                    if name == "person":  # a bare staff number, perhaps with a scale
                        for scale, n in SCALES.items():
                            put(f"staff|{scale}", quantity, ways[name], n)
    if len(rows) > MAX_SPELLINGS:
        raise ValueError(f"more than {MAX_SPELLINGS} spellings of units")
    return spark.createDataFrame(sorted(rows.values()), "key string, quantity string, num string, off string, den string").select(
        "key", "quantity", *[F.col(c).cast("decimal(38,0)").alias(c) for c in ("num", "off", "den")]
    )


def _gcd(a: int, b: int) -> int:
    while b:
        a, b = b, a % b
    return a


SPACE = r"[\s\u00a0\u202f\u2009]"
NUMBER = r"\d(?:[\d.,'’\u00a0\u202f]*\d)?"


def parse_number(digits: Column, german: Column) -> Column:
    """DECIMAL of a number as written: grouping by comma, point, apostrophe or space; comma or point decimals."""
    d = F.translate(digits, "'’\u00a0\u202f", "")
    comma, point = d.contains(","), d.contains(".")
    comma_last = F.length(F.substring_index(d, ",", -1)) < F.length(F.substring_index(d, ".", -1))
    no_comma, no_point = F.translate(d, ",", ""), F.translate(d, ".", "")
    as_comma_decimal = F.translate(no_point, ",", ".")
    text = (
        F.when(comma & point, F.when(comma_last, as_comma_decimal).otherwise(no_comma))
        .when(comma, F.when(~german & d.rlike(r"^\d{1,3}(,\d{2,3})*,\d{3}$"), no_comma).otherwise(as_comma_decimal))
        .when(point & ((F.length(d) - F.length(no_point) > 1) | (german & d.rlike(r"^\d{1,3}(\.\d{3})+$"))), no_point)
        .otherwise(d)
    )
    return text.try_cast("decimal(28,8)")


BLANKS = " \t\r\n\u00a0\u202f\u2009"


def parsed(values: DataFrame, value: str, label: str, heading: str) -> DataFrame:
    """``values`` with ``key`` (the unit as written) and ``_value`` of each that holds a number.

    ``heading`` gives the unit of a number that has none; a bare staff number (by ``label``) is persons.
    """
    v = F.trim(F.substring_index(F.col(value), "[source:", 1), F.lit(BLANKS))
    w = F.col("_v")
    signed = w.rlike(r"^[^\d+\-−–]*[+\-−–][^\d]*\d")
    inside = F.when(w.contains("("), F.regexp_replace(w, r"^([^\d(]*)\((.*)\)$", "$1$2")).otherwise(w)
    body = F.when(signed, F.regexp_replace(inside, r"^([^\d+\-−–]*)[+\-−–](?=[^\d]*\d)", "$1")).otherwise(inside)
    negative = (w.contains("(") & w.rlike(r"^[^\d(]*\(.*\)$")) | (signed & w.rlike(r"^[^\d+\-−–]*[\-−–]"))
    squeeze = lambda c: F.lower(F.trim(F.regexp_replace(c, rf"{SPACE}+", " ")))
    code = F.lower(F.regexp_extract(F.col(heading), r"\b(USD|EUR|GBP|JPY|TWD|INR|CHF|KRW)\b", 1))
    scale = F.lower(F.regexp_extract(F.col(heading), r"(?i)\b(thousand|million|billion|trillion)s?\b", 1))
    # What is parsed is exploded from an array of one, as the optimizer would repeat it for every filter above.
    once = lambda *cols: F.explode(F.array(F.struct(*cols)))
    step = values.withColumn("_v", v).filter(w.rlike(r"\d")).withColumn("_b", once(body.alias("body"), negative.alias("neg"))).drop("_v")
    before = F.regexp_extract("_b.body", r"^[^\d]*", 0)
    step = step.withColumn("_p", once(before.alias("pre"), F.substring(F.col("_b.body"), F.length(before) + 1, F.lit(1 << 30)).alias("rest"), F.col("_b.neg").alias("neg"))).drop("_b")
    num = F.regexp_extract("_p.rest", rf"^{NUMBER}", 0)
    step = step.withColumn("_s", once(squeeze(F.col("_p.pre")).alias("pre"), num.alias("num"), squeeze(F.substring(F.col("_p.rest"), F.length(num) + 1, F.lit(1 << 30))).alias("suf"), F.col("_p.neg").alias("neg"))).drop("_p")
    pre, suf = F.col("_s.pre"), F.col("_s.suf")
    staff = F.coalesce(F.col(label).rlike(STAFF_LABEL), F.lit(False))
    key = (
        F.when((pre == "") & suf.isin(list(SCALES)) & staff, F.concat(F.lit("staff|"), suf))
        .when((pre == "") & (suf == "") & (code != ""), F.concat(code, F.lit("|"), scale))
        .otherwise(F.concat(pre, F.lit("|"), suf))
    )
    number = parse_number(F.col("_s.num"), suf.rlike(r"\b(mio|mrd)\b"))
    return step.select(*values.columns, key.alias("key"), F.when(F.col("_s.neg"), -number).otherwise(number).alias("_value"))


def converted(values: DataFrame, value: str, label: str, heading: str, conv: DataFrame) -> DataFrame:
    """The parsed values with ``quantity`` and ``amount``; both null where the unit as written is in no conversion."""
    # the conversions come from a fixed registry and at most MAX_PAIRS rates, and their number is checked
    met = parsed(values, value, label, heading).join(F.broadcast(conv), "key", "left")
    exact = F.try_divide(F.expr("try_add(try_multiply(_value, num), off)"), F.col("den"))
    return met.withColumn("amount", F.round(exact, 0).try_cast("bigint")).drop("_value", "num", "off", "den")


def amounts(values: DataFrame, value: str, label: str, heading: str, conv: DataFrame) -> DataFrame:
    """``values`` with ``amount`` BIGINT in the common unit of its ``quantity``; rows without one amount go."""
    return converted(values, value, label, heading, conv).filter(F.col("amount").isNotNull()).drop("key")


def rejected(values: DataFrame, value: str, label: str, heading: str, conv: DataFrame) -> DataFrame:
    """The values that yield no amount, with ``reason``: no number, no unit known (``written`` is what stands there), too large."""
    some = F.coalesce(F.col(value), F.lit("")).rlike(r"\d")
    none = values.filter(~some).select(*values.columns, F.lit("no number").alias("reason"), F.lit(None).cast("string").alias("written"))
    left = converted(values, value, label, heading, conv).filter("amount is null")
    return none.unionByName(left.select(*values.columns, F.when(F.col("quantity").isNull(), "no unit").otherwise("too large").alias("reason"), F.col("key").alias("written")))


def evidence_lines(runs: DataFrame) -> DataFrame:
    """``run_id, line_no, label, value, heading`` of each data line of the packets, and line 0 for the price.

    The heading is the nearest line above that is one; it is carried by a fold over the parts of one text.
    """
    parts = runs.filter(F.col("evidence").isNotNull()).select(F.col("id").alias("run_id"), F.explode(headed_blocks(F.col("evidence"))).alias("p"))
    rows = parts.select("run_id", "p.at", "p.heading", F.posexplode(F.split("p.body", "\n")).alias("pos", "line")).filter("heading is null or pos > 0")
    line = F.ltrim("line")
    item = rows.select("run_id", (F.col("at") + F.col("pos") + 1).alias("line_no"), "heading", F.explode(F.array(line)).alias("line")).filter(F.col("line").rlike(r"^[-•*]\s+[^:]*:"))
    label = F.trim(F.substring(F.substring_index("line", ":", 1), F.lit(2), F.lit(1 << 30)))
    value = F.trim(F.substring(F.col("line"), F.instr("line", ":") + 1, F.lit(1 << 30)), F.lit(BLANKS))
    data = item.select("run_id", "line_no", label.alias("label"), value.alias("value"), "heading").filter(F.col("value") != "")
    price = runs.filter(F.col("price").isNotNull()).select(F.col("id").alias("run_id"), F.lit(0).alias("line_no"), F.lit("price").alias("label"), F.col("price").alias("value"), F.lit(None).cast("string").alias("heading"))
    return data.unionByName(price)


def run_amounts(runs: DataFrame, fx: DataFrame, common_units: DataFrame) -> DataFrame:
    """Every stated amount of the runs in its common unit: ``run_id, line_no, quantity, amount``."""
    got = amounts(evidence_lines(runs), "value", "label", "heading", conversions(fx, common_units))
    return got.select("run_id", "line_no", "quantity", "amount").distinct()


def run_rejected(runs: DataFrame, fx: DataFrame, common_units: DataFrame) -> DataFrame:
    """What was left out of the runs' amounts, and why: ``run_id, line_no, value, reason, written``."""
    got = rejected(evidence_lines(runs), "value", "label", "heading", conversions(fx, common_units))
    return got.select("run_id", "line_no", "value", "reason", "written").distinct()
