import datetime
from fractions import Fraction

import pytest

from tessera.operators import units as U

COMMON = [("money", "US cent"), ("share of a whole", "basis point"), ("floor area", "square metre"), ("mass", "kilogram"), ("volume", "litre"), ("energy", "kilowatt hour"), ("time span", "hour"), ("headcount", "person")]
FX = [("EUR", "USD", datetime.date(2026, 4, 1), 1.1), ("EUR", "USD", datetime.date(2025, 4, 1), 9.0), ("GBP", "USD", datetime.date(2026, 4, 1), 1.25), ("JPY", "USD", datetime.date(2026, 4, 1), 0.007), ("USD", "KRW", datetime.date(2026, 4, 1), 1360.0), ("INR", "USD", datetime.date(2026, 4, 1), 0.012), ("CHF", "USD", datetime.date(2026, 4, 1), 1.1)]
R = "id bigint, price string, evidence string, quantity string, key string"


@pytest.fixture(scope="module")
def amounts(spark):
    fx = spark.createDataFrame(FX, "report string, quote string, d date, rate double")
    cu = spark.createDataFrame(COMMON, "quantity string, common_unit string")

    def run(rows):
        runs = spark.createDataFrame([(i, p, e, "q", "k") for i, p, e in rows], R)
        return {(r.run_id, r.line_no): r.amount for r in U.run_amounts(runs, fx, cu).collect()}

    return run


CASES = {
    "$745.01": 74501, "1,204 USD": 120400, "€ 80,98": 8908, "€ 1.234,50": 135795, "¥3,277": 2294, "GBX 200": 250, "1,000p": 1250, "$4.74T": 474000000000000, "584,87 Mio. EUR": 64335700000, "€ 89.795 Mrd.": 9877450000000000,
    "CHF 35'671 Mio.": 3923810000000, "12億円": 840000000, "KRW 1.36 trillion": 100000000000, "Rs 100 lakh": 12000000, "$(7,604)": -760400, "-$5": -500, "500 billion dollars": 50000000000000, "68,434 US cents": 68434,
    "41.5%": 4150, "257.9‰": 2579, "0.5988 of revenue": 5988, "5,009 bps": 5009, "66,38 %": 6638, "1 acre": 4047, "2 thousand lb": 907, "1 short ton": 907, "1 bbl": 159, "198.2 kbbl": 31511282, "1 TJ": 277778, "2.5 weeks": 420, "53.5 days": 1284, "9.4 thousand persons": 9400, "17.84 Mt": 17840000000, "3 m³": 3000,
}


def test_amounts(amounts):
    got = amounts([(i, None, f"[X]\n- Label: {v}  [source: a/b]") for i, v in enumerate(CASES)])
    assert {v: got.get((i, 2)) for i, v in enumerate(CASES)} == CASES


def test_no_cases(amounts):
    bad = ["18-49%", "15.3x", "2026-11-23", "n/a", "$68.1 vs price $69.9 (+13.79%)", "[price unavailable: feed timeout]", "97,571", "12 parsecs", "", "9" * 60 + " USD"]
    assert amounts([(i, None, f"- Label: {v}") for i, v in enumerate(bad)]) == {}


def test_headings_and_staff(amounts):
    e = "[STATEMENTS | USD millions]\n- Revenue: 1.5\n- Loss: (22)\n-- Balance sheet (EUR, thousands) --\n- Debt: 10\n-- Operating measures --\n- Headcount: 9.4k\n- Full-time staff: 335\n- Other: 7"
    got = amounts([(1, "$2", e)])
    assert got == {(1, 0): 200, (1, 2): 150000000, (1, 3): -2200000000, (1, 5): 1100000, (1, 7): 9400, (1, 8): 335}


def test_nulls_repeats_empty_long(amounts):
    assert amounts([]) == {}
    long = "\n".join(["[H | USD]"] + [f"- L{i}: {i}.00" for i in range(1, 3000)])
    got = amounts([(1, None, None), (2, "", "  "), (3, "$1", None), (3, "$1", None), (4, None, long), (None, "$1", None)])
    assert got[(3, 0)] == 100 and got[(4, 2999)] == 299800 and len(got) == 3001


def test_graph_composes_and_checks_cycles():
    g = U.build_graph([("EUR", "USD", 1.1)])
    ways = g.to("us cent")
    assert ways["eur"].a == Fraction(110) and ways["usd"].a == 100
    assert g.to("litre")["million barrel"].a == Fraction("3.785411784") * 42 * 1000 * 1000
    g.add("celsius", "kelvin", U.Affine(Fraction(1), Fraction("273.15")))
    g.add("fahrenheit", "celsius", U.Affine(Fraction(5, 9), Fraction(-160, 9)))
    f = g.to("kelvin")["fahrenheit"]
    assert f.a * 212 + f.b == Fraction("373.15")
    g.add("fahrenheit", "kelvin", U.Affine(Fraction(1)))
    with pytest.raises(ValueError, match="cycle"):
        g.to("kelvin")


def test_brute_force_on_the_smallest_tables(spark, sf):
    from tessera.session import table

    got = U.run_amounts(table(spark, sf, "runs"), table(spark, sf, "fx"), table(spark, sf, "common_units"))
    rate = {"USD": 1.0}
    for r in table(spark, sf, "fx").orderBy("d").collect():
        if r.quote == "USD":
            rate[r.report] = r.rate
    import re

    want = {}
    for r in table(spark, sf, "runs").select("id", "price").distinct().collect():
        if m := re.fullmatch(r"(?:US)?\$([\d.]+)|USD ([\d.]+)|([\d.]+) USD", r.price or ""):
            want[r.id] = round(float(next(x for x in m.groups() if x)) * 100)
        elif m := re.fullmatch(r"CHF ([\d.]+)", r.price or ""):
            want[r.id] = round(float(m[1]) * 100 * rate["CHF"])
    mine = {r.run_id: r.amount for r in got.filter("line_no = 0").collect()}
    assert want and {k: mine.get(k) for k in want} == want
