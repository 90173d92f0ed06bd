from pyspark.sql import functions as F

from tessera.functions import numbers as N, periods as P, registry
from tessera.operators import packets as K
from tessera.plans import figures, governance


def test_sql_functions_equal_the_expressions(spark):
    assert set(registry.register(spark)) == {"period_class", "extract_claims", "normalize_number", "parse_tables"}
    spark.createDataFrame([(x,) for x in [*governance.CASES, *governance.HEADINGS, *[t for _, t in governance.CASE_VERDICTS]]], "x string").createOrReplaceTempView("cases")
    got = spark.sql("SELECT x, normalize_number(x) AS n, period_class(x) AS p, extract_claims(x) AS c FROM cases").collect()
    want = {r.x: r for r in spark.table("cases").select("x", N.canonical(F.col("x")).alias("n"), P.period_class(F.col("x")).alias("p"), N.claims(F.col("x")).alias("c")).collect()}
    assert all((r.n, r.p, r.c) == (want[r.x].n, want[r.x].p, want[r.x].c) for r in got)
    spark.createDataFrame([(figures.PAGE,)], "html string").createOrReplaceTempView("pages")
    assert spark.sql("SELECT t.label, t.heading, t.value FROM pages, LATERAL parse_tables(html) t").count() == 20


def test_salvage():
    assert K.salvage('{"a": 1, "b": [1, 2], "c": "br') == {"a": 1, "b": [1, 2]}
    assert K.salvage('```json\n{"a": {"x": 1}, "b": 12') == {"a": {"x": 1}}
    assert K.salvage("[1") is None and K.salvage("") is None and K.salvage('{"a"') is None


def test_caps_and_excerpts(spark):
    lines = spark.createDataFrame([(1, "x" * 100), (1, "x" * 300), (2, "x"), (3, None)], "k bigint, t string")
    got = sorted((r.k, r.keep) for r in K.proportional_cap(lines, "k", "t", 200).collect() if r.keep is not None)
    assert got == [(1, 50), (1, 150), (2, 1)]
    t = spark.createDataFrame([(1, "Prose comes first here. It rose 5% then. More prose to end."), (2, None), (3, "")], "k bigint, t string")
    assert [(r.k, r.pos) for r in K.excerpt(t, "k", "t", 25).orderBy("pos").collect()] == [(1, 1)]


def test_scales_and_archetypes(spark):
    p = spark.createDataFrame([(1, "[A | USD millions]\nx"), (2, "[A | USD millions]\n-- B (EUR, thousands) --"), (3, "thousands"), (4, None)], "k bigint, t string")
    assert {r.k: r.scale for r in K.document_scale(p, "k", "t").collect()} == {1: "million", 2: None, 3: None, 4: None}
    x = spark.createDataFrame([("Wafers and microcontrollers for software.",), ("Lending, deposits.",), ("None of it.",), (None,)], "t string")
    assert [r.a for r in x.select(K.archetype(F.col("t")).alias("a")).collect()] == ["semis_hardware", "bank", None, None]


def test_headline_share(spark):
    x = spark.createDataFrame([("Harbour slows down", "The harbour slows. It is down. More."), (None, "a b"), ("Xy", None)], "a string, b string")
    assert [r.s for r in x.select(K.headline_share(F.col("a"), F.col("b")).alias("s")).collect()] == [1.0, None, 0.0]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "run_id bigint, ord int, label string, value string, source_tag string, line string")
    q = spark.createDataFrame([], "run_id bigint, question string, text string")
    assert K.best_facts(e).count() == 0 and K.tagged_lines(e, q).count() == 0 and K.proportional_cap(e, "run_id", "line", 5).count() == 0


def test_claims_like_an_earlier_one_go(spark):
    rows = [(1, 1, "The pilot foundry drew on input prices"), (1, 2, "the pilot foundry drew on input prices "), (1, 3, "The pilot foundry drew on higher input prices"), (1, 4, "Sales fell"), (2, 1, None), (1, 4, "Sales fell")]
    c = spark.createDataFrame(rows, "k bigint, pos int, t string")
    assert sorted((r.k, r.pos) for r in K.deduped(c, "k", "pos", "t", 0.8).collect()) == [(1, 1), (1, 4)]


def test_like_titles_equal_brute_force(spark):
    import itertools
    import random

    rng = random.Random(4)
    titles = [(rng.choice("ab"), " ".join(rng.sample(["sea", "rail", "port", "dock", "ship", "crane", "fuel", "toll"], rng.randint(1, 5)))) for _ in range(80)] + [("a", None), ("a", "the of")]
    df = spark.createDataFrame(titles, "k string, t string")
    got = {(r.key, frozenset((r.title, r.other))) for r in K.like_titles(df, "k", "t", 0.8).collect()}
    want = set()
    for (k, a), (m, b) in itertools.combinations({x for x in titles if x[1]}, 2):
        x, y = set(a.split()) - {"the", "of"}, set(b.split()) - {"the", "of"}
        if k == m and a != b and x and y and len(x & y) / min(len(x), len(y)) >= 0.8:
            want.add((k, frozenset((a, b))))
    assert got == want and want


def test_nearest_period_marker():
    s = "The quarter margin of 12% beat annual growth of 9%, and 5% over the year"
    assert [K.nearest_marker(s, s.index(x), s.index(x) + len(x)) for x in ("12%", "9%", "5%")] == ["quarter", "annual", "annual"]
    assert K.nearest_marker("It is 5%.", 6, 8) is None
