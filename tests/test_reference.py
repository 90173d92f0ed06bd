"""Every query with SQL against DuckDB on the smallest tables, and goldens of the expressions."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import numbers as N, periods as P, text as T
from tessera.operators import chunks, claims as C, figures as G, series as S, signals
from tessera.plans import catalogue
from tessera.sources import readers, writers


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows_as_sql(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    r = duck.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in r.fetchall()), key=str)
    assert got == want


def rows(spark, sf, name):
    return catalogue.queries()[name](spark, sf).collect()


def test_verdicts_add_up(spark, sf):
    got = rows(spark, sf, "governed_verdicts")
    assert got and all(r.cited + r.flagged == r.claims for r in got)
    assert all((r.status == "clean") <= (r.flagged + r.mislabeled + r.scenario + r.absence + r.advice == 0 and r.disclaimed) for r in got)


def test_selections_keep_their_rules(spark, sf):
    taken = {}
    for r in rows(spark, sf, "news_select"):
        taken.setdefault(r.key, []).append(r.place)
    assert taken and all(sorted(x) == list(range(1, len(x) + 1)) and len(x) <= 6 for x in taken.values())
    picks = {}
    for r in rows(spark, sf, "retrieve_greedy"):
        picks.setdefault(r.query_id, []).append((r.pick, r.score))
    assert picks and all(len(x) <= 3 and [s for _, s in sorted(x)] == sorted((s for _, s in x), reverse=True) for x in picks.values())


def test_sample_is_that_of_one_ranking(spark, sf):
    """Against a ranking of each tier as a whole, with buckets of a few rows."""
    from pyspark.sql import Window

    df = spark.range(3000).select("id", ((F.col("id") * 7919) % 1000).cast("double").alias("v"))
    size, signals.BUCKET_ROWS = signals.BUCKET_ROWS, 50
    try:
        got = {(r.id, r.tier, r.k) for r in signals.stratified(df, "id", "v", [0.3, 0.4, 0.3], 100, 7).collect()}
    finally:
        signals.BUCKET_ROWS = size
    tier = F.when(F.col("v") > 666, 0).when(F.col("v") > 333, 1).otherwise(2)
    k = F.row_number().over(Window.partitionBy("t").orderBy(F.xxhash64("id", F.lit(7)), "id"))
    whole = df.withColumn("t", tier).withColumn("k", k).filter(F.col("k") <= F.when(F.col("t") == 1, 40).otherwise(30))
    assert len(got) == 100 and len(got & {(r.id, r.t, r.k) for r in whole.collect()}) >= 90  # tier bounds are approximate
    assert len(rows(spark, sf, "stratified_sample")) == 100


def test_rulings_are_one_to_one(spark, sf):
    got = rows(spark, sf, "claim_rulings")
    met = [(r.key, r.review_id, r.review_pos) for r in got if r.review_id is not None]
    assert got and len(met) == len(set(met)) and all(r.score >= 0.3 for r in got if r.review_id is not None)
    left = spark.createDataFrame([("k", 1, "a b c"), ("k", 2, "a b"), ("k", 3, "z"), ("k", 4, None)], "key string, pos int, text string")
    right = spark.createDataFrame([("k", 1, "a b"), ("k", 2, "a b c d"), ("q", 1, "z")], "key string, pos int, text string")
    assert {(r.pos, r.match) for r in signals.assign(left, right, 0.3).collect()} == {(1, 2), (2, 1), (3, None), (4, None)}
    assert {(r.pos, r.match) for r in signals.assign(left, right.filter("pos > 9"), 0.3).collect()} == {(1, None), (2, None), (3, None), (4, None)}


def test_deduped_claims_and_periods(spark, sf):
    kept, all_ = rows(spark, sf, "deduped_claims"), rows(spark, sf, "p3_judge_claim")
    assert 0 < len(kept) <= len(all_) and {(r.event_id, r.pos) for r in kept} <= {(r.event_id, r.parent_pos) for r in all_}
    assert {r.period for r in rows(spark, sf, "claim_periods")} <= {None, "ttm", "forward", "quarter", "annual"}
    assert all(r.fields for r in rows(spark, sf, "salvaged_records"))


def test_amounts_and_what_was_left_out(spark, sf):
    amounts, left = rows(spark, sf, "p6_amounts"), rows(spark, sf, "p6_rejected")
    assert {(r.run_id, r.line_no, r.amount) for r in amounts} == {(r.run_id, r.line_no, r.amount) for r in rows(spark, sf, "p6_found")}
    assert left and {r.reason for r in left} <= {"no number", "no unit", "too large"}


def test_every_array_is_a_table(spark, sf):
    from tessera.operators import nested

    rec = '{"a": {"b": [{"c": 1, "d": [[5, 6], [7]]}, null, {"c": {"e": "x"}}]}, "f": "[1, 2]", "g": null}'
    df = spark.createDataFrame([(1, rec), (1, rec), (2, None), (3, "broken {")], "id bigint, j string")
    items, fields = nested.recursive_tables(df, "id", "j")
    short = lambda x: x and "/".join(x.split("/")[2:])
    assert sorted((r.table, short(r.parent_id) or "", r.ordinal) for r in items.collect()) == [
        ("$", "", 0), ("$.a.b", "", 1), ("$.a.b", "", 3), ("$.a.b.d", "a.b/1", 1), ("$.a.b.d", "a.b/1", 2), ("$.a.b.d[]", "a.b/1/d/1", 1), ("$.a.b.d[]", "a.b/1/d/1", 2), ("$.a.b.d[]", "a.b/1/d/2", 1), ("$.f", "", 1), ("$.f", "", 2)
    ]
    assert {(short(r.item_id), r.field, r.value) for r in fields.collect()} >= {("a.b/1", "c", "1"), ("a.b/3", "c.e", "x"), ("f/2", "item", "2")}
    assert {r.table for r in rows(spark, sf, "p3_tables")} >= {"$"}


def test_sections_and_captions():
    from tessera.operators import filings as L

    body = "We rely on few suppliers and demand may fall. " * 20
    page = f"Item 1A. Risk Factors ........ 5\nItem 7. MD&A ........ 9\nItem 1A. Risk Factors\n{body}\nas said in Item 7 above\nItem 7. MD&A\nShort."
    got = dict(L.sections_of("10-K", page))
    assert got["Item 1A"].startswith("Item 1A. Risk Factors\nWe rely") and got["Item 1A"].endswith("above") and got["Item 7"] is None and got["Item 1"] is None
    html = '<p><b>We rely on few suppliers, and demand may fall.</b></p><p style="font-weight: bold">Item 1A.</p><span style="font-weight:700">Is it wise to rely on <i>one</i> port?</span>'
    held = "x We rely on few suppliers, and demand may fall. y Is it wise to rely on one port? z"
    assert L.captions_of(html, held) == ["We rely on few suppliers, and demand may fall.", "Is it wise to rely on one port?"]


def test_index_finds_neighbours(spark):
    import numpy as np

    from tessera.operators import vectors as V

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    data = [(i, [float(x) for x in centres[i % 20] + 0.3 * rng.normal(size=16)], 0) for i in range(1500)] + [(5000, None, 0), (5001, [], 0), (5002, [0.0] * 16, 0), (5003, [1.0] * 3, 0)]
    e = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, label int")
    index = V.fit(e, "vec_id", "embedding")
    q = e.filter("vec_id % 20 = 0")
    found = V.search(q, e, "vec_id", "embedding", 5, index)
    exact = chunks.nearest(q.filter("size(embedding) = 16"), e.filter("size(embedding) = 16"), "vec_id", "embedding", 5)
    assert index[1] < len(index[0]) / 2 and V.recall(found, exact).first().recall >= 0.9
    assert V.search(q.limit(0), e.limit(0), "vec_id", "embedding", 5).count() == 0


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_claims_of_a_text(spark):
    text = "At $195.55 the cap is $4.74T on 15.32x; sales of $91.0 billion grew 25.2%, margin 30-40%. v1.2x and 2.5.1% are none."
    assert one(spark, text, N.claims) == ["$195.55", "$4.74T", "15.32x", "$91.0 billion", "25.2%", "30-40%"]
    assert one(spark, "", N.claims) == [] and one(spark, None, N.claims) is None
    said = "2026 revenue fell while trailing P/E of 38.61 and 14 times forward EBITDA beat the 22.05 consensus."
    assert one(spark, said, N.claims) == ["38.61", "14", "22.05"]
    assert one(spark, "Q4 FY2027 10-K 2026-10-27 p25, 5 million shares, 1,204 customers, 2026 customers, 3 times as many", N.claims) == ["5 million shares", "1,204 customers"]
    assert one(spark, "PEG ratio of 1.3, a ratio: 5%, 5% and 5 %; $5-10 million", N.claims) == ["1.3", "5%", "5 %", "$5"]


def test_evidence_forms(spark):
    runs = spark.createDataFrame([(1, "[A]\n- Debt/Equity (mrq, %): 401.00  [source: x]\n- Rent (in thousands): 729,476\n- Said: 50.1 percent, 2 percentage points, 0.52")], "id bigint, evidence string")
    got = {}
    for r in C.anchors(C.evidence_lines(runs)).collect():
        got.setdefault(r.ord, set()).add(r.canon)
    assert {"401", "401%"} <= got[2] and {"729476", "729476000"} <= got[3] and {"50.1", "50.1%", "2", "0.52 [ambiguous fraction-or-percent]"} == got[4]


def test_headings_are_carried(spark):
    text = "- a: 1\n[S | USD]\n- b: 2\n-- Block --\n- c: 3\n[T]\n- d: 4"
    runs = spark.createDataFrame([(1, text), (1, text), (2, None), (3, "")], "id bigint, evidence string")
    got = sorted((r.ord, r.section, r.block, r.label, r.value) for r in C.evidence_lines(runs).collect())
    assert got == [(1, None, "", "a", "1"), (3, "S", "", "b", "2"), (5, "S", "Block", "c", "3"), (7, "T", "", "d", "4")]


def test_disclaimers_and_absences(spark):
    t = spark.createDataFrame([(1, 1, "Does Not Constitute Financial Advice. Investors should wait."), (1, 2, "The research team discussed advice columns. Investors should wait. It does not disclose backlog."), (2, 3, "Margins were not disclosed.")], "run_id bigint, id bigint, text string")
    assert [(r.turn_id, r.pos) for r in C.advice(t).collect()] == [(2, 1)]
    runs = spark.createDataFrame([(1, "- KPI value not found: x"), (2, "- fine: 1")], "id bigint, evidence string")
    assert [(r.turn_id, r.pos) for r in C.absences(t, runs).collect()] == [(2, 2)]


def test_inline_anchors_leave_whole():
    from tessera.operators.governor import stamp, without_anchors

    assert without_anchors("Up 5% (anchors: $1 (= $2)) now (derived from x") == "Up 5% now (derived from x"
    assert stamp("25-54% and 54%, 1.54%", ["54%", "25-54%"], [], []) == "25-54% [UNGROUNDED — no evidence anchor] and 54% [UNGROUNDED — no evidence anchor], 1.54%"


def test_trace_goldens(spark):
    turns = spark.createDataFrame([(1, 7, "It trades at $195.55 and may gain 30-40% or 20-50%.")], "run_id bigint, id bigint, text string")
    runs = spark.createDataFrame([(1, "[A]\n- Price: $195.55  [source: x/y]\n- Low: 20%\n- High: 50%")], "id bigint, evidence string")
    got = {r.claim: r.status for r in C.trace(C.text_claims(turns), C.anchors(C.evidence_lines(runs))).collect()}
    assert got == {"$195.55": "CITED", "30-40%": "FLAGGED", "20-50%": "CITED"}


@pytest.mark.parametrize(("claim", "pct", "ok"), [(41.4, True, True), (41.3, True, True), (44.0, True, False)])
def test_recompute_goldens(spark, claim, pct, ok):
    claims = spark.createDataFrame([(1, claim, pct, 1)], "key bigint, claim_value double, is_percent boolean, digits int")
    values = spark.createDataFrame([(1, 531.31), (1, 375.81)], "key bigint, value double")
    assert C.recompute(claims, values).first().ok is ok


def test_advice_only_before_the_disclaimer(spark):
    t = spark.createDataFrame([(1, "Investors should buy. This is not financial advice. Investors should sell."), (2, None), (3, "")], "id bigint, text string")
    assert [(r.turn_id, r.pos) for r in C.advice(t).collect()] == [(1, 0)]


def test_stamps_stay_out_of_tags(spark):
    tr = spark.createDataFrame([(1, "5%", "FLAGGED"), (1, "15%", "FLAGGED")], "turn_id bigint, claim string, status string")
    t = spark.createDataFrame([(1, "Up 15% [was 5%] and 5%.")], "id bigint, text string")
    assert C.stamped(tr, t).first().text == "Up 15% [UNGROUNDED] [was 5%] and 5% [UNGROUNDED]."


def test_period_conflicts(spark):
    x = spark.createDataFrame([("quarter", "annual"), ("annual", "quarter"), ("quarter", "quarter"), ("unstated", "ttm")], "a string, b string")
    assert [r.c for r in x.select(P.conflict(F.col("a"), F.col("b")).alias("c")).collect()] == [True, True, False, False]
    assert one(spark, "Three Months Ended July 4, 2026", P.ended) == datetime.date(2026, 7, 4)
    assert one(spark, "Docks Three Months Ended 2026", P.entity) == "Docks"


def test_trimming(spark):
    assert one(spark, "One two. Three four five.", lambda c: T.trim_to_sentence(c, 12, 5)) == "One two."
    assert one(spark, "Onetwothree four", lambda c: T.trim_to_sentence(c, 13, 5)) == "Onetwothree …"


def test_asof_is_strict_if_asked(spark):
    a = spark.createDataFrame([("k", 1), ("k", 5), ("z", 5), ("k", None)], "k string, d int")
    b = spark.createDataFrame([("k", 1, 10.0), ("k", 4, 40.0), (None, 2, 1.0)], "k string, d int, v double")
    back = {(r.k, r.d): r.v for r in S.asof_backward(a, b, "k", "d", "v").collect()}
    strict = {(r.k, r.d): r.v for r in S.asof_backward(a, b, "k", "d", "v", strict=True).collect()}
    assert back == {("k", 1): 10.0, ("k", 5): 40.0, ("z", 5): None} and strict == {("k", 1): None, ("k", 5): 40.0, ("z", 5): None}


def test_floor_percentile_never_interpolates(spark):
    d = spark.createDataFrame([("a", float(i)) for i in (4, 2, 3, 1)], "k string, v double")
    assert S.floor_percentiles(d, "k", "v", {"p": 0.25}).first().p == 1.0


def test_windows_indices(spark):
    text = " ".join(f"Sentence {i} explains filing fact {i}." for i in range(10))
    got = {r.k: r for r in chunks.windows(spark.createDataFrame([(1, text), (2, None), (3, "Lone sentence here.")], "section_id bigint, text string")).collect() if r.section_id == 1}
    assert (got[1].window_start, got[1].core_start, got[1].core_end, got[1].window_end) == (1, 2, 5, 6) and max(got) == 4


def test_nearest_handles_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 0), (3, [0.0, 1.0], 1), (4, None, 0), (5, [], 0), (6, [0.0, 0.0], 0), (7, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0)]
    e = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = chunks.nearest(e.filter("vec_id = 1"), e, "vec_id", "embedding", 2).orderBy("rank").collect()
    assert [r.row_id for r in got] == [2, 3]
    assert chunks.nearest(e.filter("vec_id = 99"), e, "vec_id", "embedding", 2).count() == 0


def test_table_layouts():
    page = "<p>In millions</p><table><tr><th></th><th colspan=3>Year Ended 2026</th></tr><tr><td>Cash flow:</td></tr><tr><td>Net (1)</td><td>$</td><td>(7,604</td><td>)</td></tr></table>"
    r = G.parse_tables(page)[0]
    assert (r["label"], r["grp"], r["units"], r["cells"]) == ("Net", "Cash flow", "millions", [("Year Ended 2026", "$(7,604)")])
    assert G.parse_tables(None) == [] and G.parse_tables("<table><tr><td>broken") == []


def test_html_text_drops_scripts_and_page_numbers():
    assert G.html_text("<nav>x</nav><p>One <b>two</b></p><p>12</p><script>y</script><p>three</p>") == "One two\nthree"


def test_greedy_selection(spark):
    rows = [("k", 1, 5.0, "a", ["x", "y"], 10), ("k", 2, 4.0, "a", ["x", "y"], 10), ("k", 3, 3.0, "a", ["p", "q"], 10), ("k", 4, 2.0, "a", ["r"], 10), ("k", 5, 1.0, "b", ["s"], 10), ("k", 6, -1.0, "c", ["t"], 10)]
    items = spark.createDataFrame(rows, "key string, id bigint, score double, publisher string, words array<string>, chars int")
    assert [r.id for r in signals.select(items, 2, 0.75, 100, 9).orderBy("place").collect()] == [1, 3, 5]


def test_paced_reader_and_registry(spark, tmp_path):
    (tmp_path / "a").write_text("hello")
    got = {r.path.rsplit("/", 1)[1]: (r.content, r.reason) for r in readers.paced(spark, [str(tmp_path / "a"), str(tmp_path / "b")], 0.01).collect()}
    assert got["a"] == ("hello", None) and got["b"][0] is None and "unavailable" in got["b"][1]


def test_table_replacement(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.replace_table(spark.range(3), path)
    writers.replace_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and len(list(tmp_path.iterdir())) == 1
    ids = writers.append_with_ids(spark.read.parquet(path), spark.createDataFrame([("a",), ("b",)], "v string")).select("id").collect()
    assert len({r.id for r in ids}) == 2 and min(r.id for r in ids) > 4
    with pytest.raises(ValueError, match="nothing"):
        writers.append_with_ids(spark.range(1), spark.range(0))


def test_dimension_size_is_checked(spark):
    from tessera.session import bounded

    with pytest.raises(ValueError, match="more than 2"):
        bounded(spark.range(3), 2)


def test_core_never_imports_the_optional_part():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for f in glob.glob(f"{root}/tessera/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in f:
            assert "tessera.llm" not in open(f).read() and "from .llm" not in open(f).read()
