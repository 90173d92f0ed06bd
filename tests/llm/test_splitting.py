import pytest
from hypothesis import given, settings, strategies as st

from tessera.llm import splitting as S

LIMITS = [("section", "10-K", "chars", 40, 8), ("section", "8-K", "bytes", 40, 8), ("section", "*", "chars", 30, 0), ("container", None, "tokens", 2048, 0)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \nกิ中\U0001f600é", max_size=300), st.integers(9, 60), st.integers(0, 12), st.booleans())
def test_round_trip_and_limit(text, most, overlap, in_bytes):
    got = list(S.split_text(text, most, overlap, in_bytes))
    size = (lambda x: len(x.encode())) if in_bytes else len
    assert "".join(text[s:e] for _, s, e in got) == text
    for k, (b, s, e) in enumerate(got):
        assert size(text[b:e]) <= most and e > s
        if k:
            assert s == got[k - 1][2] and b <= s
            lead = min(overlap, most - (4 if in_bytes else 1))
            assert size(text[b:s]) <= lead and (b == 0 or size(text[b - 1 : s]) > lead)


def test_breaks_where_the_text_pauses():
    text = "First sentence here. Second sentence here.\n\nA new paragraph begins. It ends."
    cuts = [text[s:e] for _, s, e in S.split_text(text, 45, 0, False)]
    assert cuts == ["First sentence here. Second sentence here.\n\n", "A new paragraph begins. It ends."]


def sections(spark, rows):
    return spark.createDataFrame([(i, f, t, 1, "u", 2) for i, f, t in rows], "section_id bigint, form string, text string, max_size int, unit string, overlap int")


@pytest.fixture(scope="module")
def limits(spark):
    return spark.createDataFrame(LIMITS, "item_kind string, form string, unit string, max_size int, overlap int")


def test_found(spark, limits):
    rows = [(1, " 10-k ", "x" * 41), (2, "10-K", "x" * 40), (3, "8-K", "é" * 21), (4, "8-K", "é" * 20), (5, None, "x" * 31), (6, "10-K/A", "x" * 31), (7, "10-K", None), (8, "10-K", ""), (1, " 10-k ", "x" * 41), (9, "10-K", "word " * 50_000)]
    got = [r.section_id for r in S.oversized(sections(spark, rows), limits).collect()]
    assert sorted(got) == [1, 3, 5, 6, 9]
    p = S.pieces(sections(spark, rows), limits).collect()
    for i, text in ((1, "x" * 41), (3, "é" * 21), (9, "word " * 50_000)):
        mine = sorted((r for r in p if r.section_id == i), key=lambda r: r.piece_no)
        assert "".join(r.text[r.start_pos - r.begin_pos :] for r in mine) == text
    assert not {r.section_id for r in p} & {7, 8}


def test_found_comes_from_the_splitter(spark, limits):
    rows = sections(spark, [(1, "10-K", "x" * 41), (2, "10-K", "x" * 40)])
    assert "MapInPandas" in S.oversized(rows, limits)._jdf.queryExecution().executedPlan().toString()
    tight = spark.createDataFrame([("section", "*", "bytes", 1, 0), ("section", "none", "chars", 0, 0)], limits.schema)
    # a character above its limit is one piece, and too large; a limit of 0 holds no text
    assert sorted(r.section_id for r in S.oversized(sections(spark, [(1, "a", "é"), (2, "a", "e"), (3, "none", "ee"), (4, "none", "")]), tight).collect()) == [1, 3]


def test_empty(spark, limits):
    assert S.oversized(sections(spark, []), limits).count() == 0 and S.pieces(sections(spark, []), limits).count() == 0
    none = limits.filter("item_kind = 'none'")
    assert S.oversized(sections(spark, [(1, "10-K", "x" * 99)]), none).count() == 0
    assert S.pieces(sections(spark, [(1, "10-K", "x" * 99)]), none).count() == 1


def test_sentences_are_cut_where_they_end():
    text = "We met Dr. Smith at noon today. He left at one. It rained."
    assert [text[a:b] for _, a, b in S.split_text(text, 34, 0, False)] == ["We met Dr. Smith at noon today. ", "He left at one. It rained."]
