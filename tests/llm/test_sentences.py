import numpy as np
import pytest

from tessera.llm import sentences as S

GOLD = [
    "Dr. Bar and Ms. Foo met on Jan. 4 at 3 p.m. on the pier.|They left.", "Costs, e.g. rent, tolls, etc., rose.|It fell in the U.S.|The U.S. Treasury and the E.U. desk met.", "See Note No. 5 and Sec. 9.7 for it.|Sales rose 8.5% to $4.3 billion.",
    '"Is it over?" was the question.|Asked, he said: "It fell. It rose again."|“All is well.”|We go.', "(It was so.)|J. R. Hal came.|Release 2.9.4 went out.|2024 was a year.|eVolt sales fell.", "He ... or what is left of him ... came.|And then it stopped...|We left.",
    "It rose at Foo Corp.|The plan held.|Bar Inc. fell across most regions.|The end came!", "议长说：“毛利率上升。成本下降。”|续约放缓……但门店增加。|是吗？|对！", "議長は「利益が出た。費用は減った。」と述べた。|「終わった。」|本当か？",
    "Am 23. Mai stieg der Wert im 3. Quartal.|Laut Dr. Foo fiel, z. B. durch Regen, die Menge bzw. der Preis (vgl. Abs. 4, S. 57).|„Es geht.“|Er kam.", "M. Foo estime (cf. art. 10, p. 60) que oui !|« C'est fini. »|Est-ce vrai ?|Oui.",
    "En EE. UU. la red subió (aprox. 12.544 uds.) en mayo.|¿Es así?|¡Sí!|El Sr. Foo y la Dra. Bar vinieron.", "डॉ. कालेव ने कहा।|क्या यह सच है?|हाँ।", "أوضح د. سرمان أن الربح زاد.|هل هذا صحيح؟|نعم.", "เงินสำรองสูงกว่า 24.6 ล้านบาทในงวดนี้|ค่าขนส่งลดลง",
]


def pieces(text):
    ends, at, out = S.sentence_ends(text), 0, []
    for e in ends:
        out.append(text[at:e].strip())
        at = e
    return out


@pytest.mark.parametrize("gold", GOLD)
def test_gold(gold):
    want = gold.split("|")
    assert pieces(" ".join(want) if not any("一" <= c <= "鿿" for c in gold) else "".join(want)) == want


def test_missing_spaces():
    assert pieces("It rose across most regions.The plan held.  It fell.") == ["It rose across most regions.", "The plan held.", "It fell."]
    assert pieces("See http://foo.Bar.com for v1.2 now.") == ["See http://foo.Bar.com for v1.2 now."]


def test_lines():
    text = "Outlook for the sea\n\n- First item\n- Second item. It has two.\n\nShare | Print\nwxYz09" + "aB3/" * 500
    assert pieces(text)[:5] == ["Outlook for the sea", "- First item", "- Second item.", "It has two.", "Share | Print"] and len(pieces(text)) == 6


def test_hard_wrapped():
    import textwrap

    para = "The harbour segment was weighed against slower renewals even as wages rose. Our cold-chain unit (approx. 3.1x) held. \"We did not plan for this,\" the chair said at the pier on Jan. 4 under the revised terms."
    text = textwrap.fill(para, 78, break_on_hyphens=False) + "\n\nFigures may not add up\nShare this page"
    assert [" ".join(x.split()) for x in pieces(text)] == ["The harbour segment was weighed against slower renewals even as wages rose.", "Our cold-chain unit (approx. 3.1x) held.", '"We did not plan for this," the chair said at the pier on Jan. 4 under the revised terms.', "Figures may not add up", "Share this page"]


@pytest.mark.parametrize("text", [None, "", " \n ", "[section unavailable: parse error]"])
def test_nothing(text):
    assert S.sentence_ends(text) == []


def test_ends_spare_white_space():
    assert S.sentence_ends("  One.  Two. \n ") == [6, 12]


def test_chunks_compose_to_the_whole():
    text = " ".join(g.replace("|", " ") for g in GOLD) * 3 + "\n\n" + "\n".join(GOLD)
    marked, want = S.mark_breaks(text), S.sentence_ends(text)
    for size in (40, 173, 1000):
        cuts = S.cut_points(marked, size)
        evs = [S.events(marked, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        right, left = S.start_states(np.stack([S.chunk_function(e) for e in evs]))
        got, state = [], 0
        for e, r, x in zip(evs, right, left, strict=True):
            assert state == x
            ends, state = S.emit(marked, S.look_right(e, int(r))[0], int(x))
            got += ends
        assert got + ([S._last_end(marked)] if state >= 9 else []) == want


def test_spread_over_chunks(spark):
    text = ("He said: \"It fell. It rose.\" Then (as ever) rain came. " * 400) + "\n\n" + "x" * 5000
    rows = [(1, text, "c"), (1, text, "c"), (2, None, "c"), (3, "", "c"), (4, "One. Two.", "c"), (5, "[section unavailable: x]" , "c")]
    df = spark.createDataFrame(rows, "section_id bigint, text string, end_pos string")
    got = {}
    for r in S.sentences(df, chunk=1000).collect():
        got.setdefault(r.section_id, []).append(r.end_pos)
    assert sorted(got[1]) == S.sentence_ends(text) and sorted(got[4]) == [4, 9] and set(got) == {1, 4}
    assert S.sentences(df.filter("section_id = 99")).count() == 0
    units = S.sentence_units(df.filter("section_id = 4")).orderBy("no").collect()
    assert [(u.sentence, u.start_pos) for u in units] == [("One.", 0), ("Two.", 5)]


def test_long_sections_of_the_tables_are_read_in_chunks(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/sections.parquet").select("section_id", "text").distinct()
    texts = {r.section_id: r.text for r in df.filter(f"char_length(text) > {S.CHUNK}").collect()}
    got = {}
    for r in S.sentences(df.filter(df.section_id.isin(list(texts)))).collect():
        got.setdefault(r.section_id, []).append(r.end_pos)
    assert len(texts) >= 3 and {i: sorted(v) for i, v in got.items()} == {i: e for i, t in texts.items() if (e := S.sentence_ends(t))}


def test_titles_after_a_sentence_without_a_space():
    text = "It met the list.Dr. Ulmpel left. It was flat.J. R. Irv joined in the U.S. We saw it."
    assert [text[a:b].strip() for a, b in zip([0, *S.sentence_ends(text)], S.sentence_ends(text), strict=False)] == ["It met the list.", "Dr. Ulmpel left.", "It was flat.", "J. R. Irv joined in the U.S.", "We saw it."]
