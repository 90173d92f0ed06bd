import json

import pytest

from tessera.llm import truncation as T

TURN = "id bigint, run_id bigint, text string, source string, key string"
EVENT = "event_id bigint, run_id bigint, event string, data string, field string"

WHOLE = [
    "Sales rose. Costs fell.", "Agreed.", "We met in the U.S. The talks went on in the U.S.", "# Case\n\nAll is well.\n\n```\n1 / 2\n```", "Ok.\n\n| A | B |\n|---|---|\n| x | 1 |", "He said: \"It is over.\"", "Costs fell (all of them).",
    "", "   ", "[reply unavailable: timeout]", "それは終わった。", "Lager wachsen. „Es geht.“", "Done. Ref AB12CD.", "It ended. (anchors: $5.1, $6.2)", None,
]
CUT = [
    "Sales rose. Costs fe", "Sales rose. The board (approx.", "He said: \"It is over. We go.", "Ok.\n\n| A | B |\n|---|---|\n| x | 1 |\n| y |", "See:\n\n```\n1 / 2", "Sales rose...(more)", "Sales rose and [truncated]", "Sales are do…", "Sales are d�",
    "Costs, e.g.", "It rose 12,", "それは終わっ", "**Note", "The plan (all of",
]


@pytest.mark.parametrize("text", WHOLE)
def test_whole(text):
    assert T.ending(text)[0] in ("whole", "ask")


@pytest.mark.parametrize("text", CUT)
def test_no_cut_text_is_surely_whole(text):
    assert T.ending(text)[0] in ("cut", "ask")


@pytest.mark.parametrize(("data", "is_torn"), [('{"verdict": "abc', True), ('{"verdict": "abc\\"', True), ('{"verdict": {"lean": "x", "text": "ab', True), ('{"verdict": "abc", "z": "q', False), ('"{\\"verdict\\": \\"abc', True), ('{"a": "verdict', False), ("", False)])
def test_torn(data, is_torn):
    assert T.torn(data) is is_torn


def build(spark, turns, events=()):
    t = spark.createDataFrame([(*x, "s", "k") for x in turns], TURN)
    e = spark.createDataFrame([(*x, "f") for x in events], EVENT)
    r = spark.createDataFrame([(1, "m", "s"), (1, "m", "s")], "id bigint, model string, source string")
    return T.Truncation(t, e, r)


def test_found_with_dirt(spark):
    turns = [(1, 1, "Sales rose. Costs fell."), (2, 1, "Sales rose. Costs fe"), (2, 1, "Sales rose. Costs fe"), (3, None, "Sal"), (4, 1, None), (5, 1, ""), (6, 9, "A " * 100_000 + "b")]
    events = [(1, 1, "judge", json.dumps({"update": {"verdict": {"text": "Off the"}, "reasoning": "Fine."}})), (2, 1, "review", '{"verdict": "Off th'), (3, 1, "judge", None), (4, 1, None, "{}"), (5, 1, "news_verify", json.dumps({"reasoning": "No end he"}))]
    got = {(r.field, r.rec_id) for r in build(spark, turns, events).found().collect()}
    assert {("turns.text", 2), ("turns.text", 6), ("data.verdict", 1), ("data.verdict", 2), ("data.reasoning", 5)} <= got
    assert not got & {("turns.text", 1), ("turns.text", 4), ("turns.text", 5), ("data.reasoning", 1)}


def test_evidence_decides_abbreviations_and_items(spark):
    body = [(i, 1, f"We met Dr. Who in the U.S. Then rain fell.\n- Notes on the sea\n- Outlook for the plan\n\nEnd {i}.") for i in range(20)]
    ends = [(100, 1, "Rain fell. We met Dr."), (101, 1, "Rain fell in the U.S."), (102, 1, "All:\n- Notes on the sea"), (103, 1, "All:\n- Notes on the s")]
    got = {r.rec_id for r in build(spark, body + ends).found().collect()}
    assert {100, 103} <= got and not got & {101, 102}


def test_headings_say_nothing_about_items_that_are_clauses(spark):
    body = [(i, 1, f"All:\n- Notes on the decline in unit volumes\n- margins fell; rents held over the year\n\nEnd {i}.") for i in range(20)]
    ends = [(100, 1, "All:\n- Risks and the decline in unit volumes"), (101, 1, "All:\n- costs rose on the decline in unit volumes"), (102, 1, "All:\n- Costs rose; rents reshaped the decline in unit volumes"), (103, 1, "All:\n- costs fell; rents held over the year")]
    got = {r.rec_id for r in build(spark, body + ends).found().collect()}
    assert {101, 102} <= got and not got & {100, 103}


def test_limits_are_found_among_neighbours(spark):
    spread = [(i, 1, "w" * (40 + i % 90) + ". " + "x" * 60 + ".") for i in range(900)]
    at = [(1000 + i, 1, ("The sea was calm and the ship went on to the far land of the north" * 3)[:120]) for i in range(60)]
    t = build(spark, spread + at)
    got = {(r.length, r.unit) for r in t.limits().collect()}
    assert got == {(120, "chars"), (120, "bytes")}
    causes = {r.cause for r in t.cut_values().filter("rec_id >= 1000").collect()}
    assert causes == {"limit"}
    r = t.report().filter("source = 'm'").first()
    assert r.n_cut == 60 and r.n_limit == 60


def test_listed_endings(spark):
    got = {r.rec_id for r in build(spark, [(i, 1, x) for i, x in enumerate(CUT)] + [(100 + i, 1, x) for i, x in enumerate(WHOLE)]).found().collect()}
    assert got == set(range(len(CUT)))


def test_remarks_that_recur_are_whole_unless_they_begin_a_commoner_one(spark):
    rows = [(i, 1, "Nothing to add") for i in range(30)] + [(100 + i, 1, "Nothing to") for i in range(4)] + [(200 + i, 1, "See round one") for i in range(3)]
    assert {r.rec_id for r in build(spark, rows).found().collect()} == {100, 101, 102, 103}


def test_sentences_that_trail_off_by_intent_recur(spark):
    rows = [(i, 1, f"Round {i}. And then the plan itself was withdrawn...") for i in range(9)] + [(100, 1, "Sales rose. The board was asked to..."), (101, 1, "Sales rose. The...")] + [(102 + i, 1, "Sales rose. The...") for i in range(5)]
    assert {r.rec_id for r in build(spark, rows).found().collect()} == set(range(100, 107))


def test_empty(spark):
    t = build(spark, [])
    assert t.found().count() == 0 and t.report().count() == 0 and t.limits().count() == 0


def test_hazards_take_part_in_the_decision(spark):
    """An ending that could be whole is cut at a length where the limit tears most values, and only there."""
    import random

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    fill = lambda n: ("The " + " ".join(word(5) for _ in range(40)))[: n - 1]
    tail = " rent, tolls, etc."
    rows = [fill(n) + "." for n in range(40, 240) if n != 120]
    rows += [fill(120) + "x" for _ in range(60)]
    rows += [f"It bore rent, tolls, etc. {w} was paid." for w in ("Tax", "Wage", "Fuel", "and rent")]
    at, off = len(rows), len(rows) + 1
    rows += [fill(121 - len(tail)) + tail, fill(151 - len(tail)) + tail]
    assert len(rows[at]) == 120 and len(rows[off]) == 150
    turns = spark.createDataFrame([(i, 1, x) for i, x in enumerate(rows)], "id bigint, run_id bigint, text string")
    events = spark.createDataFrame([], "event_id bigint, run_id bigint, event string, data string")
    t = T.Truncation(turns, events, spark.createDataFrame([(1, "m")], "id bigint, model string"))
    with_, without = ({r.rec_id for r in t.cut_values(b).collect()} for b in (True, False))
    assert with_ - without == {at} and off not in with_ and not without - with_
    plan = t.found()._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition" in plan, plan
