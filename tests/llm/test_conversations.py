import datetime

from tessera.llm import conversations as C

T0 = datetime.datetime(2026, 1, 1)
TURN = "id bigint, run_id bigint, seq int, at timestamp_ntz, agent string, round int, text string, status string, sound int"
RUN = "id bigint, status string, seq int"


def turns(spark, rows):
    return spark.createDataFrame([(i, run, seq, None if seq is None else T0 + datetime.timedelta(seconds=20 * seq + (9000 if run == 50 and seq == 3 else 0)), agent, rnd, text, "s", 1) for i, (run, seq, agent, rnd, text) in enumerate(rows)], TURN)


def runs(spark, rows):
    return spark.createDataFrame([(i, s, 1) for i, s in rows], RUN)


def debate(run, bad=None):
    rows = [(run, 1, "research", None, "r"), (run, 2, " BULL", 1, "a"), (run, 3, "Bear ", 1, "b"), (run, 4, "judge", 1, "c")]
    return [bad.get(r[1], r) if bad else r for r in rows]


def test_reasons(spark):
    t = debate(1) + debate(2, {3: (2, 5, "bear", 1, "b")}) + debate(3, {3: (3, 3, "bear", 1, "  ")}) + debate(4, {3: (4, 3, "bear", 1, "[bear unavailable: x]")}) + debate(5, {3: (5, 3, "review", 1, "b")}) + debate(6) + debate(7)
    t += [(8, 1, "bull", 1, "a"), (8, 1, "bull", 1, "other")] + debate(9) + [(9, 2, "bull ", 1, "a")] + debate(10, {3: (10, None, "bear", 1, "b")}) + [(None, 1, "bull", 1, "x")] + debate(12, {1: (12, 1, None, None, None)})
    r = runs(spark, [(1, "done"), (1, "done"), (2, "done"), (3, "done"), (4, "Done "), (5, "done"), (6, None), (8, "done"), (9, "DONE"), (10, "done"), (11, "done"), (12, "done"), (None, "done")])
    got = {x.run_id: x.reason for x in C.soundness(turns(spark, t), r).collect()}
    assert got == {1: None, 2: "broken order", 3: "empty reply", 4: "empty reply", 5: "missing reply", 6: "not done", 7: "no run", 8: "broken order", 9: None, 10: "broken order", 11: "no turns", 12: None}
    found = [x.run_id for x in C.unsound_runs(turns(spark, t), r).collect()]
    assert len(found) == len(set(found)) and set(found) == {k for k, v in got.items() if v}


def test_order_roles_and_gaps(spark):
    t = [x for run in range(40, 60) for x in debate(run)]
    got = C.conversations(turns(spark, list(reversed(t))), runs(spark, [(i, "done") for i in range(40, 60)])).collect()
    one = sorted((x.seq, x.role) for x in got if x.run_id == 41)
    assert one == [(1, "research"), (2, "bull"), (3, "bear"), (4, "judge")]
    # gaps are all alike but one, and the calibrated limit lies between
    assert {(x.run_id, x.seq) for x in got if x.session == 2} == {(50, 3), (50, 4)} and {x.session for x in got} == {1, 2}
    r = C.replies(turns(spark, list(reversed(t))), runs(spark, [(i, "done") for i in range(40, 60)])).collect()
    assert {(x.run_id, x.session, x.messages, x.reciprocal) for x in r if x.run_id in (41, 50)} == {(41, 1, 4, True), (50, 1, 2, False), (50, 2, 2, True)}


def test_empty_and_long(spark):
    assert C.unsound_runs(turns(spark, []), runs(spark, [])).count() == 0
    assert [x.run_id for x in C.unsound_runs(turns(spark, debate(1)), runs(spark, [])).collect()] == [1]
    assert C.conversations(turns(spark, []), runs(spark, [(1, "done")])).count() == 0
    long = debate(1, {2: (1, 2, "bull", 1, "x" * 300_000)})
    assert C.conversations(turns(spark, long), runs(spark, [(1, "done")])).count() == 4
