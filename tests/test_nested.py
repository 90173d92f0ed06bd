import json

from tessera.operators.nested import Collection, NestedTables, Scalar, _walk, event_tables

S = "event_id bigint, event string, data string, v int, kind string"


def found(spark, rows):
    df = spark.createDataFrame([(i, e, d, 1, "x") for i, e, d in rows], S)
    return {tuple(r) for r in event_tables(df).found().collect()}


def test_shapes_give_the_same_items(spark):
    q = [{"id": "q1", "kpis": ["a", None, "b"]}, None, {"id": "q2"}]
    plan = {"plan": {"key_questions": q}}
    named = {"plan": {"key_questions": {"q2": {"kpis": "b"}, "q1": {"kpis": json.dumps(["x", "y"])}}}}
    rows = [
        (1, "planner", json.dumps(plan)),
        (2, "Planner ", "```json\n" + json.dumps(plan) + "\n```"),
        (3, "planner", json.dumps(json.dumps(plan))),
        (4, "planner", json.dumps({"update": {"reply": plan}})),
        (5, "planner", json.dumps({"plan": {"key_questions": json.dumps(q)}})),
        (6, "planner", json.dumps(named)),
        (7, "planner", json.dumps({"plan": {"key_questions": {"id": "only", "kpis": []}}})),
    ]
    got = found(spark, rows)
    for i in (1, 2, 3, 4, 5):
        assert {g[1:] for g in got if g[0] == i} == {("plan_question", 1, 0), ("plan_question", 3, 0), ("plan_kpi", 1, 1), ("plan_kpi", 1, 3)}
    assert {g[1:] for g in got if g[0] == 6} == {("plan_question", 1, 0), ("plan_question", 2, 0), ("plan_kpi", 1, 1), ("plan_kpi", 1, 2), ("plan_kpi", 2, 1)}
    assert {g[1:] for g in got if g[0] == 7} == {("plan_question", 1, 0)}


def test_scalars(spark):
    def judge(**x):
        return json.dumps({"questions": [], **x})

    rows = [(1, "judge", judge(verdict="ok", converged="Yes")), (2, "judge", judge(verdict="  ", converged=0)), (3, "judge", judge(verdict={"text": "t"}, converged=1)), (4, "review", json.dumps({"verdict": "v", "converged": True})), (5, "judge", judge(converged=None))]
    got = found(spark, rows)
    assert got == {(1, "verdict", 0, 0), (1, "converged", 0, 0), (3, "verdict", 0, 0), (3, "converged", 0, 0), (4, "verdict", 0, 0)}


def test_own_claims_are_not_those_of_questions(spark):
    d = json.dumps({"questions": {"id": "a", "unsupported_claims": ["x"]}, "unsupported_claims": "mine"})
    assert found(spark, [(1, "judge", d)]) == {(1, "question", 1, 0), (1, "question_claim", 1, 1), (1, "judge_claim", 1, 0)}


def test_nulls_torn_repeated_and_empty(spark):
    good = json.dumps({"claim_reviews": [{"claim": "c", "sources": ["s"]}]})
    rows = [(1, "news_verify", good), (1, "news_verify", good), (2, "news_verify", None), (3, None, good), (4, "news_verify", good[:20]), (5, "news_verify", ""), (6, "news_verify", "[1, 2]"), (7, "other", good)]
    assert found(spark, rows) == {(1, "claim_review", 1, 0), (1, "review_source", 1, 1)}
    assert found(spark, []) == set()


def test_very_long_record(spark):
    d = json.dumps({"claim_reviews": [{"claim": "x" * 200_000, "sources": [str(i) for i in range(3000)]}]})
    assert len(found(spark, [(1, "news_verify", d)])) == 3001


def test_parents_link(spark):
    d = json.dumps({"report": {"resolutions": [{"claim": "c", "anchors": ["a", "b"]}]}})
    t = event_tables(spark.createDataFrame([(9, "review", d, 1, "x")], S))
    parent = t.flat("resolution", ["claim"]).first()
    assert parent.claim == "c" and parent.parent_id == "9"
    assert [(r.parent_id, r.item) for r in t.flat("anchor", []).orderBy("child_pos").collect()] == [(parent.item_id, "a"), (parent.item_id, "b")]


def test_unknown_envelopes_are_found_by_the_merged_schema(spark):
    df = spark.createDataFrame([(1, "a", json.dumps({"x": {"y": {"items": [1, 2]}}})), (2, "a", json.dumps({"items": [3]}))], "id bigint, k string, j string")
    t = NestedTables(df, "id", "k", "j", [Collection("item", "items", ("a",), scalar=True)], [Scalar("flag", "flag", ("a",), "flag")])
    assert {tuple(r) for r in t.found().collect()} == {(1, "item", 1, 0), (1, "item", 2, 0), (2, "item", 1, 0)}


def test_disagreeing_records_hide_nothing(spark):
    rows = [(1, "a", '{"update": {"items": [1]}}'), (2, "a", '{"update": "none"}'), (3, "a", "7"), (4, "a", '{"update": [1]}')]
    df = spark.createDataFrame(rows, "id bigint, k string, j string")
    assert {tuple(r) for r in NestedTables(df, "id", "k", "j", [Collection("item", "items", ("a",), scalar=True)]).found().collect()} == {(1, "item", 1, 0)}


def test_schema_paths():
    assert list(_walk("OBJECT<a: ARRAY<OBJECT<x: STRING>>, `b c`: OBJECT<d: DECIMAL(3,1)>>")) == [("a", "ARRAY<OBJECT<x: STRING>>"), ("b c", "OBJECT"), ("b c.d", "DECIMAL(3,1)")]


def test_brute_force_on_the_smallest_tables(spark, sf):
    import re

    from tessera.session import table

    def decoded(v):
        while isinstance(v, str) and re.match(r'\s*[\[{"]', v):
            try:
                v = json.loads(v)
            except ValueError:
                break
        return v

    def items(v, scalar):
        v = decoded(v)
        if isinstance(v, dict) and (scalar or all(x is None or isinstance(x, dict) for x in v.values())):
            return [v[k] for k in sorted(v)]
        return v if isinstance(v, list) else [] if v is None else [v]

    want = set()
    for r in table(spark, sf, "run_events").select("event_id", "event", "data").collect():
        v = decoded(re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", r.data or ""))
        if not isinstance(v, dict):
            continue
        for name in ("update", "reply", "decision"):
            v = v[name] if isinstance(v.get(name), dict) else v

        def family(held, entity, child_entity=None, child=None, scalar=False, key=r.event_id):
            for i, x in enumerate(items(held, scalar), 1):
                if x is not None:
                    want.add((key, entity, i, 0))
                    if child and isinstance(x, dict):
                        want.update((key, child_entity, i, j) for j, c in enumerate(items(x.get(child), True), 1) if c is not None)

        if r.event == "planner":
            family(v["plan"].get("key_questions"), "plan_question", "plan_kpi", "kpis")
        elif r.event == "judge":
            family(v.get("questions"), "question", "question_claim", "unsupported_claims")
            family(v.get("unsupported_claims"), "judge_claim", scalar=True)
            if str(v.get("converged")).strip().lower() in ("true", "yes", "1"):
                want.add((r.event_id, "converged", 0, 0))
        elif r.event == "news_verify":
            family(v.get("claim_reviews"), "claim_review", "review_source", "sources")
        elif r.event == "review":
            family(v["report"].get("resolutions"), "resolution", "anchor", "anchors")
        if r.event in ("judge", "review"):
            text = v.get("verdict")
            text = text.get("text") if isinstance(text, dict) else text
            if text and text.strip():
                want.add((r.event_id, "verdict", 0, 0))
    assert want and {tuple(r) for r in event_tables(table(spark, sf, "run_events")).found().collect()} == want
