from fractions import Fraction

from tessera.llm import mixing as M

DOC = "doc_id bigint, text string, source string, repeats int, pattern string"
GOAL = "source string, target_share double, max_repeats int"


def test_flow_prefers_first_uses_and_shared_texts():
    t = {"a": (Fraction(1, 2), 1), "b": (Fraction(1, 2), 3)}
    flow, total = M.route({("a",): 100, ("b",): 20, ("a", "b"): 30}, t)
    # b can serve 3*20 + what of the shared text (three uses of 30 less those for a) is needed
    assert total >= 199 and sum(v for (p, r, s), v in flow.items() if s == "a") in range(total // 2 - 1, total // 2 + 2)
    assert all(r == 1 for (p, r, s), v in flow.items() if s == "a" and p == ("a",))
    assert M.route({("a",): 100}, t)[1] == 0


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "p") for i, t, s in rows], DOC)


def test_mix_meets_targets_within_caps(spark):
    rows = [(i, f"alpha beta gamma {i} " * (1 + i % 5), " Big ") for i in range(300)] + [(1000 + i, f"delta {i} eta " * 3, "small") for i in range(60)] + [(2000 + i, f"alpha beta gamma {i} " * (1 + i % 5), "small") for i in range(10)]
    rows += [(5000, None, "big"), (5001, "", "big"), (5002, "x", None), (5003, "y", "other"), (0, "alpha beta gamma 0 ", "BIG")]
    d, g = docs(spark, rows), spark.createDataFrame([("big", 0.6, 1), ("Small", 0.4, 3)], GOAL)
    got = M.mix(d, g)
    r = got.collect()
    assert {x.source for x in r} == {"big", "small"} and all(x.repeats <= (1 if x.source == "big" else 3) for x in r)
    assert not {x.doc_id for x in r} & {5000, 5001, 5002, 5003} and len({(x.doc_id, x.source) for x in r}) == len(r)
    s = {x.source: x for x in M.shares(got, g).collect()}
    assert abs(s["big"].share - 0.6) < 0.02 and s["small"].most_repeats > 1
    again = sorted((x.doc_id, x.source, x.repeats) for x in M.mix(d, g).collect())
    assert again == sorted((x.doc_id, x.source, x.repeats) for x in r)


def test_empty_source_and_table(spark):
    g = spark.createDataFrame([("big", 0.6, 1), ("none", 0.4, 3)], GOAL)
    assert M.mix(docs(spark, [(1, "a b c", "big")]), g).count() == 0
    empty = M.mix(docs(spark, []), g)
    assert empty.count() == 0 and {x.share for x in M.shares(empty, g).collect()} == {0.0}
