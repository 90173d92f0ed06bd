import random
from collections import Counter

import pytest

from tessera.llm import packing as P, tokens

DOC = "doc_id bigint, text string, source string, place int, size int"


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_item_once(seed):
    rng = random.Random(seed)
    cap = rng.choice([7, 50, 300])
    counts = dict(Counter(min(cap, 1 + int(rng.expovariate(4 / cap))) for _ in range(rng.choice([1, 40, 3000]))))
    got = P.plan(counts, cap)
    used = Counter()
    for pattern, times in got:
        assert sum(pattern) <= cap and times > 0
        for s in pattern:
            used[s] += times
    assert used == Counter(counts)
    total, boxes = sum(s * n for s, n in counts.items()), sum(t for _, t in got)
    assert boxes <= max(-(-total // cap) * 1.25 + 1, 1)


def test_exact_complements_first():
    assert sorted(map(tuple, (p for p, _ in P.plan({60: 1, 40: 1, 50: 1, 30: 1, 20: 1}, 100)))) == [(50, 30, 20), (60, 40)]
    assert P.plan({70: 3, 10: 9}, 100) == [([70, 10, 10, 10], 3)]
    assert P.plan({}, 10) == []
    with pytest.raises(ValueError):
        P.plan({11: 1}, 10)


def test_three_sizes_are_found_below_many_that_are_in_none():
    # 161, 170 and 152 fill what 517 leaves; more than 64 larger sizes fit there too
    counts = {517: 50, **dict.fromkeys(range(275, 379), 1), 161: 50, 170: 50, 152: 50}
    got = P.plan(counts, 1000)
    used = Counter()
    for pattern, times in got:
        for s in pattern:
            used[s] += times
    assert used == Counter(counts) and sum(times for _, times in got) == 85


def limits(spark, cap):
    return spark.createDataFrame([("container", None, "tokens", cap, 0), ("section", "*", "chars", 5, 0)], "item_kind string, form string, unit string, max_size int, overlap int")


def test_containers(spark):
    rows = [(i, "word " * (i % 17 + 1), "s", 1, 2) for i in range(200)] + [(900, "alpha beta " * 300, "s", 1, 2), (901, None, "s", 1, 2), (902, "", "s", 1, 2), (3, "word " * 4, "s", 1, 2)]
    d = spark.createDataFrame(rows, DOC)
    got = P.pack(d, limits(spark, 50)).collect()
    want = {r.doc_id: r.tokens for r in tokens.with_tokens(d).collect() if r.tokens}
    size, seen = Counter(), Counter()
    for r in got:
        size[r.container] += r.size
        seen[r.doc_id] += r.size
    assert seen == want and max(size.values()) <= 50 and len({(r.container, r.place) for r in got}) == len(got)
    assert sorted({r.container for r in got}) == list(range(len(size)))
    big = sorted((r.start_token, r.size) for r in got if r.doc_id == 900)
    assert [s for s, _ in big] == list(range(0, want[900], 50)) and all(n == 50 for _, n in big[:-1])
    assert all(r.piece == 0 for r in got if r.doc_id != 900)
    rep = P.report(P.pack(d, limits(spark, 50)), 50).first()
    assert rep.containers == len(size) and rep.tokens == sum(want.values())


def test_empty_and_missing_capacity(spark):
    d = spark.createDataFrame([], DOC)
    assert P.pack(d, limits(spark, 50)).count() == 0
    with pytest.raises(ValueError, match="capacity"):
        P.pack(d, limits(spark, 50).filter("item_kind = 'section'"))


def test_ranks_are_dense_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ITEMS", 7)
    rows = spark.range(100).selectExpr("id as doc_id", "0 as piece", "cast(id % 3 as int) as size")
    got = {}
    for r in P.rank(rows, 100).collect():
        got.setdefault(r["size"], []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values())
