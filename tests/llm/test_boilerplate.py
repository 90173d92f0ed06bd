from collections import defaultdict
import re

from tessera.llm import boilerplate as B

SEC = "section_id bigint, run_id bigint, text string, source string, key string, line_no int"


def frames(spark, rows, runs=((1, " abc "), (1, " abc "), (2, "ABC"), (3, "XYZ"), (4, None), (5, " "))):
    s = spark.createDataFrame([(*r, "s", "k", 0) for r in rows], SEC)
    return s, spark.createDataFrame(list(runs), "id bigint, ticker string")


def brute(rows, runs):
    tick = {i: t.strip().upper() for i, t in runs if t and t.strip()}
    by = defaultdict(dict)
    for sid, rid, text in rows:
        if rid in tick:
            by[tick[rid]][sid] = text
    out = set()
    for docs in by.values():
        seen = defaultdict(set)
        for sid, text in docs.items():
            for i, x in enumerate((text or "").split("\n"), 1):
                k = re.sub(r"\d+", "0", " ".join(x.lower().split()))
                if k:
                    seen[k].add((sid, i))
        for v in seen.values():
            n = len({s for s, _ in v})
            if n >= 5 and n / len(docs) >= 0.2:
                out |= v
    return out


def rows():
    out = [(i, 1 + i % 2, f"Own line {chr(97 + i)}\n\n  SHARE this   Page {i}\nPrint 1\n\ntail {chr(97 + i)}{'' if i % 3 else chr(10) + 'Rare line'}") for i in range(20)]
    out += [(100 + i, 3, "Only four\nshare this page 1") for i in range(4)] + [(200 + i, 4, "share this page 1") for i in range(9)] + [(300, 1, None), (301, 1, ""), (302, None, "x"), (303, 99, "x"), (304, 5, "x")]
    return out + out[:5]


def test_found_like_brute_force(spark):
    r = rows()
    s, runs = frames(spark, r)
    want = brute(r, [(1, " abc "), (2, "ABC"), (3, "XYZ"), (4, None), (5, " ")])
    got = [tuple(x) for x in B.found(s, runs).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) == 47


def test_blocks_join_consecutive_lines(spark):
    s, runs = frames(spark, rows())
    got = B.blocks(s, runs).collect()
    share, prints = B.line_key, [x for x in got if x.n_docs == 20]
    assert len(prints) == 2 and len({x.block for x in prints}) == 1 and len(got) == 3 and share


def test_blocks_stay_the_same_when_the_input_is_replicated(spark):
    # two blocks of two lines in each text, next to each other in one text of ten only
    text = lambda i: "Alpha\nBeta\n\nGamma\nDelta" if i % 10 else "Alpha\nBeta\nGamma\nDelta"
    got = []
    for times in (1, 6):
        s, runs = frames(spark, [(i, 1, text(i)) for i in range(10 * times)])
        got.append(sorted((x.source, x.block, x.key, x.n_docs // times) for x in B.blocks(s, runs).collect()))
    assert got[0] == got[1] and len(got[0]) == 4 and len({block for _, block, _, _ in got[0]}) == 2


def test_cleaned(spark):
    s, runs = frames(spark, rows())
    got = {x.section_id: (x.text, x.removed) for x in B.cleaned(s, runs).collect()}
    assert got[1] == ("Own line b\n\n\ntail b", 2) and got[100] == ("Only four\nshare this page 1", 0) and got[300] == (None, 0) and got[301] == ("", 0)


def test_components(spark):
    e = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("x1", "x2"), ("x2", "x2"), ("x3", "x2")], "a string, b string")
    got = {r.node: r.root for r in B.components(e).collect()}
    assert {got[f"n{i:03}"] for i in range(41)} == {"n000"} and {got[k] for k in ("x1", "x2", "x3")} == {"x1"}


def test_empty_and_long(spark):
    s, runs = frames(spark, [])
    assert B.found(s, runs).count() == 0 and B.blocks(s, runs).count() == 0 and B.cleaned(s, runs).count() == 0
    long = [(i, 1, "\n".join(f"line {'x' * (j % 7)}{chr(97 + j % 26)}{'y' * (j // 26)}" for j in range(2000))) for i in range(5)]
    s, runs = frames(spark, long)
    assert B.found(s, runs).count() == len(brute(long, [(1, "abc")]))
