import numpy as np

from tessera.llm import quality as Q

PROSE = "The build step reads whatever the user placed in the home folder. It was written to handle a small set of rules, and then it returns to the start. "
CODE = "import json\n\n\ndef route(meter, limit=3):\n    acc = []\n    for i, x in enumerate(meter):\n        if x > limit * 4:\n            acc.append(x)\n    return acc\n"
TABLE = "\n".join(f"{i},{i * 7 % 13},abc,{i / 3:.2f}" for i in range(30))
LIST = "# Changes\n" + "\n".join(f"- patch item {i} (#{i * 31})" for i in range(30))
JUNK = "signal token " * 60
DOC = "doc_id bigint, text string, kind string, n_words int"


def get(text, name):
    return Q.features(text)[Q.NAMES.index(name)]


def test_statistics():
    assert get(PROSE, "prose_share") == 1 and get(CODE, "prose_share") < 0.2 and get(JUNK, "prose_share") == 0
    assert get(TABLE, "delimiter_alignment") > 0.9 and get(LIST, "bullet_share") > 0.9 and get(CODE, "indent_share") > 0.5
    assert get("One two.\nthree", "n_words") == 3 and get("One two.\nthree", "punct_line_share") == 0.5
    assert get("毛利率超过了大客户的需求。管理层拖累了续约放缓吗？" * 3, "prose_share") == 1
    assert Q.features(None)[0] == 0 and Q.features(" \n") == [2.0] + [0.0] * (len(Q.NAMES) - 1)


def test_long_text_and_odd_characters():
    assert len(Q.features("x" * 300_000)) == len(Q.NAMES) and all(np.isfinite(Q.features("\ud800 a\U0001f600 \x00" * 50)))


def documents(spark):
    rows, labels = [], []
    for i in range(60):
        for k, (kind, text) in enumerate((("prose", PROSE * (1 + i % 4)), ("code", CODE * (1 + i % 3)), ("table", TABLE[: 200 + i * 3]), ("list", LIST[: 200 + i * 5]), ("junk", JUNK[: 200 + i]))):
            rows.append((i * 10 + k, text, "k", 1))
            if i % 3 == 0:
                labels.append((i * 10 + k, kind.upper() + " "))
    rows += [(9000, None, "k", 1), (9001, " ", "k", 1)]
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(labels + labels[:3] + [(9000, "prose"), (77777, "prose"), (1, None)], "doc_id bigint, kind string")


def test_held_out_accuracy(spark):
    d, labels = documents(spark)
    got = {r.doc_id: (r.kind, r.is_prose) for r in Q.judged(d, labels).collect()}
    want = dict(enumerate(("prose", "code", "table", "list", "junk")))
    held = [i for i in got if i < 9000 and (i // 10) % 3]
    assert sum(got[i][0] == want[i % 10] for i in held) >= 0.95 * len(held)
    assert got[9000] == (None, False) and got[9001] == (None, False)
    assert {r.doc_id for r in Q.found(d, labels).collect()} == {i for i in got if got[i][1]}


def test_without_labels_and_empty(spark):
    d, labels = documents(spark)
    none = labels.filter("doc_id < 0")
    assert {r.doc_id % 10 for r in Q.found(d, none).collect()} == {0}
    assert Q.found(d.filter("doc_id < 0"), labels).count() == 0
