import glob
import os

import duckdb
import pytest

from tessera.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_rows_as_sql(spark, sf, name):
    df = Q.queries()[name](spark, sf)
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    r = c.execute(Q.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted((tuple(x[n] for n in names) for x in df.collect()), key=str) == sorted(r.fetchall(), key=str)


def rows(spark, sf, name):
    return Q.queries()[name](spark, sf).collect()


def test_truncation_adds_up(spark, sf):
    found, report, limits = (rows(spark, sf, f"p1_{x}") for x in ("found", "report", "limits"))
    assert len({(r.field, r.rec_id) for r in found}) == len(found) == sum(r.n_cut for r in report)
    assert all(0 <= r.n_limit <= r.n_cut <= r.n_values for r in report) and all(r.n_cut * 2 >= r.n for r in limits)


def test_sessions_cover_the_messages(spark, sf):
    said = rows(spark, sf, "p2_conversations")
    per = {(r.run_id, r.session): r.messages for r in rows(spark, sf, "p2_sessions")}
    assert sum(per.values()) == len(said) and {(r.run_id, r.session) for r in said} == set(per)
    runs = {}
    for r in said:
        runs.setdefault(r.run_id, []).append(r.seq)
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in runs.values())


def test_pieces_sentences_and_blocks(spark, sf):
    assert {r.section_id for r in rows(spark, sf, "p4_pieces") if r.piece_no > 1} == {r.section_id for r in rows(spark, sf, "p4_found")}
    assert {(r.section_id, r.end_pos) for r in rows(spark, sf, "p5_sentences")} == {(r.section_id, r.end_pos) for r in rows(spark, sf, "p5_found")}
    removed = {r.section_id: r.removed for r in rows(spark, sf, "p7_cleaned")}
    assert sum(removed.values()) == len(rows(spark, sf, "p7_found"))
    names = {(r.source, r.key) for r in rows(spark, sf, "p7_blocks")}
    assert all((r.source, r.block) in names for r in rows(spark, sf, "p7_blocks"))


def test_containers_hold_every_item_once(spark, sf):
    cap = {}
    got = rows(spark, sf, "p8_containers")
    for r in got:
        cap.setdefault(r.container, []).append((r.place, r.size))
    most = rows(spark, sf, "p8_report")[0]
    assert all(sum(s for _, s in x) <= most.capacity and sorted(p for p, _ in x) == list(range(1, len(x) + 1)) for x in cap.values())
    assert len({(r.doc_id, r.piece) for r in got}) == len(got) and len(cap) == most.containers and sum(r.size for r in got) == most.tokens


def test_mix_keeps_to_its_targets(spark, sf):
    mix, shares = rows(spark, sf, "p9_mix"), rows(spark, sf, "p9_shares")
    cap = {r.source: r.max_repeats for r in shares}
    assert all(1 <= r.repeats <= cap[r.source] for r in mix) and abs(sum(r.share for r in shares) - 1) < 1e-5
    assert sum(r.tokens * r.repeats for r in mix) == sum(r.tokens for r in shares)


def test_prose_is_what_the_statistics_say(spark, sf):
    s = rows(spark, sf, "p10_statistics")
    assert {r.doc_id for r in s if r.is_prose} == {r.doc_id for r in rows(spark, sf, "p10_found")}
    assert all(0 <= r.prose_score <= 1 and 0 <= r.column_alignment <= 1 for r in s)


def test_columns_of_the_found_queries(spark, sf):
    want = {"p1_found": "field string, rec_id bigint", "p2_found": "run_id bigint", "p4_found": "section_id bigint", "p5_found": "section_id bigint, end_pos int", "p7_found": "section_id bigint, line_no int", "p10_found": "doc_id bigint"}
    for name, schema in want.items():
        assert ", ".join(f"{a} {b}" for a, b in Q.queries()[name](spark, sf).dtypes) == schema
