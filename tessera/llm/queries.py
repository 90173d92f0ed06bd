"""The queries of the subpackage and, where SQL can state them over whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.session import table

from . import boilerplate, conversations, mixing, packing, quality, sentences, splitting, truncation

Query = Callable[[SparkSession, str], DataFrame]


def _truncation(s: SparkSession, d: str) -> truncation.Truncation:
    return truncation.Truncation(table(s, d, "turns"), table(s, d, "run_events"), table(s, d, "runs"))


def _packed(s: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(s, d, "documents"), table(s, d, "size_limits"))


def _mixed(s: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets"))


def _rebuilt_pieces(s: SparkSession, d: str) -> DataFrame:
    """Whether the pieces of each section are within their limit and overlap as stated, and the digest of their own parts put together."""
    x, lim = table(s, d, "sections"), table(s, d, "size_limits")
    p = splitting.pieces(x, lim)
    limits = splitting.with_limits(x.select("section_id", "form", F.lit("").alias("t")), lim).groupBy("section_id").agg(F.max(F.struct("unit", "max_size", "overlap")).alias("l"))
    own = F.expr("substring(text, start_pos - begin_pos + 1, end_pos - start_pos)")
    sized = p.join(limits, "section_id").withColumn("ok", F.coalesce(splitting.size(F.col("text"), F.col("l.unit")) <= F.col("l.max_size"), F.lit(True)))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("piece_no", own.alias("own")))), lambda z: z["own"])  # the pieces of one text
    return sized.groupBy("section_id").agg(F.md5(F.array_join(parts, "")).alias("digest"), F.min("ok").alias("within"))


def _rebuilt_sentences(s: SparkSession, d: str) -> DataFrame:
    """The digest of the sentences of each section put together, without white space."""
    u = sentences.sentence_units(table(s, d, "sections"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("no", "sentence"))), lambda z: z["sentence"])
    return u.groupBy("section_id").agg(F.md5(F.regexp_replace(F.array_join(parts, ""), r"(?U)\s+", "")).alias("digest"))


def _messages(s: SparkSession, d: str) -> DataFrame:
    """The messages of the sound runs, texts by their digest."""
    got = conversations.conversations(table(s, d, "turns"), table(s, d, "runs"))
    return got.select("run_id", "seq", "role", "round", "at", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


def _cleaned(s: SparkSession, d: str) -> DataFrame:
    got = boilerplate.cleaned(table(s, d, "sections"), table(s, d, "runs"))
    return got.select("section_id", F.md5("text").alias("digest"), "removed")


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: _truncation(s, d).found(),
        "p1_report": lambda s, d: _truncation(s, d).report(),
        "p1_limits": lambda s, d: _truncation(s, d).limits(),
        "p2_found": lambda s, d: conversations.unsound_runs(table(s, d, "turns"), table(s, d, "runs")),
        "p2_conversations": lambda s, d: conversations.conversations(table(s, d, "turns"), table(s, d, "runs")),
        "p2_sessions": lambda s, d: conversations.replies(table(s, d, "turns"), table(s, d, "runs")),
        "p4_found": lambda s, d: splitting.oversized(table(s, d, "sections"), table(s, d, "size_limits")),
        "p2_messages": _messages,
        "p4_rebuilt": _rebuilt_pieces,
        "p5_rebuilt": _rebuilt_sentences,
        "p7_lines_kept": _cleaned,
        "p4_pieces": lambda s, d: splitting.pieces(table(s, d, "sections"), table(s, d, "size_limits")),
        "p5_found": lambda s, d: sentences.sentences(table(s, d, "sections")),
        "p5_sentences": lambda s, d: sentences.sentence_units(table(s, d, "sections")),
        "p7_found": lambda s, d: boilerplate.found(table(s, d, "sections"), table(s, d, "runs")),
        "p7_blocks": lambda s, d: boilerplate.blocks(table(s, d, "sections"), table(s, d, "runs")),
        "p7_cleaned": lambda s, d: boilerplate.cleaned(table(s, d, "sections"), table(s, d, "runs")),
        "p8_containers": _packed,
        "p8_report": lambda s, d: packing.report(_packed(s, d), packing.capacity(table(s, d, "size_limits"))),
        "p9_mix": _mixed,
        "p9_shares": lambda s, d: mixing.shares(_mixed(s, d), table(s, d, "mix_targets")),
        "p10_found": lambda s, d: quality.found(table(s, d, "documents"), table(s, d, "doc_labels")),
        "p10_statistics": lambda s, d: quality.judged(table(s, d, "documents"), table(s, d, "doc_labels")),
    }


_SPACE = "[\\s\\x{00a0}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


UNSOUND = f"""
WITH m AS (SELECT DISTINCT run_id, seq, lower({_trim("coalesce(agent, '')")}) AS role, coalesce(text, '') AS text FROM turns WHERE run_id IS NOT NULL),
     r AS (SELECT DISTINCT run_id, round, lower({_trim("coalesce(agent, '')")}) AS role FROM turns WHERE run_id IS NOT NULL AND round IS NOT NULL),
     shape AS (SELECT run_id, count(*) AS n, count(seq) AS n_seq, count(DISTINCT seq) AS d, min(seq) AS lo, max(seq) AS hi,
                      bool_or(role IN ('bull', 'bear', 'judge') AND (regexp_full_match(text, '{_SPACE}*') OR regexp_full_match(text, '(?is){_SPACE}*\\[[^\\[\\]]*\\bunavailable\\b[^\\[\\]]*\\]{_SPACE}*'))) AS bad
               FROM m GROUP BY run_id),
     gaps AS (SELECT run_id, bool_or(k < 3) AS lacks FROM (SELECT run_id, round, count(DISTINCT CASE WHEN role IN ('bull', 'bear', 'judge') THEN role END) AS k FROM r GROUP BY run_id, round) GROUP BY run_id),
     known AS (SELECT id AS run_id, bool_and(coalesce(lower({_trim('status')}) = 'done', false)) AS done FROM runs WHERE id IS NOT NULL GROUP BY id)
SELECT coalesce(known.run_id, shape.run_id) AS run_id
FROM known FULL JOIN shape ON known.run_id = shape.run_id LEFT JOIN gaps ON gaps.run_id = shape.run_id
WHERE known.run_id IS NULL OR NOT done OR shape.run_id IS NULL OR n <> n_seq OR n <> d OR lo <> 1 OR hi <> n OR bad OR coalesce(lacks, false)"""
REPEATED = f"""
WITH t AS (SELECT id AS run_id, min(upper({_trim('ticker')})) AS source FROM runs WHERE {_trim("coalesce(ticker, '')")} <> '' GROUP BY id),
     d AS (SELECT DISTINCT section_id, source, text FROM sections JOIN t USING (run_id)),
     x AS (SELECT section_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM d WHERE text IS NOT NULL),
     k AS (SELECT section_id, source, line_no, regexp_replace(trim(regexp_replace(lower(line), '{_SPACE}+', ' ', 'g')), '\\p{{Nd}}+', '0', 'g') AS key FROM x WHERE NOT regexp_full_match(line, '{_SPACE}*')),
     n AS (SELECT source, count(DISTINCT section_id) AS total FROM d GROUP BY source),
     rep AS (SELECT source, key FROM (SELECT source, key, count(DISTINCT section_id) AS c FROM k GROUP BY source, key) JOIN n USING (source) WHERE c >= 5 AND c * 5 >= total)
SELECT DISTINCT section_id, CAST(line_no AS INT) AS line_no FROM k JOIN rep USING (source, key)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": UNSOUND,
        "p2_messages": f"""WITH bad AS ({UNSOUND}), m AS (SELECT run_id, seq, lower({_trim("coalesce(agent, '')")}) AS role, coalesce(text, '') AS text, min(round) AS round, min("at") AS said FROM turns WHERE run_id IS NOT NULL GROUP BY ALL)
SELECT run_id, seq, role, round, said AS "at", md5(text) AS digest FROM m WHERE run_id NOT IN (SELECT run_id FROM bad)""",
        "p4_rebuilt": "SELECT DISTINCT section_id, md5(text) AS digest, true AS within FROM sections WHERE text <> ''",
        "p5_rebuilt": f"""SELECT DISTINCT section_id, md5(regexp_replace(text, '{_SPACE}+', '', 'g')) AS digest FROM sections
WHERE NOT regexp_full_match(text, '{_SPACE}*') AND NOT regexp_full_match(text, '(?is){_SPACE}*\\[[^\\[\\]]*\\bunavailable\\b[^\\[\\]]*\\]{_SPACE}*')""",
        "p4_found": f"""
WITH lim AS (SELECT lower({_trim("coalesce(form, '*')")}) AS fk, lower(trim(unit)) AS unit, max_size FROM size_limits WHERE lower(trim(item_kind)) = 'section'),
     s AS (SELECT section_id, text, lower({_trim('form')}) AS fk FROM sections WHERE text IS NOT NULL)
SELECT DISTINCT section_id FROM s LEFT JOIN (SELECT * FROM lim WHERE fk <> '*') n ON n.fk = s.fk CROSS JOIN (SELECT unit AS u, max_size AS m FROM lim WHERE fk = '*') star
WHERE CASE WHEN coalesce(n.unit, u) = 'bytes' THEN strlen(text) ELSE length(text) END > coalesce(n.max_size, m)""",
        "p7_found": REPEATED,
        "p7_lines_kept": f"""WITH gone AS ({REPEATED}), once AS (SELECT section_id, max(text) AS text FROM sections GROUP BY section_id),
l AS (SELECT section_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM once WHERE text IS NOT NULL),
k AS (SELECT l.section_id, string_agg(CASE WHEN g.line_no IS NULL THEN line END, chr(10) ORDER BY l.line_no) AS text, CAST(count(g.line_no) AS INT) AS removed FROM l LEFT JOIN gone g ON g.section_id = l.section_id AND g.line_no = l.line_no GROUP BY l.section_id)
SELECT o.section_id, CASE WHEN o.text IS NOT NULL THEN md5(coalesce(k.text, '')) END AS digest, coalesce(removed, 0) AS removed FROM once o LEFT JOIN k ON k.section_id = o.section_id""",
    }
