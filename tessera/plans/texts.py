"""Queries over filings, sections, sentence windows and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import text as T
from tessera.operators import chunks as C, filings as L, vectors as V
from tessera.session import table

HISTORY = '{"form":["10-Q","8-K","10-K/A"],"accessionNumber":["a3","a2","a1"],"filingDate":["2026-05-01","2026-04-20","2026-02-10"],"primaryDocument":["q.htm","r.htm","k.htm"],"items":["","2.02",""]}'
OLDER = '{"form":["10-K/A","20-F"],"accessionNumber":["a1","a0"],"filingDate":["2026-02-10","2024-03-01"],"primaryDocument":["k.htm","f.htm"],"items":["",""]}'


def filing_index(s: SparkSession, d: str) -> DataFrame:
    """A columnar index and its older page as one history."""
    a = L.index_rows(s.createDataFrame([(HISTORY,)], "j string"), "j")
    b = L.index_rows(s.createDataFrame([(OLDER,)], "j string"), "j")
    return L.merge_older(a, b).select("accession", L.base_form(F.col("form")).alias("form"), L.role(F.col("form")).alias("role"), "filing_date", "primary_doc", "items")


def filing_roles(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "filings").distinct()
    return f.groupBy(L.base_form(F.col("form")).alias("base"), L.role(F.col("form")).alias("role")).agg(F.count("*").alias("n"), F.max("filing_date").alias("newest"))


def filer_types(s: SparkSession, d: str) -> DataFrame:
    return L.filer_types(table(s, d, "filings"))


def newest_filings(s: SparkSession, d: str) -> DataFrame:
    return L.newest(table(s, d, "filings"), 2)


def report_kinds(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "sections").filter("text is not null").select("section_id", "text").distinct()
    return x.groupBy(L.report_kind(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


EXHIBIT_NAMES = ["ex991.htm", "pressrelease.htm", "ex-99_2.htm", "exhibit10.htm", "slides.pdf"]


def exhibit_ranks(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(x,) for x in EXHIBIT_NAMES], "name string").select("name", L.exhibit_rank(F.col("name")).alias("rank"))


PAGE = "Contents Item 1A. Risk Factors 5 Item 2. Properties 9 Item 1A. Risk Factors We depend on few suppliers. Demand may fall. Item 2. Properties We lease."


def section_longest_span(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(PAGE,)], "page string").select(L.longest_section(F.col("page"), r"Item 1A\. Risk Factors", r"Item 2\. Properties").alias("section"))


def _pages(s: SparkSession, d: str) -> DataFrame:
    """Annual and interim filings put together from their sections: a table of contents, then each part under its item's heading."""
    x = table(s, d, "sections").filter("doc_id is not null and text is not null and section is not null").select("section_id", "doc_id", "section", "text", L.base_form(F.col("form")).alias("base")).distinct()
    item = F.regexp_replace(F.regexp_replace("section", r"^Part I+ ", ""), r"^Item 2$", "Item 2. Management's Discussion")
    own = x.filter(F.col("base").isin("10-K", "10-Q") & F.col("section").rlike(r"Item \d")).select("doc_id", "base", F.struct("section_id", item.alias("item"), "text").alias("p"))
    g = own.groupBy("doc_id", "base").agg(F.sort_array(F.collect_list("p")).alias("ps"))  # the parts of one filing
    contents = F.array_join(F.transform("ps", lambda p: F.concat(p["item"], F.lit(" . . . . . . . . . . . . 5"))), "\n")
    return g.select("doc_id", "base", F.concat(contents, F.lit("\n"), F.array_join(F.transform("ps", lambda p: F.concat(p["item"], F.lit("\n"), p["text"])), "\n")).alias("page"))


def form_sections(s: SparkSession, d: str) -> DataFrame:
    """The narrative sections found in the filings by the rules of their form: how long each is."""
    got = L.form_sections(_pages(s, d), "doc_id", "base", "page")
    return got.select("doc_id", "section", F.length("text").alias("chars"))


def risk_captions(s: SparkSession, d: str) -> DataFrame:
    """Sections as pages whose first sentence is set in bold: the captions that the markup tells, and their place."""
    x = table(s, d, "sections").filter("text is not null").groupBy("section_id").agg(F.min("text").alias("text"))
    first = F.get(T.split_sentences(F.col("text")), F.lit(0))
    tags = F.when(F.col("section_id") % 2 == 0, F.lit("b")).otherwise(F.lit("em"))
    clean = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<div><p><"), tags, F.lit(">"), clean(first), F.lit("</"), tags, F.lit("></p><p>"), clean(F.col("text")), F.lit("</p></div>"))
    return L.risk_captions(x.withColumn("page", page), "section_id", "page", "text").select("section_id", "pos", F.md5("caption").alias("digest"))


def missing_sections(s: SparkSession, d: str) -> DataFrame:
    """Filings that none of the sections came from, by form: an anti-join."""
    f = table(s, d, "filings").select("doc_id", "form").distinct()
    return f.join(table(s, d, "sections").select("doc_id"), "doc_id", "left_anti").groupBy(L.base_form(F.col("form")).alias("base")).agg(F.count("*").alias("n"))


def sentence_windows(s: SparkSession, d: str) -> DataFrame:
    return C.windows(table(s, d, "sections")).select("section_id", "k", "window_start", "core_start", "core_end", "window_end", F.md5("text").alias("digest"))


def boilerplate_windows(s: SparkSession, d: str) -> DataFrame:
    return C.windows(table(s, d, "sections")).groupBy(C.is_boilerplate(F.col("text")).alias("boilerplate")).agg(F.count("*").alias("n"))


def number_context(s: SparkSession, d: str) -> DataFrame:
    w = C.predecessors(C.windows(table(s, d, "sections"))).filter(F.col("text").rlike(r"\d"))
    return w.select("section_id", "k", F.col("context").isNotNull().alias("has_context"), F.length("context").alias("context_chars"))


def window_overlaps(s: SparkSession, d: str) -> DataFrame:
    return C.overlapping(C.windows(table(s, d, "sections")))


def truncate_sentence(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "sections").filter("text is not null").select("section_id", "text").distinct()
    return x.select("section_id", F.md5(T.trim_to_sentence(F.col("text"), 300, 100)).alias("digest"))


def url_keys(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "sections").filter("url is not null").select("section_id", "url").distinct()
    return x.groupBy(T.url_key(F.col("url")).alias("key")).agg(F.count("*").alias("n"))


def label_similarities(s: SparkSession, d: str) -> DataFrame:
    """Each risk title against the section heading it stands under."""
    x = table(s, d, "sections").filter("risk_title is not null and section is not null").select("risk_title", "section").distinct()
    return x.select("risk_title", "section", F.round(T.label_similarity(F.col("risk_title"), F.col("section")), 6).alias("similarity"))


def dollar_sentences(s: SparkSession, d: str) -> DataFrame:
    """The eight sentences of each section that state dollars, those of obligations first, in order."""
    from pyspark.sql import Window

    x = table(s, d, "sections").filter("text is not null").select("section_id", "text").distinct()
    e = x.select("section_id", F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "sentence")).filter(F.col("sentence").rlike(r"\$\s?\d"))
    score = F.regexp_count(F.lower("sentence"), F.lit(r"oblig|commit|lease|debt|guarantee|borrow|credit"))
    w = Window.partitionBy("section_id").orderBy(F.desc("score"), "pos")
    return e.withColumn("score", score).withColumn("k", F.row_number().over(w)).filter("k <= 8").select("section_id", "pos", "score", "k")


def _queries(s: SparkSession, d: str) -> DataFrame:
    """The stated query set of the searches: every row whose id is divisible by 20."""
    return table(s, d, "embeddings").filter("vec_id % 20 = 0")


def cosine_topk(s: SparkSession, d: str) -> DataFrame:
    return C.nearest(_queries(s, d), table(s, d, "embeddings"), "vec_id", "embedding", 5).select("query_id", "row_id", F.round("score", 4).alias("score"), "rank")


def indexed_topk(s: SparkSession, d: str) -> DataFrame:
    """The neighbours that the index finds, for the same queries."""
    return V.search(_queries(s, d), table(s, d, "embeddings"), "vec_id", "embedding", 5).select("query_id", "row_id", F.round("score", 4).alias("score"), "rank")


def indexed_recall(s: SparkSession, d: str) -> DataFrame:
    """Whether the index finds at least nine tenths of the exact neighbours, over all queries."""
    got = V.recall(indexed_topk(s, d), C.nearest(_queries(s, d), table(s, d, "embeddings"), "vec_id", "embedding", 5))
    return got.select("queries", (F.col("recall") >= 0.9).alias("enough"))


def indexed_topk(s: SparkSession, d: str) -> DataFrame:
    """The neighbours that the index finds, for the same queries."""
    return V.search(_queries(s, d), table(s, d, "embeddings"), "vec_id", "embedding", 5).select("query_id", "row_id", F.round("score", 4).alias("score"), "rank")


def indexed_recall(s: SparkSession, d: str) -> DataFrame:
    """Whether the index finds at least nine tenths of the exact neighbours, over all queries."""
    got = V.recall(indexed_topk(s, d), C.nearest(_queries(s, d), table(s, d, "embeddings"), "vec_id", "embedding", 5))
    return got.select("queries", (F.col("recall") >= 0.9).alias("enough"))


def cosine_floor_best(s: SparkSession, d: str) -> DataFrame:
    """Rows reached by any query above the floor, with their best score."""
    got = C.nearest(_queries(s, d), table(s, d, "embeddings"), "vec_id", "embedding", 20, floor=0.2)
    return got.groupBy("row_id").agg(F.round(F.max("score"), 4).alias("best"), F.count("*").alias("n"))


def retrieve_fenced(s: SparkSession, d: str) -> DataFrame:
    return C.nearest(_queries(s, d), table(s, d, "embeddings"), "vec_id", "embedding", 5, fence="label").select("query_id", "row_id", F.round("score", 4).alias("score"), "rank")


def retrieve_boosted(s: SparkSession, d: str) -> DataFrame:
    """Rows of the query's own label come first: the boost is larger than any score."""
    return C.nearest(_queries(s, d), table(s, d, "embeddings"), "vec_id", "embedding", 5, boost=100.0).select("query_id", "row_id", F.round("score", 4).alias("score"), "rank")


def retrieve_greedy(s: SparkSession, d: str) -> DataFrame:
    """Three of each query's best twelve, none too like one kept before (likeness by coordinates of the same sign and rank)."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.transform("embedding", lambda x, i: F.concat(i.cast("string"), F.lit(":"), F.signum(x).cast("int").cast("string"))).alias("words"))
    got = C.nearest(_queries(s, d), table(s, d, "embeddings"), "vec_id", "embedding", 12).join(e, "row_id")
    return C.greedy(got, 3, 0.75).select("query_id", "row_id", F.round("score", 4).alias("score"), "pick")


def related_leads(s: SparkSession, d: str) -> DataFrame:
    """Neighbours above a floor, or the single nearest as a fallback where there are none."""
    top = C.nearest(_queries(s, d), table(s, d, "embeddings"), "vec_id", "embedding", 3)
    over = top.filter("score >= 0.3")
    rest = top.join(over.select("query_id").distinct(), "query_id", "left_anti").filter("rank = 1")
    return over.withColumn("kind", F.lit("related")).unionByName(rest.withColumn("kind", F.lit("fallback"))).select("query_id", "row_id", F.round("score", 4).alias("score"), "kind")


def queries() -> dict:
    fs = [filing_index, filing_roles, filer_types, newest_filings, report_kinds, exhibit_ranks, section_longest_span, missing_sections, sentence_windows, boilerplate_windows, number_context, window_overlaps, truncate_sentence, url_keys,
          label_similarities, dollar_sentences, form_sections, risk_captions, cosine_topk, indexed_topk, indexed_recall, indexed_topk, indexed_recall, form_sections, risk_captions, cosine_floor_best, retrieve_fenced, retrieve_boosted, retrieve_greedy, related_leads]
    return {f.__name__: f for f in fs}


BASE = "upper(trim(split_part(regexp_replace(form, '\\s+', ' ', 'g'), '/', 1)))"
ROLE = f"CASE WHEN {BASE} IN ('10-K', '20-F', '40-F') THEN 'annual' WHEN {BASE} = '10-Q' THEN 'interim' WHEN {BASE} IN ('8-K', '6-K') THEN 'current' END"
STOPS = "[" + ", ".join(f"'{w}'" for w in T.STOP) + "]"


def _words(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '([a-z0-9]{{2,}})', 1)), lambda w: NOT list_contains({STOPS}, w))"


COS = """q AS (SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 20 = 0),
c AS (SELECT q.vec_id AS query_id, b.vec_id AS row_id, q.label = b.label AS same, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS s FROM q JOIN embeddings b ON q.vec_id <> b.vec_id)"""


def sql_split(source: str) -> str:
    """CTE ``sent`` (section_id, pos, sentence, n) of the sentences of ``source``; breaks are marked, then split at, as RE2 looks not behind."""
    mark = "'([.!?])\\s+([\"“(A-Z0-9])', '\\1' || chr(30) || '\\2', 'g'"
    return f"""src AS ({source}), cutup AS (SELECT section_id, text, string_split(regexp_replace(regexp_replace(text, {mark}), {mark}), chr(30)) AS l FROM src),
parts AS (SELECT section_id, list_filter(list_transform(l, lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM cutup),
sent AS (SELECT section_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos, len(s) AS n FROM parts)"""


ONE_TEXT = "SELECT section_id, min(text) AS text FROM sections WHERE text IS NOT NULL GROUP BY section_id"
WINDOWS = sql_split("SELECT DISTINCT section_id, text FROM sections WHERE text IS NOT NULL") + """,
once AS (SELECT section_id, min(s) AS s FROM parts WHERE len(s) > 0 GROUP BY section_id),
starts AS (SELECT section_id, s, len(s) AS n, unnest(generate_series(0, greatest(len(s) - 2, 0), 2)) AS core_start FROM once),
win AS (SELECT section_id, CAST(core_start / 2 AS INT) AS k, CAST(greatest(core_start - 1, 0) AS INT) AS window_start, CAST(core_start AS INT) AS core_start, CAST(least(core_start + 3, n) AS INT) AS core_end, CAST(least(least(core_start + 3, n) + 1, n) AS INT) AS window_end,
        array_to_string(s[greatest(core_start - 1, 0) + 1 : least(least(core_start + 3, n) + 1, n)], ' ') AS text FROM starts)"""


def oracle_sql() -> dict[str, str]:
    return {
        "sentence_windows": f"WITH {WINDOWS} SELECT section_id, k, window_start, core_start, core_end, window_end, md5(text) AS digest FROM win",
        "number_context": f"WITH {WINDOWS} SELECT a.section_id, a.k, b.text IS NOT NULL AS has_context, CAST(length(b.text) AS INT) AS context_chars FROM win a LEFT JOIN win b ON b.section_id = a.section_id AND b.k = a.k - 1 WHERE regexp_matches(a.text, '[0-9]')",
        "window_overlaps": f"WITH {WINDOWS} SELECT a.section_id, a.k, b.k AS other FROM win a JOIN win b ON b.section_id = a.section_id AND b.k > a.k AND b.window_start < a.window_end",
        "dollar_sentences": f"""WITH {sql_split("SELECT DISTINCT section_id, text FROM sections WHERE text IS NOT NULL")},
d AS (SELECT section_id, pos, len(regexp_extract_all(lower(sentence), 'oblig|commit|lease|debt|guarantee|borrow|credit')) AS score FROM sent WHERE regexp_matches(sentence, '[$]\\s?[0-9]')),
r AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY score DESC, pos) AS k FROM d) SELECT section_id, CAST(pos AS INT) AS pos, CAST(score AS INT) AS score, CAST(k AS INT) AS k FROM r WHERE k <= 8""",
        "filing_index": "SELECT * FROM (VALUES ('a3', '10-Q', 'interim', DATE '2026-05-01', 'q.htm', ''), ('a2', '8-K', 'current', DATE '2026-04-20', 'r.htm', '2.02'), ('a1', '10-K', 'annual', DATE '2026-02-10', 'k.htm', ''), ('a0', '20-F', 'annual', DATE '2024-03-01', 'f.htm', '')) t(accession, form, role, filing_date, primary_doc, items)",
        "filing_roles": f"SELECT {BASE} AS base, {ROLE} AS role, count(*) AS n, max(filing_date) AS newest FROM (SELECT DISTINCT * FROM filings) GROUP BY 1, 2",
        "filer_types": f"""WITH f AS (SELECT DISTINCT ticker, filing_date, accession, {BASE} AS b FROM filings WHERE ticker IS NOT NULL),
n AS (SELECT ticker, max({{'d': filing_date, 'a': accession, 'b': b}}) FILTER (b IN ('10-K', '20-F', '40-F') AND filing_date IS NOT NULL) AS x, max(CASE WHEN b IN ('10-K', '10-Q', '20-F', '40-F', '6-K') THEN 1 ELSE 0 END) AS p FROM f GROUP BY ticker)
SELECT ticker, CASE WHEN x.b = '10-K' THEN 'us' WHEN x.b = '20-F' THEN 'foreign' WHEN x.b = '40-F' THEN 'canadian' WHEN p = 1 THEN 'unclear' ELSE 'none' END AS filer_type FROM n""",
        "newest_filings": f"WITH f AS (SELECT DISTINCT ticker, {BASE} AS form, filing_date, accession FROM filings WHERE ticker IS NOT NULL AND filing_date IS NOT NULL), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY ticker, form ORDER BY filing_date DESC, accession DESC) AS INT) AS k FROM f) SELECT * FROM k WHERE k <= 2",
        "report_kinds": f"""SELECT CASE WHEN regexp_matches(h, '{L.MONTHLY}') THEN 'monthly' WHEN regexp_matches(h, '{L.QUARTER}') AND len(regexp_extract_all(h, '{L.RESULTS}')) >= 2 THEN 'quarterly' WHEN regexp_matches(h, '{L.RESULTS}') THEN 'interim' ELSE 'other' END AS kind, count(*) AS n
FROM (SELECT text AS h FROM (SELECT DISTINCT section_id, text FROM sections WHERE text IS NOT NULL)) GROUP BY 1""",
        "exhibit_ranks": "SELECT * FROM (VALUES ('ex991.htm', 0), ('pressrelease.htm', 1), ('ex-99_2.htm', 2), ('exhibit10.htm', 3), ('slides.pdf', 4)) t(name, rank)",
        "section_longest_span": "SELECT 'We depend on few suppliers. Demand may fall.' AS section",
        "missing_sections": f"SELECT {BASE} AS base, count(*) AS n FROM (SELECT DISTINCT doc_id, form FROM filings) WHERE doc_id NOT IN (SELECT doc_id FROM sections WHERE doc_id IS NOT NULL) GROUP BY 1",
        "truncate_sentence": """SELECT section_id, md5(CASE WHEN length(text) <= 300 THEN text WHEN length(f) >= 100 THEN f ELSE rtrim(regexp_extract(h, '(?s)^(.*)\\s', 1), ' ') || ' …' END) AS digest
FROM (SELECT section_id, text, substring(text, 1, 300) AS h, regexp_extract(substring(text, 1, 300), '(?s)^(.*[.!?])(?:\\s|$)', 1) AS f FROM (SELECT DISTINCT section_id, text FROM sections WHERE text IS NOT NULL))""",
        "url_keys": """SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), '^www\\.', '') || regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)), '/+$', '') AS key, count(*) AS n
FROM (SELECT DISTINCT section_id, url FROM sections WHERE url IS NOT NULL) GROUP BY 1""",
        "label_similarities": f"""WITH x AS (SELECT DISTINCT risk_title, section FROM sections WHERE risk_title IS NOT NULL AND section IS NOT NULL), w AS (SELECT *, {_words('risk_title')} AS a, {_words('section')} AS b, lower(trim(risk_title)) AS la, lower(trim(section)) AS lb FROM x)
SELECT risk_title, section, round(CASE WHEN la = lb THEN 1.0 WHEN contains(la, lb) OR contains(lb, la) THEN 0.9 WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0 ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) END, 6) AS similarity FROM w""",
        "cosine_topk": f"WITH {COS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, row_id) AS INT) AS rank FROM c) SELECT query_id, row_id, round(s, 4) AS score, rank FROM r WHERE rank <= 5",
        "indexed_recall": "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0",
        "form_sections": f"""WITH x AS (SELECT DISTINCT section_id, doc_id, section, text, {BASE} AS base FROM sections WHERE doc_id IS NOT NULL AND text IS NOT NULL AND section IS NOT NULL),
p AS (SELECT doc_id, base, regexp_replace(section, '^Part I+ ', '') AS item, trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)) AS body, text FROM x WHERE base IN ('10-K', '10-Q') AND regexp_matches(section, 'Item [0-9]')),
names(base, item, section, least) AS (VALUES ('10-K', 'Item 1', 'Item 1', 500), ('10-K', 'Item 1A', 'Item 1A', 500), ('10-K', 'Item 7', 'Item 7', 500), ('10-Q', 'Item 2', 'Item 2 (10-Q MD&A)', 500), ('10-Q', 'Item 1A', 'Item 1A (10-Q update)', 300)),
spans AS (SELECT doc_id, n.section, n.least, length(CASE WHEN p.item = 'Item 2' THEN 'Item 2. Management''s Discussion' ELSE p.item END) + 1 + length(rtrim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288))) AS chars FROM p JOIN names n ON n.base = p.base AND n.item = p.item WHERE body <> ''),
best AS (SELECT doc_id, section, least, max(chars) AS chars FROM spans GROUP BY ALL)
SELECT d.doc_id, n.section, CAST(CASE WHEN b.chars >= n.least THEN b.chars END AS INT) AS chars FROM (SELECT DISTINCT doc_id, base FROM p) d JOIN names n ON n.base = d.base LEFT JOIN best b ON b.doc_id = d.doc_id AND b.section = n.section""",
        "risk_captions": f"""WITH {sql_split(ONE_TEXT)}, f AS (SELECT section_id, trim(regexp_replace(replace(s[1], chr(160), ' '), '\\s+', ' ', 'g'), ' ') AS c FROM parts WHERE len(s) > 0)
SELECT section_id, CAST(1 AS INT) AS pos, md5(c) AS digest FROM f WHERE len(string_split(c, ' ')) BETWEEN 6 AND 60 AND (ends_with(c, '.') OR ends_with(c, '?'))""",
        "cosine_floor_best": f"WITH {COS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, row_id) AS rank FROM c WHERE s >= 0.2) SELECT row_id, round(max(s), 4) AS best, count(*) AS n FROM r WHERE rank <= 20 GROUP BY row_id",
        "retrieve_fenced": f"WITH {COS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, row_id) AS INT) AS rank FROM c WHERE same) SELECT query_id, row_id, round(s, 4) AS score, rank FROM r WHERE rank <= 5",
        "retrieve_boosted": f"WITH {COS}, t AS (SELECT query_id, row_id, s + CASE WHEN same THEN 100.0 ELSE 0.0 END AS s FROM c), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, row_id) AS INT) AS rank FROM t) SELECT query_id, row_id, round(s, 4) AS score, rank FROM r WHERE rank <= 5",
        "related_leads": f"""WITH {COS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, row_id) AS rank FROM c), t AS (SELECT * FROM r WHERE rank <= 3)
SELECT query_id, row_id, round(s, 4) AS score, CASE WHEN s >= 0.3 THEN 'related' ELSE 'fallback' END AS kind FROM t WHERE s >= 0.3 OR (rank = 1 AND query_id NOT IN (SELECT query_id FROM t WHERE s >= 0.3))""",
    }
